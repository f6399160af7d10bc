"""Personal data: patterns, and information-theoretic sanitisation of what gives it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. A term discloses
an entity if knowing the term leaves little doubt about the entity: over all documents, the pointwise mutual
information ln(N * n(t, e) / (n(t) * n(e))) is at least `alpha` times the entity's information ln(N / n(e)).
Counts are of documents. Pairs need evidence from at least `support` different texts, so that an entity of one
text, however often copied, discloses nothing. Disclosing terms are spans too, in every document that has them,
whether it holds the entity or not; sanitising replaces every span by its kind.

Terms are words `[^\\x20\\x09-\\x0D]+`, A-Z as a-z, that overlap no pattern. They are counted by 64-bit hashes.
Counting all words would move much that is never asked for: only words whose hash falls on a bit of a fixed
bitmap, set by the words next to entities, are counted. Texts are told apart by their SHA-256.

Cases: null text is empty, for sanitising it stays null. Equal rows get equal results and each counts as a
document. An empty table gives an empty result. Other columns are ignored or, when sanitising, kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, batches, discard, materialise, text_bytes, word_hashes

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
ALPHA = 0.9
#: Bits of the bitmap of words worth counting.
BITMAP = 1 << 23
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: as many local characters as stand before it, and a domain after it. Linear in the text."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (code points) of all patterns, by kind as listed, then start."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _key() -> Column:
    """What tells texts apart: SHA-256, null for a null text."""
    return F.unhex(F.sha2("text", 256)).alias("key")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entity(kind: str, found: str) -> int:
    """A 63-bit name of an entity; spelling of numbers and addresses does not matter."""
    value = found.lower() if kind == "email" else found if kind == "ip" else "".join(c for c in found if "0" <= c <= "9")
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little") >> 1


def terms_of(text: str, taken: list[tuple[str, int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes and places of the words that overlap no span taken."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h, _ = word_hashes(raw, np.array([0, len(raw)]))
    places = [m.span() for m in _WORD.finditer(text)]
    edges = sorted((a, b) for _, a, b in taken)
    free, k, reach = [], 0, -1
    for i, (a, b) in enumerate(places):
        while k < len(edges) and edges[k][0] < b:
            reach = max(reach, edges[k][1])
            k += 1
        if reach <= a:
            free.append(i)
    return h[free].astype(np.int64), [places[i] for i in free]


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, key binary, entities array<long>, private_text string"


def find_patterns(docs: DataFrame) -> DataFrame:
    """A row for each document: its patterns, its entities, and, if it has any, its text."""

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = [x or "" for x in b.column("text").to_pylist()]
            spans = [base_spans(x) for x in texts]
            counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            base = [joined(x) for x in spans]
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            ents = [sorted({_entity(k, t[i:j]) for k, i, j in x}) for x, t in zip(spans, texts)]
            own = [t if x else None for x, t in zip(spans, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array(sha, pa.string()), b.column("key"), pa.array(ents, pa.list_(pa.int64())), pa.array(own, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "key", "entities", "private_text"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", _key()).mapInArrow(find, _FOUND)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The bits of the hashes in column term, packed."""
    bits = np.zeros(BITMAP, bool)
    bits[terms.select(F.pmod("term", F.lit(BITMAP)).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()] = True  # BITMAP rows at most
    return np.packbits(bits)


_PLACES = "array<struct<start:int,end:int>>"


def places_of(docs: DataFrame, told: DataFrame) -> DataFrame:
    """key and the places (code points, in order) of the terms told (distinct), for the texts that have some outside patterns:
    a bitmap, then an exact join. Texts stay where they are; of those that the bitmap lets through, hashes and places move."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(told))

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for b in batches(it):
            h, first = word_hashes(*text_bytes(b.column("text")))
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            row, term, places = [], [], []
            for i in np.unique(doc[bits[h.astype(np.int64) & (BITMAP - 1)]]).tolist():
                text = b.column("text")[i].as_py()
                own, at = terms_of(text, base_spans(text))
                by_term: dict[int, list[dict]] = {}
                for k in np.flatnonzero(bits[own & (BITMAP - 1)]).tolist():
                    by_term.setdefault(int(own[k]), []).append({"start": at[k][0], "end": at[k][1]})
                row += [i] * len(by_term)
                term += by_term
                places += by_term.values()
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row, pa.int64())), pa.array(term, pa.int64()), pa.array(places, kind)], ["key", "term", "places"])

    may = docs.select("text", _key()).mapInArrow(ask, f"key binary, term long, places {_PLACES}").distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int"))
    asked = told.select("term", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))  # a term may be in many texts
    return may.join(asked, ["term", "salt"]).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))  # places in one text


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame | None:
    """key and the places of disclosing terms of all texts that have some, of whatever entity; None if nothing discloses."""
    tables = Tables()
    total = found.count()
    held = found.where(F.size("entities") > 0)
    per_text = held.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("private_text").alias("text"))
    per_text = tables.hold(per_text)
    entities = per_text.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_e"))
    entities = tables.hold(entities.where(F.col("texts") >= support).drop("texts"))
    if entities.isEmpty():
        discard(*tables.made)
        return None
    asked = per_text.select("key", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity").groupBy("key").agg(F.collect_set("entity").alias("entities"))  # the entities of one text

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            terms = [np.unique(terms_of(t, base_spans(t))[0]) for t in b.column("text").to_pylist()]
            size = np.array([len(x) for x in terms])
            row = pa.array(np.repeat(np.arange(len(terms)), size))
            yield pa.RecordBatch.from_arrays([b.column("key").take(row), b.column("copies").take(row), pa.array(np.concatenate(terms) if len(terms) else np.zeros(0, np.int64))], ["key", "copies", "term"])

    near = tables.hold(per_text.select("key", "copies", "text").join(asked.select("key"), "key").mapInArrow(words, "key binary, copies long, term long"))
    both = near.join(asked, "key").select("key", "copies", "term", F.explode("entities").alias("entity"))
    pairs = tables.hold(both.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts"))
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches(it):
            h, first = word_hashes(*text_bytes(b.column("text")))
            h = h.astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            some = bits[h & (BITMAP - 1)]
            h, doc = h[some], doc[some]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            terms, where = np.unique(np.concatenate([terms, h[new]]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, np.ones(int(new.sum()), np.int64)]), len(terms)).astype(np.int64)
            if len(terms) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "n"])
                terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "n"])

    n_t = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    told = pairs.join(entities, "entity").join(n_t, "term")
    known = F.log(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    told = tables.hold(told.where((known > 0) & (pmi >= alpha * known)).select("term").distinct())
    if told.isEmpty():
        discard(*tables.made)
        return None
    return tables.result(places_of(docs, told))


def private_data(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """doc_id, counts of patterns, base_sha256 and all spans of every document."""
    found = materialise(find_patterns(docs))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    terms = disclosing_terms(docs, found, support, alpha)
    if terms is None:
        return found.select(*names, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_term"))
    none = F.array().cast("array<string>")
    spans = F.concat(F.when(F.col("base") != "", F.array("base")).otherwise(none), F.coalesce(F.transform("places", lambda x: F.concat(F.lit("term:"), x["start"], F.lit(":"), x["end"])), none))
    rows = found.select(*names, "base", "key").join(terms, "key", "left")  # no texts
    return rows.select(*names, F.array_join(spans, ",").alias("spans"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_term"))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """docs with every span of text replaced by its kind."""
    names = docs.columns
    found = materialise(find_patterns(docs).select("key", "entities", "private_text"))
    terms = disclosing_terms(docs, found, support, alpha)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", _key())
    rows = rows.withColumn("places", F.lit(None).cast(_PLACES)) if terms is None else rows.join(terms, "key", "left")

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = [t and replaced(t, base_spans(t) + [("term", p["start"], p["end"]) for p in x or []]) for t, x in zip(b.column("text").to_pylist(), b.column("places").to_pylist())]
            row = b.column("row")
            columns = [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("row", "text", "places").mapInArrow(clean, docs.schema)
