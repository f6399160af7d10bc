"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; for each bit a binary classifier over hashed byte trigrams of the
lower-cased text says which side the text is on. Decoding sums, over the bits, the loss of each language's
codeword against the classifiers' outputs, weighted by how reliable each bit proved in training, and takes the
language of least loss. A text whose two nearest codewords are close is flagged ambiguous.

Learning reads a bounded sample: about `per_lang` labelled rows of each language, dealt by a hash of doc_id,
and at most twice that in all. Prediction reads whole texts and nothing but the text.

Cases: null text, or one without a letter, is `und` with score 0. Without any labelled row everything is
`und`. A null doc_id counts as the empty text in the held-out rule. Empty tables give empty results; equal
texts get equal answers; ties go to the language that sorts first; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, mix64, text_bytes

#: log2 of the number of trigram buckets.
BITS = 12
#: The most languages that are learned, the most frequent, and the most rows that are sampled for all of them together.
MOST_LANGS, MOST_ROWS = 1024, 16_384
#: Rows of each language that the classifiers are fitted on, about.
PER_LANG = 1000
#: Least score of an answer that is not ambiguous.
CLEAR = 0.5
RIDGE = 0.3
_BLOCK = 1 << 18


def _tables() -> np.ndarray:
    """Three tables that hash a byte by its place in a trigram; whatever is not a letter in ASCII counts as a blank."""
    kind = np.arange(256)
    plain = kind < 128
    letter = ((kind >= 97) & (kind <= 122)) | ((kind >= 65) & (kind <= 90))
    kind = np.where(plain & ~letter, 32, kind)
    raw = [mix64((kind.astype(U64) + U64(1000 * k + 17)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS) for k in range(3)]
    return np.stack(raw).astype(np.uint16)


def trigram_blocks(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of trigram buckets: the buckets, where runs of one text start in the block, and which text each run is of.

    Trigrams that would cross from one text into the next have the bucket 2**BITS.
    """
    t = _tables()
    for a in range(0, len(raw), _BLOCK):
        b = min(len(raw), a + _BLOCK)
        part = raw[a : min(len(raw), b + 2)]
        idx = np.full(b - a, 1 << BITS, np.uint16)
        m = min(b - a, len(part) - 2)
        if m > 0:
            idx[:m] = t[0][part[:m]] ^ t[1][part[1 : m + 1]] ^ t[2][part[2 : m + 2]]
        for back in (1, 2):
            ends = off[1:] - back - a
            idx[ends[(ends >= 0) & (ends < b - a)]] = 1 << BITS
        starts = np.unique(np.concatenate([[a], off[(off > a) & (off < b)]]))
        yield idx, starts - a, np.searchsorted(off, starts, "right") - 1


def text_sums(raw: np.ndarray, off: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sums of weights (one row a classifier) over its trigrams, and the number of trigrams."""
    n = len(off) - 1
    out = np.zeros((weights.shape[0], n))
    wide = np.concatenate([weights, np.zeros((weights.shape[0], 1), weights.dtype)], 1)
    for idx, starts, text in trigram_blocks(raw, off):
        for j in range(len(wide)):
            np.add.at(out[j], text, np.add.reduceat(wide[j][idx], starts))
    return out, np.maximum(0, np.diff(off) - 2)


def codewords(k: int) -> np.ndarray:
    """k codewords: all splits of the languages in two for up to 7 of them, else the best of some pseudo-random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        split = np.arange(1, 2 ** (k - 1))
        return np.stack([np.ones(len(split)), *[1.0 - 2.0 * ((split >> b) & 1) for b in range(k - 1)]])
    bits, best = math.ceil(10 * math.log2(k)), None
    for seed in range(32):
        code = 1.0 - 2.0 * (mix64(np.arange(k * bits, dtype=U64) + U64(1 + seed * 1_000_003)) & U64(1)).astype(float).reshape(k, bits)
        apart = np.min((bits - (code @ code.T))[~np.eye(k, dtype=bool)])
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def _ridge(z: np.ndarray, target: np.ndarray, steps: int = 80) -> np.ndarray:
    """Weights w that minimise |z w - target|^2 + RIDGE |w|^2, by conjugate gradients, which need no matrix but z."""
    w = np.zeros((z.shape[1], target.shape[1]), np.float32)
    r = z.T @ target
    p, rr = r.copy(), (r * r).sum(0)
    for _ in range(steps):
        q = z.T @ (z @ p) + np.float32(RIDGE) * p
        a = rr / np.maximum((p * q).sum(0), 1e-20)
        w += a * p
        r -= a * q
        new = (r * r).sum(0)
        p = r + (new / np.maximum(rr, 1e-20)) * p
        rr = new
    return w


class EcocModel:
    """Languages, their codewords, a linear classifier a bit, and how far each bit is to be trusted."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> EcocModel:
        """x: relative trigram frequencies, a row a text (overwritten); ridge regression onto the bits, with equal weight a language."""
        names = sorted(set(langs))
        code = codewords(len(names))
        at = np.array([names.index(s) for s in langs], int)
        if len(names) == 0:
            return cls([], code, np.zeros((1, 1 << BITS), np.float32), np.zeros(1), np.ones(1))
        weight = np.sqrt(1.0 / np.bincount(at, minlength=len(names))[at] / len(names))[:, None].astype(np.float32)
        mean = (weight.T**2 @ x)[0]
        x -= mean  # in place: the sample is the driver's largest object
        scale = 1.0 / (np.sqrt((weight.T**2 @ np.square(x))[0]) + 1e-5)
        x *= scale
        x *= weight
        y = code[at]
        middle = (y * weight**2).sum(0)
        w = _ridge(x, ((y - middle) * weight).astype(np.float32))
        right = np.mean(np.sign((x @ w) / weight + middle) == y, axis=0)
        w = w * scale[:, None]
        return cls(names, code, np.ascontiguousarray(w.T, np.float32), middle - mean @ w, np.clip(2 * right - 1, 0.05, 1.0))

    def decode(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword of each column of outputs, and its share of the evidence (0 to 1)."""
        loss = np.einsum("j,kjn->kn", self.trust, np.exp(-np.clip(self.code[:, :, None] * out[None], -4, 4)))
        near = np.argmin(loss, axis=0)
        share = np.exp(-2.0 * (loss - loss.min(axis=0)))
        return near, 1.0 / share.sum(axis=0)

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, n = text_sums(raw, off, self.weights)
        return self.decode(sums / np.maximum(n, 1) + self.bias[:, None])


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of a key as text, modulo m (a null key: the empty text)."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % m


def fit_language_id(docs: DataFrame, per_lang: int = PER_LANG) -> EcocModel:
    """A model of the labelled rows of docs (columns doc_id, text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    per_lang = max(1, min(per_lang, MOST_ROWS // max(1, len(counts))))
    share = F.lit(0)
    if counts:
        table = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, math.ceil((1 << 30) * per_lang / r["n"])))])
        share = F.coalesce(F.try_element_at(table, F.col("lang")), F.lit(0))
    few = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) < share).limit(2 * per_lang * max(1, len(counts)))

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            raw, off = text_bytes(b.column("text"))
            sums = []
            for i in range(b.num_rows):
                hist = np.zeros((1 << BITS) + 1)
                one = raw[off[i] : off[i + 1]]
                for idx, _, _ in trigram_blocks(one, np.array([0, len(one)])):
                    hist += np.bincount(idx, minlength=(1 << BITS) + 1)
                at = np.flatnonzero(hist[:-1])
                sums.append(np.concatenate([at, hist[at]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("key"), pa.array(sums, pa.binary())], ["lang", "key", "hist"])

    got = few.select("lang", F.lower("text").alias("text"), F.xxhash64("doc_id", "text").alias("key")).mapInArrow(features, "lang string, key long, hist binary").toPandas()
    got = got.sort_values(["lang", "key"], kind="stable")
    x = np.zeros((len(got), 1 << BITS), np.float32)
    langs = list(got["lang"])
    for i, blob in enumerate(got.pop("hist")):
        v = np.frombuffer(blob, "<u4")
        at, n = v[: len(v) // 2], v[len(v) // 2 :]
        x[i, at] = n / max(1, n.sum())
    return EcocModel.fit(x, langs)


def predict_language(docs: DataFrame, model: EcocModel, keep: list[str]) -> DataFrame:
    """Columns keep of docs, then lang_pred, score and ambiguous."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # a few classifiers of 2**BITS weights
    ready = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).alias("_text"))

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], object)
        for b in batches(it):
            texts = b.column(b.num_columns - 1)
            near, score = m.predict(*text_bytes(texts)) if m.langs else (np.zeros(b.num_rows, int), np.zeros(b.num_rows))
            blank = texts.is_null().to_numpy(zero_copy_only=False) | (not m.langs)
            near, score = np.where(blank, len(m.langs), near), np.where(blank, 0.0, np.clip(score, 0.0, 1.0))
            made = [pa.array(names[near], pa.string()), pa.array(score), pa.array(~blank & (score < CLEAR))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], schema=pa.schema([*list(b.schema)[:-1], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("ambiguous", pa.bool_())]))

    kind = ready.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return ready.mapInArrow(predict, kind)


def filter_language(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The documents whose language is told clearly, with their own columns; learns from all labelled rows."""
    model = fit_language_id(docs, per_lang)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = predict_language(whole, model, ["row"])
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("row.*")


def identify_language(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document; learns from the rows that are not held out."""
    out = docs.select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = fit_language_id(out.where(~F.col("held_out")), per_lang)
    return predict_language(out, model, ["doc_id", "held_out"])
