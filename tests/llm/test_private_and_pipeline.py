import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from loomgrid.llm import language_id, packing
from loomgrid.llm import private_data as private
from loomgrid.llm.common import materialise, public_tokenizer

from .fixtures import WORD, empty, odd_texts, sentence, table
from .test_near_duplicates import brute
from .test_shards_quality_license import stats

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(s[::-1])]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+1 2(3)%4é\n5", max_size=60))
def test_patterns_by_brute_force(text):
    assert private.base_spans(text) == plain(text)


def test_pattern_cases():
    for t in ["4111 1111 1111 1111", "x 4111-1111-1111-1111.", "1.2.3.4.5.6.7.8 001.255.256.1 010.1.1.1", "+1 (974) 555-3436", "a@b.c@d.e", "+49 30 1234567 +1 2", "a@b a@b.c. @x.y", "9" * 4000, "1.2.3." + "0" * 4000 + "4", "@" * 1000, "a" * 20_000 + "@x.de"]:
        assert private.base_spans(t) == plain(t), t[:40]


def corpus():
    """An entity told in several texts, always with the same rare term; the same entity copied in one text; clean texts."""
    rng = random.Random(1)
    texts = [f"{sentence(rng, 30)} zorbulon {sentence(rng, 5)} reach me at jo.doe@mail.example.com {sentence(rng, 20)}" for _ in range(5)]
    texts += ["unique quibblefax note call +1 (974) 555-3436 now"] * 6
    texts += [sentence(rng, 40) for _ in range(200)]
    return texts + odd_texts()


def test_disclosure(spark):
    texts = corpus()
    got = {r.doc_id: r for r in private.private_data(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = plain(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in private.KINDS)
        terms = [(t or "")[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("term")]
        assert terms == (["zorbulon", "reach", "me"] if i < 5 else []) and r.n_term == len(terms)
        assert not base or r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base))
    assert private.private_data(empty(spark)).count() == 0


def test_sanitising_keeps_columns_and_clean_texts(spark):
    texts = corpus()
    docs = table(spark, texts)
    out = private.sanitise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert all("zorbulon" not in got[i] and "<TERM>" in got[i] and "<EMAIL>" in got[i] and "@" not in got[i] for i in range(5))
    assert got[5] == "unique quibblefax note call <PHONE> now"
    assert all(got[i] == t for i, t in enumerate(texts) if not plain(t or ""))
    assert private.replaced("abcdef", [("x", 1, 3), ("y", 2, 4)]) == "a<X>ef"


def test_terms_are_found_without_their_entity(spark):
    """A disclosing term also counts in a text without any pattern and in one with another entity only."""
    texts = [*corpus(), "only Zorbulon here, zorbulon", "zorbulon calls +1 (974) 555-3436"]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in private.private_data(docs).collect()}
    a, b = len(texts) - 2, len(texts) - 1
    assert len(got) == len(texts) and (got[a].spans, got[a].n_term) == ("term:5:13,term:20:28", 2)
    assert (got[b].spans, got[b].n_term, got[b].n_phone) == ("phone:15:32,term:0:8", 1, 1)
    assert got[b].base_sha256 == hashlib.sha256(b"phone:15:32").hexdigest()
    clean = {r.doc_id: r.text for r in private.sanitise(docs).collect()}
    assert clean[a] == "only <TERM> here, <TERM>" and clean[b] == "<TERM> calls <PHONE>"
    assert not any("zorbulon" in (t or "").lower() for t in clean.values())


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Where terms disclose, rows of all documents meet their terms without their texts."""
    monkeypatch.setattr(private, "materialise", lambda df: held(df))
    made = []

    def held(df):
        made.append(materialise(df))
        return made[-1]

    texts = corpus()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = private.private_data(table(spark, texts))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(made) == 1 and "Join LeftOuter" in plan
    assert not re.search(r"\btext#|MapInArrow", plan)
    got = {r.doc_id: r for r in out.collect()}
    assert {i for i, r in got.items() if r.n_term} == set(range(5)) and len(got) == len(texts)
    for i in range(5):
        places = [m.span() for m in re.finditer(r"zorbulon|(?<!\S)reach(?!\S)|(?<!\S)me(?!\S)", texts[i])]
        assert got[i].spans == ",".join([*(f"{k}:{a}:{b}" for k, a, b in plain(texts[i])), *(f"term:{a}:{b}" for a, b in places)])


def told_clearly(model, text):
    near, score = model.predict(np.frombuffer(text.lower().encode(), np.uint8), np.array([0, len(text.lower().encode())]))
    return bool(regex.search(r"\p{L}", text)) and score[0] >= language_id.CLEAR


def passes(text):
    n, chars, symbols, dup, repeat = stats(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bad = n < 50 or 100 * repeat > 50 * n or symbols > n or chars < 2 * n or chars > 25 * n or 2 * dup > len(lines)
    return not (bad or 3 * text.count("!!") > n or 2 * len(regex.findall(r"\p{L}", text)) < chars)


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage acts on all that the one before kept, as a plain version of it does."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_dedup", "personal_data", "packing"]
    model = language_id.fit_language_id(docs)
    plainly = {
        "language": lambda t: {d: x for d, x in t.items() if told_clearly(model, x or "")},
        "quality": lambda t: {d: x for d, x in t.items() if passes(x or "")},
        "near_dedup": lambda t: {d: t[d] for d, _, _, kept in brute(sorted(t.items()), 5) if kept},
        "personal_data": lambda t: {d: x and private.replaced(x, plain(x)) for d, x in t.items()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        want = plainly[name]({r.doc_id: r.text for r in docs.collect()})
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert len(after) == docs.count() and after == want, name
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(after)
    s = packed.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    encoder = packing.WordEncoder(public_tokenizer("word_bpe_49k.json"))
    ids, off = encoder.encode(pa.array([after[d] for d in sorted(after)], pa.string()))
    assert packed.groupby("doc_id").length.sum().sort_index().tolist() == np.diff(off).tolist()


def test_pipeline_on_odd_and_empty_tables(spark):
    rng = random.Random(3)
    docs = table(spark, [*odd_texts(), *[sentence(rng, 80) + f" mail me{i}@x.org" for i in range(20)]])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert 15 <= docs.count() and corpus_pipeline.pack(spark, docs, "").count() >= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0
