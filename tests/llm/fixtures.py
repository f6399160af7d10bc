"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, sig string, length long, key long"


def words(text):
    """Lower-cased words, A-Z only."""
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]


def sentence(rng, n, vocabulary="the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split()):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "ing", "er", "ly"]) for _ in range(n))


def table(spark, texts, langs=None):
    """Documents 0..n-1 (or the pairs given) with columns that clash with the operators' own names."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    full = [(d, t, langs[i] if langs else "en", "s", len(t or ""), True, "x", "y", 3, 4) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def odd_texts():
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "   \n\t ", "word", "Word", "two words", "two  WORDS", "12 34 5", "!!! ???", base, base, base.upper(), " ".join(near),
        sentence(rng, 20_000), "x" * 60_000, ("same line here\n" * 60), "é ñ ü ß 中文 😀", "tab\tsep\x0bvt\x0cff\rcr", "nul\x00in", sentence(rng, 90), sentence(rng, 51),
    ]


def empty(spark):
    return table(spark, [(0, "x")]).where(F.lit(False))
