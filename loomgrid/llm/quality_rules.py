"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule says which documents it rejects, from figures that are computed where a rule asks for them and not before. On
a bounded sample every rule's cost (time a row, over many rows and without the time of a run that does nothing) and
selectivity (share it rejects) are estimated; rules are then tried in the order of rejections per cost, and a document
is given up at the first rule that rejects it. Costs count in powers of two, so that noise seldom changes the order.
The order changes the work, not the verdict.

Cases: null or empty text has no words and fails the base rule. Equal rows get equal verdicts. An empty table
gives an empty result. Columns are read by name: doc_id and text; others, whatever their names, are kept by
`filter_quality` and ignored by `quality_rules`.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialise

SPACE = r"[\x20\x09-\x0D]"
#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 500
#: How often each row of the sample is taken to tell costs.
REPEATS = 8
#: The sample is taken from this share of rows, dealt by hash, in thousandths; all rows are used where it finds none.
SAMPLE_PER_MILLE = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), " "), "")


def _repeated(words: Column, n: Column) -> Column:
    """How many words lie in three-word windows that are found twice or more.

    Windows are compared by 64-bit hashes of their words; sorted, equal ones are neighbours.
    """

    def covered(pairs: Column) -> Column:
        m = F.size(pairs)
        twin = lambda k: (F.get(pairs, k)["h"] == F.get(pairs, k - 1)["h"]) | (F.get(pairs, k)["h"] == F.get(pairs, k + 1)["h"])
        at = F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda k: F.coalesce(twin(k), F.lit(False))), lambda k: F.get(pairs, k)["i"])
        return let(at, lambda p: F.size(F.array_distinct(F.flatten(F.array(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))))

    def windows(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(pairs, covered))

    each = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, 0).otherwise(let(each, windows))


def text_stats(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    safe = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def by_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(n.cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), _repeated(w, n).cast("long").alias("n_repeat_words"))

    by_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return F.struct(let(words_of(text), by_words).alias("w"), let(lines, by_lines).alias("l"), F.regexp_count(safe, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))


Figure = Callable[[str], Column]
Rule = Callable[[Figure], Column]


def _matches(pattern: str) -> Rule:
    return lambda f: F.regexp_count(f("text"), F.lit(pattern))


def default_rules() -> dict[str, Rule]:
    """The rules of the cascade, by name: true where a document is rejected, from its figures."""
    return {
        "symbols": lambda f: f("n_symbols") > f("n_words"),
        "word_length": lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 25 * f("n_words")),
        "dup_lines": lambda f: 2 * f("n_dup_lines") > f("n_lines"),
        "shouting": lambda f: 3 * _matches("!!")(f) > f("n_words"),
        "letters": lambda f: 2 * _matches(r"\p{L}")(f) < f("word_chars"),
    }


#: The two parts of the base rule.
BASE: dict[str, Rule] = {"few_words": lambda f: f("n_words") < 50, "repeated_words": lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")}


def known_figures() -> Figure:
    """Figures that are columns."""
    return lambda name: F.coalesce(F.col("text"), F.lit("")) if name == "text" else F.col(name)


def asked_figures(text: Column, words: Column) -> Figure:
    """Figures computed where they are asked for, from a text and its words."""
    safe = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "text": safe,
        "n_words": F.size(words),
        "word_chars": F.length(F.concat_ws("", words)),
        "n_symbols": F.regexp_count(safe, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(words, F.size(words)),
    }.__getitem__


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the base figures and base_failed."""
    out = docs.withColumn("_stats", text_stats(F.col("text")))
    s = F.col("_stats")
    out = out.withColumns(
        {"n_words": s["w"]["n_words"], "word_chars": s["w"]["word_chars"], "n_symbols": s["n_symbols"], "n_lines": s["l"]["n_lines"], "n_dup_lines": s["l"]["n_dup_lines"], "n_repeat_words": s["w"]["n_repeat_words"]}
    ).drop("_stats")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def order_rules(docs: DataFrame, rules: dict[str, Rule], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of rules by rejections per cost, estimated on a sample of at most sample_rows rows, each taken REPEATS times."""
    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1000)) < SAMPLE_PER_MILLE).limit(sample_rows)
    sample = materialise(few.unionByName(docs.select("text").limit(20)))
    many = sample.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(REPEATS)))).repartition(2)
    many = materialise(many.select("text"))

    def rejected(rule: Rule) -> Column:
        return let(words_of(F.col("text")), lambda w: F.coalesce(rule(asked_figures(F.col("text"), w)), F.lit(False)))

    def taken(each: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = many.agg(F.avg(each.cast("double"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    nothing = let(words_of(F.col("text")), lambda w: F.size(w) < 0)
    taken(nothing)  # code is compiled and files are read
    idle = min(taken(nothing)[1] for _ in range(2))
    rate = {}
    for k, rule in rules.items():
        share, seconds = taken(rejected(rule))
        rate[k] = share / 2.0 ** round(math.log2(max(seconds - idle, 0.002)))
    discard(sample, many)
    return sorted(rules, key=lambda k: (-rate[k], k))


def cascade(rules: dict[str, Rule], order: list[str], figure: Figure) -> Column:
    """The first rule that rejects, null if none does; CASE stops at the first hit, so later rules are not computed."""
    out = None
    for k in order:
        out = F.when(rules[k](figure), k) if out is None else out.when(rules[k](figure), k)
    return out if out is not None else F.lit(None).cast("string")


def quality_rules(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and the rejecting rule of every document."""
    rules = rules or default_rules()
    order = order_rules(docs, rules, sample_rows)
    rule = F.when(F.col("base_failed"), "base").otherwise(cascade(rules, order, known_figures()))
    out = with_stats(docs.select(F.col("doc_id"), "text")).withColumn("rule", rule)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rule").isNull().alias("kept"), "rule")


def filter_quality(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns. The base rule's two parts are rules of the cascade too, and
    a document that a cheap rule rejects costs no more than that rule."""
    rules = BASE | (rules or default_rules())
    order = order_rules(docs, rules)
    return docs.where(let(words_of(F.col("text")), lambda w: cascade(rules, order, asked_figures(F.col("text"), w)).isNull()))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY rid),
s AS (SELECT doc_id, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             CASE WHEN n_symbols > n_words THEN 'symbols'
                  WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 'word_length'
                  WHEN 2 * n_dup_lines > n_lines THEN 'dup_lines'
                  WHEN 3 * len(regexp_extract_all(text, '!!')) > n_words THEN 'shouting'
                  WHEN 2 * len(regexp_extract_all(text, '\p{L}')) < word_chars THEN 'letters' END AS rule FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND rule IS NULL) AS kept FROM b
"""
