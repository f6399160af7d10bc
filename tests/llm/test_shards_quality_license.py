import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import entry, license_scan, quality_rules, shuffle_shards
from loomgrid.llm.shuffle_shards import FeistelShuffle

from .fixtures import WORD, empty, odd_texts, sentence, table


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation_with_inverse(n):
    f = FeistelShuffle(n, seed=3)
    rows = np.arange(n)
    place = f.place(rows)
    assert sorted(place.tolist()) == rows.tolist() and f.row(place).tolist() == rows.tolist()
    shard, slot = f.locate(rows, 16)
    assert f.at(shard, slot, 16).tolist() == rows.tolist()
    assert n < 100 or place.tolist() != rows.tolist()


def test_shards_law_and_digests(spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "again")] * 40 + [(None, "no id")] * 3
    docs = table(spark, rows)
    got = shuffle_shards.shuffle_shards(docs, shards=16).toPandas()
    assert len(got) == len(rows)
    counts = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and len(counts) == 16
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and not got.duplicated(["shard", "slot"]).any()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    mine = Counter((None if d != d else int(d), s, c) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    assert mine == want
    again = shuffle_shards.shuffle_shards(docs.repartition(7), shards=16).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot", "row_no"]
    assert got.sort_values(key)[key].to_numpy().astype(str).tolist() == again.sort_values(key)[key].to_numpy().astype(str).tolist()
    assert shuffle_shards.shuffle_shards(empty(spark)).count() == 0


def stats(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    hit = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_figures_and_verdicts(spark):
    texts = [*odd_texts(), "# " * 80, "THE!! CAT!! " * 40, "Many a word of prose stands here and is told once only. " + sentence(random.Random(3), 70), "a b c a b c d e a b c " * 8]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(t), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule is None) and (not r.base_failed or r.rule == "base")
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_order_changes_work_not_verdicts(spark):
    docs = table(spark, [*odd_texts(), "x$$$ " * 60, "ab!! cd " * 70])
    rules = quality_rules.default_rules()
    stated = quality_rules.with_stats(docs.select("doc_id", "text"))
    verdicts = []
    for order in (list(rules), list(rules)[::-1]):
        out = stated.select("doc_id", quality_rules.cascade(rules, order, quality_rules.known_figures()).isNull().alias("k"))
        verdicts.append(sorted((r.doc_id, r.k) for r in out.collect()))
        asked = quality_rules.let(quality_rules.words_of(F.col("text")), lambda w: quality_rules.cascade(rules, order, quality_rules.asked_figures(F.col("text"), w)).isNull())
        verdicts.append(sorted((r.doc_id, r.k) for r in docs.select("doc_id", asked.alias("k")).collect()))
    assert all(v == verdicts[0] for v in verdicts)
    assert sorted(quality_rules.order_rules(docs, rules)) == sorted(rules)


def test_filter_keeps_columns(spark):
    docs = table(spark, odd_texts())
    out = quality_rules.filter_quality(docs)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept and kept


APACHE = """# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """/* a tool
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
   following disclaimer.
"""


def test_licenses(spark):
    texts = {
        None: "", "": "", "plain text. nothing": "", "Some words.\nReleased under the MIT License.": "MIT", "### Licensed under CC BY-NC 4.0. ###": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nReleased under the MIT License.": "Apache-2.0,MIT",
        "Copyright 2020 nobody. Strange license terms apply.": "", "x" * 50_000 + "\nReleased under the MIT License.": "MIT", "Title\nReleased under the MIT License\nmore words": "MIT",
        APACHE: "Apache-2.0", GPL: "GPL-3.0-or-later", MIT: "MIT", MPL: "MPL-2.0", LGPL: "LGPL-2.1-or-later", BSD: "BSD-2-Clause", "// SPDX-License-Identifier: GPL-2.0-only\nint x;": "GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
        "This project is licensed under the terms of the GNU GPL v2 or any later version.": "GPL-2.0-or-later", "The text is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0", "He was under the bridge. The software under test is slow.": "",
    }
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, list(texts))).collect()}
    assert [got[i].licenses for i in range(len(texts))] == list(texts.values())
    at = list(texts).index
    assert got[at(APACHE)].sentence_ids == "1,2,3,4" and got[7].n_unknown == 2 and got[6].n_sentences == 3 and got[2].n_sentences == 2
    assert license_scan.license_scan(empty(spark)).count() == 0


def test_licenses_equal_sql_on_odd_texts(spark, tmp_path):
    texts = [*odd_texts(), APACHE, GPL, MIT, MPL, LGPL, BSD, APACHE + MIT, "a\n" * 300 + "Released under the MIT License", "Licensed under\nthe MIT\nLicense", "all rights reserved", "is 3 under par", "released\nunder MIT", "under mit", "published under_the_terms of\nan MIT licence"]
    table(spark, [*enumerate(texts), (3, MIT), (3, MIT), (None, GPL)]).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    mine, theirs = license_scan.license_scan(spark.read.parquet(f"{tmp_path}/d")).toPandas(), con.execute(license_scan.oracle()).df()
    columns = sorted(mine.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).fillna(-1).astype(str).replace("3.0", "3").to_numpy()))
    assert [tuple(x.removesuffix(".0") for x in r) for r in rows(mine)] == [tuple(x.removesuffix(".0") for x in r) for r in rows(theirs)]


def test_marks_of_known_sentences():
    """Every known sentence holds a mark, so that texts without one need no closer look; identifiers and rules fit."""
    assert all(re.search(license_scan.MARK, s) for s in license_scan.KEYS)
    assert {i for _, seq in license_scan.RULES for i in seq} <= set(license_scan.NUMBERS) and len(set(license_scan.KEYS)) == len(license_scan.KEYS)
    assert not [s for s in license_scan.KEYS if re.search(license_scan.STATED, s)]


@pytest.mark.parametrize("name", ["op5_quality_cascade", "op8_license_rules", "op3_lsh_forest"])
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine, theirs = entry.QUERIES[name](spark, sf).toPandas(), con.execute(entry.ORACLES[name]).df()
    columns = sorted(mine.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy()))
    assert columns == sorted(theirs.columns) and rows(mine) == rows(theirs)


def test_native_plans(spark):
    for name in ("op5_quality_cascade", "op8_license_rules"):
        plan = entry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
