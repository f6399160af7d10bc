"""Queries against their SQL, and the entry without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgrid import queries
from loomgrid.plans import jobs

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "embeddings")
CHOSEN = [n for n in queries.ORACLES if n.startswith(("b", "h", "s", "size", "n", "lzw", "j", "train"))] + ["m1_matvec", "m1_matvec_array", "m2_vecmat", "m3_matmul", "m3_matmul_array", "m4_tmatmul", "m5_scale", "m7_sum", "m3_toc", "m4_toc", "m2_csrvi", "m7_dvi", "m6_logical", "roundtrip_toc"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(queries.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda d: sorted(tuple(repr(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(mine) == rows(theirs)


@pytest.fixture(scope="module")
def many_shards(spark, tmp_path_factory):
    """Embeddings of 122 shards, the last one short."""
    path = str(tmp_path_factory.mktemp("many"))
    v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("id") * 7 + i * 3) % 11 - 5).cast("float"))
    spark.range(121 * 250 + 40).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), v.alias("embedding")).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_jobs_cover_tables_of_many_shards(spark, many_shards):
    n = 121 * 250 + 40
    made = queries.QUERIES["j7_generate"](spark, many_shards).toPandas()
    assert sorted(made.shard_id) == list(range(122)) and made.num_rows.sum() == n
    for name, first in (("s8_shard_table", 250), ("s9_shard_files", 0)):
        r = queries.QUERIES[name](spark, many_shards).agg(F.min("row_id"), F.max("row_id"), F.countDistinct("row_id")).first()
        assert tuple(r) == (first, n - 1, n - first)


def test_steps_of_every_batch(spark, many_shards):
    for name in ("n7_grad_w", "n7_grad_b", "n9_step_encoded"):
        assert queries.QUERIES[name](spark, many_shards).select("batch_id").distinct().count() == 122


def test_training_is_tested_on_all_rows(spark, monkeypatch):
    seen, train = [], jobs.train
    monkeypatch.setattr(jobs, "train", lambda made, config, model, test: (seen.append(test.agg(F.sum("num_rows")).first()[0]), train(made, config, model, test))[1])
    queries.QUERIES["train_epochs"](spark, SF)
    assert seen == [spark.read.parquet(f"{SF}/embeddings.parquet").count()]


def test_entry_without_llm(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/loomgrid", tmp_path / "loomgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm3_toc' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
