"""What queries leave behind: the session's settings, and draws that lose no rows."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def settings(spark):
    return {r["key"]: r["value"] for r in spark.sql("SET").collect()}


def test_queries_change_no_setting(spark):
    before = settings(spark)
    for name in ("m3_toc", "train_epochs", *(n for n in entry.queries() if n.startswith("op"))):
        entry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert settings(spark) == before


def test_draws_lose_no_rows_under_load(spark):
    """Drawing sorted rows of a table while the processors are busy gives all rows, also after other queries."""
    busy = [subprocess.Popen([sys.executable, "-c", "while True: pass"]) for _ in range(os.cpu_count())]
    try:
        rows = spark.range(400).withColumn("g", F.col("id") % 8).repartition(4, "g").cache()
        for k in range(50):
            some = rows.where(F.col("g") == k % 8).orderBy("id")
            assert [r["id"] for r in some.toLocalIterator()] == list(range(k % 8, 400, 8))
    finally:
        for p in busy:
            p.kill()
