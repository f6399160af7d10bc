"""Text sources, batching and shards."""

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import batching, linalg
from loomgrid.plans import jobs
from loomgrid.sources import shards, text


def write(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_libsvm_golden(spark, tmp_path):
    path = write(tmp_path, "a.txt", "1 1:1 2:2\n2 2:2 3:3\n3 3:3 4:4\n")
    rows = text.read_libsvm(spark, path, num_columns=5).orderBy("row_id").collect()
    assert [r.dense for r in rows] == [[0, 1, 2, 0, 0], [0, 0, 2, 3, 0], [0, 0, 0, 3, 4]]
    assert [[(c.col, c.val) for c in r.cells] for r in rows] == [[(1, 1), (2, 2)], [(2, 2), (3, 3)], [(3, 3), (4, 4)]]
    assert [r.label for r in rows] == [1, 2, 3]
    first = text.Reader(text.read_libsvm(spark, path, num_columns=5)).mini_batch(2, 0)
    assert [r.label for r in first.orderBy("row_id").collect()] == [1, 2]


def test_libsvm_edges(spark, tmp_path):
    path = write(tmp_path, "a.txt", "1 0:5 3:9 2:0\n2 1:1 1:7\n3\n")
    rows = text.read_libsvm(spark, path, num_columns=3).orderBy("row_id").collect()
    assert [r.dense for r in rows] == [[5, 0, 0], [0, 7, 0], [0, 0, 0]]
    assert [len(r.cells) for r in rows] == [2, 2, 0]


@pytest.mark.parametrize(
    ("line", "numbers"),
    [("1,2,0,1", [1, 2, 0, 1]), ("74\t85\t1", [74, 85, 1]), ("1, 2", [1, 2]), ("022500,7", [22500, 7]), ("3,x,4", [3]), ("", []), (",1,2", []), ("NaN,1", []), ("1d,2", []), ("-1.5e2,.5", [-150, 0.5])],
)
def test_csv_lines(spark, line, numbers):
    df = spark.createDataFrame([(line,)], "value string")
    assert df.select(text.numbers_of(F.col("value"))).first()[0] == numbers


def test_csv_labels_limit_ragged(spark, tmp_path):
    path = write(tmp_path, "a.csv", "1,2,0,1\n2,3,1,2\n3,3,0,5\n")
    rows = text.read_csv(spark, path, label_index=3, read_rows=2).orderBy("row_id").collect()
    assert [(r.label, r.dense, [(c.col, c.val) for c in r.cells]) for r in rows] == [(1, [1, 2, 0], [(0, 1), (1, 2)]), (2, [2, 3, 1], [(0, 2), (1, 3), (2, 1)])]
    drawn = [r.label for r in text.read_csv(spark, path).orderBy("row_id").collect()]
    assert drawn == [r.label for r in text.read_csv(spark, path).orderBy("row_id").collect()] and set(drawn) <= {0, 1}
    bad = write(tmp_path, "b.csv", "1,2\n1\n")
    with pytest.raises(Exception, match="ragged row 1"):
        text.check_widths(text.read_csv(spark, bad)).collect()


def test_zero_filter_and_scaling(spark):
    df = spark.createDataFrame([([1e-6, 2e-6, 0.0, -1.0],)], "dense array<double>")
    cells = batching.nonzero(F.col("dense"))
    got = df.select(cells.alias("c"), batching.scale_sparse(cells, 0.0).alias("same"), batching.scale_sparse(cells, 1e-3).alias("small")).first()
    assert [c.col for c in got.c] == [1, 3] and got.same == got.c and [c.col for c in got.small] == [1, 3]


def test_batches_short_and_drawn(spark):
    rows = spark.range(7).select(F.col("id").alias("row_id"))
    sizes = {r.batch_id: r["count"] for r in batching.contiguous(rows, 3).groupBy("batch_id").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 1}
    drawn = batching.with_replacement(rows, 5, 4, 7).collect()
    assert len(drawn) == 20 and {r.row_id for r in drawn} <= set(range(7))


@pytest.mark.parametrize("name", ["toc", "gzip", "csrvi"])
def test_shard_files_and_tables(spark, tmp_path, name):
    rows = spark.range(10).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"), F.when(F.col("id") == 4, F.array().cast("array<struct<col:int,val:double>>")).otherwise(F.array(F.struct((F.col("id") % 4).cast("int").alias("col"), (F.col("id") + 0.5).alias("val")))).alias("cells")
    )
    made = jobs.generate(rows, jobs.GenerateConfig(format=name, batch_size=3, batches_per_shard=2, scale=0.0, num_cols=4, check=True)).cache()
    for f in shards.shard_files(made).collect():
        (tmp_path / f"file-{f.shard_id}.{name}").write_bytes(f.content)
    back = shards.read_shard_files(spark, str(tmp_path / f"file-*.{name}"))
    assert [(r.shard_id, r.batch_id, r.labels) for r in back.orderBy("shard_id", "batch_id").collect()] == [(0, 0, [0, 1, 2]), (0, 1, [0, 1, 2]), (1, 0, [0, 1, 2]), (1, 1, [0])]
    shards.write_shards(made, str(tmp_path / "table"), name)
    stored = shards.read_shards(spark, str(tmp_path / "table"), name)
    cells = {(r.row_id, r.col, r.val) for r in linalg.decoded_cells(stored, name, 3).collect()}
    assert cells == {(i, i % 4, i + 0.5) for i in range(10) if i != 4}
    assert shards.read_shards(spark, str(tmp_path / "table"), name, start=1).count() == 2


def test_shard_number(spark):
    df = spark.createDataFrame([("file:/x/file-12.libsvm",)], "p string")
    assert df.select(text.shard_number(F.col("p"))).first()[0] == 12


def test_unsorted_rows_are_sorted_and_repeats_refused(spark):
    rows = spark.createDataFrame([(0, 0, 0, [(2, 1.0), (0, 3.0)])], "batch_id long, row_in_batch long, label int, cells array<struct<col:int,val:double>>")
    assert {(r.col, r.val) for r in linalg.decoded_cells(linalg.encode_batches(rows, "toc", 3), "toc", 1).collect()} == {(0, 3.0), (2, 1.0)}
    twice = spark.createDataFrame([(0, 0, 0, [(0, 1.0), (0, 3.0)])], rows.schema)
    with pytest.raises(Exception, match="names a column twice"):
        linalg.encode_batches(twice, "toc", 3).collect()
