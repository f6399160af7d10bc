"""The engine's queries over the driver's tables, and the same in SQL.

E is `embeddings` as a matrix (row vec_id, 64 columns), its cells those larger than EPS. L is `lineitem` as a matrix of
five columns, its rows numbered in the order of all columns. Fixed vectors and weights have closed forms, small
integers where sums are compared, so that sums are exact in any order; other figures are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import EPS, byte_width, draw, sigmoid
from .operators import batching, dictionaries, linalg, lzw, mlp
from .operators.codecs import FORMATS, codec
from .operators.codecs import byte_width as byte_width_of
from .plans import jobs
from .sources import shards, text
from .tables import number_by_order, read_table, scratch_path

COLS, SIZE, WIDTH = 64, 250, 4
HIDDEN, OUTPUTS, RATE = 5, 10, 0.5
L_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
_L_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _add(name: str, f: Query, sql: str | None = None) -> None:
    f.__name__ = name
    query(sql)(f)


# The matrices.

E_SQL = f"""cells AS (SELECT vec_id AS row_id, i - 1 AS col, embedding[i]::DOUBLE AS val
  FROM (SELECT vec_id, embedding, unnest(range(1, {COLS + 1})) AS i FROM embeddings) WHERE abs(embedding[i]::DOUBLE) > {EPS})"""
_L_ROWS = f"SELECT *, row_number() OVER (ORDER BY {', '.join(_L_ORDER)}) - 1 AS row_id FROM lineitem"
L_SQL = f"""l_all AS (SELECT row_id, col, [{', '.join(f'{c}::DOUBLE' for c in L_COLUMNS)}][col + 1] AS val
  FROM ({_L_ROWS}) t, range(5) r(col)), l_cells AS (SELECT * FROM l_all WHERE abs(val) > {EPS})"""


def e_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label, dense, cells of E."""
    dense = F.transform("embedding", lambda v: v.cast("double"))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", dense.alias("dense"))
    return rows.withColumn("cells", batching.nonzero(F.col("dense")))


def e_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_rows(spark, sf_dir).select("row_id", F.inline("cells"))


def e_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"))


def l_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_by_order(read_table(spark, sf_dir, "lineitem"), _L_ORDER, keep=list(L_COLUMNS))
    return rows.select("row_id", F.array(*[F.col(c).cast("double") for c in L_COLUMNS]).alias("dense")).withColumn("cells", batching.nonzero(F.col("dense")))


def l_dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l_rows(spark, sf_dir).select("row_id", F.posexplode("dense").alias("col", "val"))


def l_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l_rows(spark, sf_dir).select("row_id", F.inline("cells"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def other_matrix(rows: np.ndarray) -> np.ndarray:
    return ((rows[:, None] * 7 + np.arange(WIDTH) * 3) % 11 - 5).astype(float)


def _vector(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("col"), (F.col("id") + 1).cast("double").alias("x"))


def _row_vector(ids: DataFrame) -> DataFrame:
    return ids.select("row_id", (F.col("row_id") % 7 + 1).cast("double").alias("x"))


def _other(keys: DataFrame, key: str) -> DataFrame:
    every = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("k"))
    return every.select(key, "k", ((F.col(key) * 7 + F.col("k") * 3) % 11 - 5).cast("double").alias("b"))


# M1 to M7 on relations.

M_SQL = {
    "m1": f"WITH {E_SQL} SELECT v.vec_id AS row_id, round(coalesce(y, 0), 6) AS y FROM embeddings v LEFT JOIN (SELECT row_id, sum(val * (col + 1)) AS y FROM cells GROUP BY row_id) s ON s.row_id = v.vec_id",
    "m2": f"WITH {E_SQL} SELECT c.col::INT AS col, round(coalesce(y, 0), 6) AS y FROM range({COLS}) c(col) LEFT JOIN (SELECT col, sum(val * (row_id % 7 + 1)) AS y FROM cells GROUP BY col) s ON s.col = c.col",
    "m3": f"WITH {E_SQL} SELECT v.vec_id AS row_id, k.k::INT AS k, round(coalesce(y, 0), 6) AS y FROM embeddings v CROSS JOIN range({WIDTH}) k(k) LEFT JOIN (SELECT row_id, k, sum(val * ((col * 7 + k * 3) % 11 - 5)) AS y FROM cells, range({WIDTH}) b(k) GROUP BY row_id, k) s ON s.row_id = v.vec_id AND s.k = k.k",
    "m4": f"WITH {E_SQL} SELECT c.col::INT AS col, k.k::INT AS k, round(coalesce(y, 0), 6) AS y FROM range({COLS}) c(col) CROSS JOIN range({WIDTH}) k(k) LEFT JOIN (SELECT col, k, sum(val * ((row_id * 7 + k * 3) % 11 - 5)) AS y FROM cells, range({WIDTH}) b(k) GROUP BY col, k) s ON s.col = c.col AND s.k = k.k",
    "m5": f"WITH {E_SQL} SELECT row_id, col::INT AS col, val * 3 AS val FROM cells",
    "m6": f"WITH {E_SQL} SELECT row_id, col::INT AS col, val * val AS val FROM cells",
    "m7": f"WITH {E_SQL} SELECT round(sum(val), 6) AS total FROM cells",
}


@query(M_SQL["m1"])
def m1_matvec(spark, sf_dir):
    return rounded(linalg.matvec(e_cells(spark, sf_dir), e_ids(spark, sf_dir), _vector(spark, COLS)), "y")


@query(M_SQL["m1"].replace(f" WHERE abs(embedding[i]::DOUBLE) > {EPS}", ""))
def m1_matvec_array(spark, sf_dir):
    return e_rows(spark, sf_dir).select("row_id", F.round(linalg.dot(F.col("dense"), [c + 1 for c in range(COLS)]), 6).alias("y"))


@query(M_SQL["m2"])
def m2_vecmat(spark, sf_dir):
    return rounded(linalg.vecmat(e_cells(spark, sf_dir), _row_vector(e_ids(spark, sf_dir)), COLS), "y")


@query(M_SQL["m3"])
def m3_matmul(spark, sf_dir):
    other = _other(spark.range(COLS).select(F.col("id").cast("int").alias("col")), "col")
    return rounded(linalg.matmul(e_cells(spark, sf_dir), e_ids(spark, sf_dir), other, WIDTH), "y")


@query(M_SQL["m3"].replace(f" WHERE abs(embedding[i]::DOUBLE) > {EPS}", ""))
def m3_matmul_array(spark, sf_dir):
    y = linalg.dense_matmul(e_rows(spark, sf_dir), other_matrix(np.arange(COLS)))
    return rounded(y.select("row_id", F.posexplode("y").alias("k", "y")), "y")


@query(M_SQL["m4"])
def m4_tmatmul(spark, sf_dir):
    return rounded(linalg.transposed_matmul(e_cells(spark, sf_dir), _other(e_ids(spark, sf_dir), "row_id"), COLS, WIDTH), "y")


@query(f"WITH {L_SQL} SELECT row_id, col::INT AS col, val * 3 AS val FROM l_cells")
def m5_scale(spark, sf_dir):
    return linalg.scale(l_cells(spark, sf_dir), 3)


@query(f"WITH {L_SQL} SELECT row_id, col::INT AS col, val * val AS val FROM l_cells")
def m6_square(spark, sf_dir):
    return linalg.square(l_cells(spark, sf_dir))


@query(f"WITH {L_SQL} SELECT sum(val::DECIMAL(18,4))::DOUBLE AS total FROM l_cells")
def m7_sum(spark, sf_dir):
    exact = l_cells(spark, sf_dir).select(F.col("val").cast("decimal(18,4)").alias("val"))
    return exact.agg(F.coalesce(F.sum("val").cast("double"), F.lit(0.0)).alias("total"))


# The same on encoded batches, in every format.


def e_batches(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return linalg.encode_batches(batching.contiguous(e_rows(spark, sf_dir), SIZE), name, COLS)


def _encoded(name: str) -> dict[str, Query]:
    on = lambda f, *a: lambda spark, sf_dir: f(e_batches(spark, sf_dir, name), name, SIZE, *a)
    return {
        "m1": lambda s, d: rounded(on(linalg.encoded_matvec, np.arange(COLS) + 1.0)(s, d), "y"),
        "m2": lambda s, d: rounded(on(linalg.encoded_vecmat, lambda r: r % 7 + 1.0)(s, d), "y"),
        "m3": lambda s, d: rounded(on(linalg.encoded_matmul, other_matrix(np.arange(COLS)))(s, d), "y"),
        "m4": lambda s, d: rounded(on(linalg.encoded_transposed_matmul, other_matrix)(s, d), "y"),
        "m5": on(linalg.encoded_scale, 3),
        "m6": on(linalg.encoded_square),
        "m7": lambda s, d: rounded(on(linalg.encoded_total)(s, d), "total"),
    }


for _name in FORMATS:
    _short = {"logicalfoc": "logical"}.get(_name, _name)
    for _op, _f in _encoded(_name).items():
        _add(f"{_op}_{_short}", _f, M_SQL[_op])
    _add(f"roundtrip_{_short}", lambda s, d, n=_name: linalg.decoded_cells(e_batches(s, d, n), n, SIZE), f"WITH {E_SQL} SELECT row_id, col::INT AS col, val FROM cells")


# Sources.


@query(f"SELECT l_linenumber::INT AS label, [{', '.join(f'{c}::DOUBLE' for c in L_COLUMNS[:4])}] AS dense FROM lineitem")
def s2_csv_scan(spark, sf_dir):
    path = scratch_path(spark)
    read_table(spark, sf_dir, "lineitem").select(F.concat_ws(",", *[F.col(c).cast("string") for c in L_COLUMNS])).write.text(path)
    return text.check_widths(text.read_csv(spark, path, label_index=4)).select("label", "dense")


@query("SELECT least(100, count(*)) AS n, 5 AS width FROM lineitem")
def s3_csv_limit(spark, sf_dir):
    path = scratch_path(spark)
    read_table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in L_COLUMNS])).write.text(path)
    return text.read_csv(spark, path, read_rows=100).agg(F.count("*").alias("n"), F.max(F.size("dense")).alias("width"))


@query(f"WITH {E_SQL} SELECT e.label, col::INT AS col, val FROM cells JOIN embeddings e ON e.vec_id = row_id WHERE col < 60")
def s4_libsvm_scan(spark, sf_dir):
    path = scratch_path(spark)
    pairs = F.array_join(F.transform("cells", lambda c: F.concat(c["col"].cast("string"), F.lit(":"), c["val"].cast("string"))), " ")
    e_rows(spark, sf_dir).select(F.concat_ws(" ", F.col("label").cast("string"), pairs)).write.text(path)
    return text.read_libsvm(spark, path, num_columns=60).select("label", F.inline("cells"))


_DRAW = "(floor(((({x}) * 1103515245 + 12345) % 2147483648) / 65536))"
_DRAW_WIDE = f"({_DRAW} * 32768 + {_DRAW.replace('{x}', '{x} + 7919')})"


@query(f"SELECT vec_id AS row_id, ({_DRAW.format(x='vec_id')} % 2)::INT AS label FROM embeddings")
def s6_random_labels(spark, sf_dir):
    return e_ids(spark, sf_dir).select("row_id", (draw(F.col("row_id")) % 2).cast("int").alias("label"))


@query("SELECT count(*) AS num_rows, max(len(embedding))::INT AS num_cols, sum(label)::BIGINT AS labels FROM embeddings")
def s7_accessors(spark, sf_dir):
    reader = text.Reader(e_rows(spark, sf_dir))
    return reader.rows.agg(F.count("*").alias("num_rows"), F.max(F.size("dense")).alias("num_cols"), F.sum("label").alias("labels"))


def _generated(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return jobs.generate(e_rows(spark, sf_dir), jobs.GenerateConfig(format=name, batch_size=SIZE, batches_per_shard=1, end_shard=None, scale=0.0, num_cols=COLS, check=True))


@query(f"WITH {E_SQL} SELECT row_id, col::INT AS col, val FROM cells WHERE row_id >= {SIZE}")
def s8_shard_table(spark, sf_dir):
    path = scratch_path(spark)
    shards.write_shards(_generated(spark, sf_dir, "csr"), path, "csr")
    return linalg.decoded_cells(shards.read_shards(spark, path, "csr", start=1), "csr", SIZE)


@query(f"WITH {E_SQL} SELECT row_id, col::INT AS col, val FROM cells")
def s9_shard_files(spark, sf_dir):
    """Shards written as files of the length-prefixed layout, `file-<i>.toc`, and read back."""
    path = scratch_path(spark)
    shards.save_shard_files(_generated(spark, sf_dir, "toc"), path, "toc")
    back = shards.read_shard_files(spark, f"{path}/file-*.toc").withColumn("batch_id", F.col("shard_id").cast("long") + F.col("batch_id"))
    return linalg.decoded_cells(back, "toc", SIZE)


# Batching.


@query(f"SELECT x // {SIZE} AS batch_id, x % {SIZE} AS row_in_batch, ({_DRAW_WIDE.format(x='x')} % (SELECT count(*) FROM embeddings))::BIGINT AS row_id FROM range({4 * SIZE}) t(x)")
def b1_sample(spark, sf_dir):
    ids = e_ids(spark, sf_dir)
    return batching.with_replacement(ids, SIZE, 4, ids.count()).select("batch_id", "row_in_batch", "row_id")


@query(f"SELECT vec_id AS row_id, label, vec_id // {SIZE} AS batch_id, vec_id % {SIZE} AS row_in_batch FROM embeddings")
def b2_batches(spark, sf_dir):
    return batching.contiguous(e_rows(spark, sf_dir), SIZE).select("row_id", "label", "batch_id", "row_in_batch")


@query(f"WITH {L_SQL} SELECT row_id, col::INT AS col, val FROM l_cells")
def b3_nonzero(spark, sf_dir):
    return l_cells(spark, sf_dir)


_DENSE = f"SELECT vec_id AS row_id, (i - 1)::INT AS col, embedding[i]::DOUBLE AS val FROM (SELECT vec_id, embedding, unnest(range(1, {COLS + 1})) AS i FROM embeddings)"


@query(f"SELECT row_id, col, CASE WHEN abs(val) > 0.1 THEN val ELSE 0 END AS val FROM ({_DENSE})")
def b4_densify(spark, sf_dir):
    few = e_rows(spark, sf_dir).select("row_id", batching.nonzero(F.col("dense"), 0.1).alias("cells"))
    return few.select("row_id", F.posexplode(batching.densify(F.col("cells"), COLS)).alias("col", "val"))


@query(f"SELECT row_id, (CASE WHEN col > 3 THEN col - 1 ELSE col END)::INT AS col, val FROM ({_DENSE}) WHERE col <> 3")
def b5_column_drop(spark, sf_dir):
    return e_rows(spark, sf_dir).select("row_id", F.posexplode(batching.drop_column(F.col("dense"), 3)).alias("col", "val"))


@query(f"SELECT row_id, col, val * (1.0::DOUBLE / 256) AS val FROM ({_DENSE})")
def b6_scale(spark, sf_dir):
    return e_rows(spark, sf_dir).select("row_id", F.posexplode(batching.scale_dense(F.col("dense"), 1 / 256)).alias("col", "val"))


@query(f"WITH {E_SQL} SELECT row_id, col::INT AS col, val * (1.0::DOUBLE / 256) AS val FROM cells")
def b7_scale_sparse(spark, sf_dir):
    return e_rows(spark, sf_dir).select("row_id", F.inline(batching.scale_sparse(F.col("cells"), 1 / 256)))


@query(f"SELECT vec_id AS row_id, (vec_id // 100)::INT AS shard_id FROM embeddings WHERE vec_id // 100 >= 1 AND vec_id // 100 < 3")
def b8_shard_range(spark, sf_dir):
    return batching.shard_range(e_ids(spark, sf_dir).withColumn("shard_id", F.floor(F.col("row_id") / 100).cast("int")), 1, 3)


# Dictionaries, widths, sizes, LZW.


def _l_batches(cells: DataFrame) -> DataFrame:
    return batching.contiguous(cells, SIZE)


def _dictionary_sql(table: str, key: str) -> str:
    return f"""WITH {L_SQL}, f AS (SELECT row_id // {SIZE} AS batch_id, {key}, min((row_id % {SIZE}) * 5 + col) AS p FROM {table} GROUP BY ALL)
SELECT batch_id, {key}, (row_number() OVER (PARTITION BY batch_id ORDER BY p) - 1)::INT AS value_id FROM f"""


@query(_dictionary_sql("l_cells", "val"))
def h1_value_dict(spark, sf_dir):
    return dictionaries.value_dictionary(_l_batches(l_cells(spark, sf_dir)), ["batch_id"], ["row_in_batch", "col"], ["val"])


@query(_dictionary_sql("l_all", "val"))
def h2_dense_dict(spark, sf_dir):
    return dictionaries.value_dictionary(_l_batches(l_dense_cells(spark, sf_dir)), ["batch_id"], ["row_in_batch", "col"], ["val"])


@query(_dictionary_sql("l_cells", "col::INT AS col, val").replace("SELECT batch_id, col::INT AS col, val,", "SELECT batch_id, col, val,"))
def h9_init_pairs(spark, sf_dir):
    return dictionaries.value_dictionary(_l_batches(l_cells(spark, sf_dir)), ["batch_id"], ["row_in_batch", "col"], ["col", "val"])


_WIDTH = "CASE WHEN {n} < 256 THEN 1 WHEN {n} < 65536 THEN 2 WHEN {n} < 16777216 THEN 3 ELSE 4 END"


@query(f"WITH {L_SQL} SELECT row_id // {SIZE} AS batch_id, count(DISTINCT val) AS n, ({_WIDTH.format(n='count(DISTINCT val)')})::INT AS width FROM l_cells GROUP BY 1")
def h3_width(spark, sf_dir):
    n = _l_batches(l_cells(spark, sf_dir)).groupBy("batch_id").agg(F.countDistinct("val").alias("n"))
    return n.withColumn("width", byte_width(F.col("n")))


@query(f"WITH {L_SQL} SELECT row_id // {SIZE} AS batch_id, count(*) AS num_elements, max(col)::INT AS max_element FROM l_cells GROUP BY 1")
def h5_ragged_counts(spark, sf_dir):
    rows = _l_batches(l_rows(spark, sf_dir)).select("batch_id", F.transform("cells", lambda c: c["col"]).alias("codes"))
    return dictionaries.ragged_counts(rows, ["batch_id"])


@query(f"WITH {L_SQL} SELECT row_id // {SIZE} AS batch_id, row_id % {SIZE} AS row_in_batch, col::INT AS col, val FROM l_cells")
def h7_lookup(spark, sf_dir):
    cells = _l_batches(l_cells(spark, sf_dir))
    table = dictionaries.value_dictionary(cells, ["batch_id"], ["row_in_batch", "col"], ["val"])
    ids = cells.join(table, ["batch_id", "val"]).select("batch_id", "row_in_batch", "col", "value_id")
    return dictionaries.lookup(ids, table, ["batch_id"]).select("batch_id", "row_in_batch", "col", "val")


def _size_sql(bytes_: str) -> str:
    return f"""WITH {L_SQL}, d AS (SELECT row_id // {SIZE} AS batch_id, count(*) // 5 AS r, count(DISTINCT val) AS vd FROM l_all GROUP BY 1),
s AS (SELECT row_id // {SIZE} AS batch_id, count(*) AS nnz, count(DISTINCT val) AS v FROM l_cells GROUP BY 1)
SELECT batch_id, ({bytes_})::BIGINT AS bytes FROM d JOIN s USING (batch_id)"""


def _sizes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Bytes of each batch by aggregation alone, without encoding."""
    cells = _l_batches(l_dense_cells(spark, sf_dir))
    kept = F.abs("val") > EPS
    if name == "mat":
        g = cells.groupBy("batch_id").agg((F.count("*") / 5).cast("long").alias("r"))
        return g.select("batch_id", (8 + 8 * F.col("r") * 5).alias("bytes"))
    if name == "dvi":
        g = cells.groupBy("batch_id").agg((F.count("*") / 5).cast("long").alias("r"), F.countDistinct("val").alias("v"))
        return g.select("batch_id", (13 + byte_width(F.col("v")) * F.col("r") * 5 + 8 * F.col("v")).alias("bytes"))
    g = cells.groupBy("batch_id").agg((F.count("*") / 5).cast("long").alias("r"), F.count(F.when(kept, 1)).alias("nnz"), F.countDistinct(F.when(kept, F.col("val"))).alias("v"))
    if name == "csr":
        return g.select("batch_id", (8 + 4 * F.col("r") + 12 * F.col("nnz")).alias("bytes"))
    return g.select("batch_id", (13 + 4 * F.col("r") + 4 * F.col("nnz") + byte_width(F.col("v")) * F.col("nnz") + 8 * F.col("v")).alias("bytes"))


_SIZES = {
    "mat": "8 + 8 * r * 5",
    "csr": "8 + 4 * r + 12 * nnz",
    "csrvi": f"13 + 4 * r + 4 * nnz + ({_WIDTH.format(n='v')}) * nnz + 8 * v",
    "dvi": f"13 + ({_WIDTH.format(n='vd')}) * r * 5 + 8 * vd",
}


def _encoded_sizes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = batching.contiguous(l_rows(spark, sf_dir).withColumn("label", F.lit(0)), SIZE)
    return linalg.encode_batches(rows, name, 5).select("batch_id", F.octet_length("payload").cast("long").alias("bytes"))


for _name, _sql in _SIZES.items():
    _add(f"size_{_name}", lambda s, d, n=_name: _sizes(s, d, n), _size_sql(_sql))
    _add(f"bytes_{_name}", lambda s, d, n=_name: _encoded_sizes(s, d, n), _size_sql(_sql))


def _stored(spark: SparkSession, sf_dir: str, name: str, schema: str, figures: Callable[[bytes], tuple]) -> DataFrame:
    """batch_id and figures of each batch of L as stored."""
    import pyarrow as pa

    names = ["batch_id", *(f.split()[0] for f in schema.split(", "))]

    def run(it):
        for b in it:
            got = [figures(x) for x in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("batch_id"), *(pa.array(x) for x in zip(*got))], names) if got else b.select([])

    rows = batching.contiguous(l_rows(spark, sf_dir).withColumn("label", F.lit(0)), SIZE)
    return linalg.encode_batches(rows, name, 5).select("batch_id", "payload").mapInArrow(run, f"batch_id long, {schema}")


_CODED_SQL = _size_sql("0").replace("(0)::BIGINT AS bytes", "{}").replace("), d AS", "), pr AS (SELECT batch_id, count(*) AS p FROM (SELECT DISTINCT row_id // {0} AS batch_id, col, val FROM l_cells) GROUP BY 1), d AS".format(SIZE)) + " JOIN pr USING (batch_id)"


@query(_CODED_SQL.format("(16 + 12 * p + 4 * r)::BIGINT AS bytes, p AS made"))
def size_logical(spark, sf_dir):
    """Bytes of each batch without its codes, and the nodes that its codes do not account for: every code but a row's last
    makes one, so these are the initial pairs."""

    def figures(data: bytes) -> tuple:
        m = codec("logicalfoc").read(data)
        return len(data) - 4 * len(m.codes), int(m.num_nodes - len(m.codes) + (m.sizes > 0).sum())

    return _stored(spark, sf_dir, "logicalfoc", "bytes long, made long", figures)


@query(_CODED_SQL.format(f"(24 + p + ({_WIDTH.format(n='v')}) * p + 8 * v + r)::BIGINT AS bytes, p AS made"))
def size_toc(spark, sf_dir):
    """The same for packed batches, whose codes have the width of the largest."""

    def figures(data: bytes) -> tuple:
        m = codec("toc").read(data)
        return len(data) - byte_width_of(int(m.codes.max(initial=0))) * len(m.codes), int(m.num_nodes - len(m.codes) + (m.sizes > 0).sum())

    return _stored(spark, sf_dir, "toc", "bytes long, made long", figures)


def _inflated_sql(total: str) -> str:
    return _size_sql("0").replace("(0)::BIGINT AS bytes", "(8 + 8 * r * 5)::BIGINT AS bytes, round(total, 4) AS total, true AS smaller").replace("AS r, count(DISTINCT val) AS vd", f"AS r, {total} AS total, count(DISTINCT val) AS vd")


@query(_inflated_sql("sum(val)"))
def size_gzip(spark, sf_dir):
    """Bytes of each batch when inflated, the sum of its cells, and whether it is stored in fewer bytes."""
    import zlib

    def figures(data: bytes) -> tuple:
        raw = zlib.decompress(data, 31)
        return len(raw), round(float(codec("mat").read(raw).total()), 4), len(data) < len(raw)

    return _stored(spark, sf_dir, "gzip", "bytes long, total double, smaller boolean", figures)


@query(_inflated_sql("sum(val)"))
def size_snappy(spark, sf_dir):
    def figures(data: bytes) -> tuple:
        m = codec("snappy").read(data)
        raw = 8 + 8 * m.rows * m.cols
        return raw, round(float(m.total()), 4), len(data) < raw

    return _stored(spark, sf_dir, "snappy", "bytes long, total double, smaller boolean", figures)


def _lzw_batches(spark: SparkSession, sf_dir: str, schema: str, of) -> DataFrame:
    """of(pairs, codes, nodes), a table, for each batch of L."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row_in_batch")
        made = of(*lzw.encode([[(c["col"], c["val"]) for c in r] for r in t.column("cells").to_pylist()]))
        made["batch_id"] = pa.array([t.column("batch_id")[0].as_py()] * len(next(iter(made.values()))), pa.int64())
        return pa.table({c.split()[0]: made[c.split()[0]] for c in schema.split(", ")})

    rows = batching.contiguous(l_rows(spark, sf_dir), SIZE).select("batch_id", "row_in_batch", "cells")
    return rows.groupBy("batch_id").applyInArrow(run, schema)


@query(f"WITH {L_SQL} SELECT row_id // {SIZE} AS batch_id, row_id % {SIZE} AS row_in_batch, col::INT AS col, val FROM l_cells")
def lzw_codes(spark, sf_dir):
    """The cells that codes and initial pairs of each batch of L stand for."""
    import pyarrow as pa

    def of(pairs, codes, nodes):
        rows = lzw.decode(pairs, codes)
        flat = [x for r in rows for x in r]
        return {"row_in_batch": pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64()), "col": pa.array([c for c, _ in flat], pa.int32()), "val": pa.array([v for _, v in flat], pa.float64())}

    return _lzw_batches(spark, sf_dir, "batch_id long, row_in_batch long, col int, val double", of)


@query(f"""WITH {L_SQL}, c AS (SELECT row_id // {SIZE} AS batch_id, count(*) AS cells, count(DISTINCT row_id) AS rows_ FROM l_cells GROUP BY 1)
SELECT batch_id, (SELECT count(*) FROM (SELECT DISTINCT col, val FROM l_cells x WHERE x.row_id // {SIZE} = c.batch_id)) AS initial, cells, rows_ AS used_rows, 0::BIGINT AS repeated, true AS greedy FROM c""")
def lzw_outputs(spark, sf_dir):
    """What the coder gives for each batch of L: initial pairs, cells that its codes unfold to, rows with codes, nodes that
    repeat another's pairs (none), and whether every code but a row's last is a longest match: with the pair after it, it
    is no node made before."""
    import pyarrow as pa

    def of(pairs, codes, nodes):
        initial = len(pairs)
        paths = [(i,) for i in range(initial)]
        known, greedy, cells = set(paths), True, 0
        for row in codes:
            if row and row[0] >= len(paths):
                greedy = False
                break
            for code, after in zip(row, row[1:]):
                grown = (*paths[code], paths[after][0] if after < len(paths) else paths[code][0])
                greedy &= grown not in known
                paths.append(grown)
                known.add(grown)
            cells += sum(len(paths[c]) for c in row)
        greedy &= len(paths) == nodes
        figures = {"initial": initial, "cells": cells, "used_rows": sum(bool(r) for r in codes), "repeated": len(paths) - len(set(paths))}
        return {k: pa.array([v], pa.int64()) for k, v in figures.items()} | {"greedy": pa.array([greedy])}

    return _lzw_batches(spark, sf_dir, "batch_id long, initial long, cells long, used_rows long, repeated long, greedy boolean", of)


# The perceptron, with closed weights.

_W1 = "((({i}) * 7 + ({k}) * 3) % 11 - 5) / 10.0::DOUBLE"
_B1 = "(({k}) * 5 % 7 - 3) / 10.0::DOUBLE"
_W2 = "((({i}) * 5 + ({k}) * 7) % 13 - 6) / 10.0::DOUBLE"
_B2 = "(({k}) * 3 % 5 - 2) / 10.0::DOUBLE"
MLP_SQL = f"""WITH {E_SQL},
z1 AS (SELECT row_id, k, sum(val * {_W1.format(i='col', k='k')}) + {_B1.format(k='k')} AS z FROM cells, range({HIDDEN}) t(k) GROUP BY row_id, k),
h AS (SELECT row_id, k, 1 / (1 + exp(-z)) AS out FROM z1),
z2 AS (SELECT row_id, t.k AS k, sum(out * {_W2.format(i='h.k', k='t.k')}) + {_B2.format(k='t.k')} AS z FROM h, range({OUTPUTS}) t(k) GROUP BY row_id, t.k),
x AS (SELECT row_id, k, exp(z - max(z) OVER (PARTITION BY row_id)) AS e FROM z2),
p AS (SELECT row_id, k, e / sum(e) OVER (PARTITION BY row_id) AS out FROM x),
err AS (SELECT p.row_id, p.k, p.out - (e.label = p.k)::INT AS err FROM p JOIN embeddings e ON e.vec_id = p.row_id)
"""


def _closed(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    def table(n: int, m: int, w) -> DataFrame:
        return spark.range(n).select(F.col("id").cast("int").alias("col"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k")).select("col", "k", w(F.col("col"), F.col("k")).alias("b"))

    def offsets(m: int, o) -> DataFrame:
        return spark.range(m).select(F.col("id").cast("int").alias("k"), o(F.col("id")).alias("o"))

    return (
        table(COLS, HIDDEN, lambda i, k: ((i * 7 + k * 3) % 11 - 5) / 10),
        offsets(HIDDEN, lambda k: ((k * 5) % 7 - 3) / 10),
        table(HIDDEN, OUTPUTS, lambda i, k: ((i * 5 + k * 7) % 13 - 6) / 10),
        offsets(OUTPUTS, lambda k: ((k * 3) % 5 - 2) / 10),
    )


class _Net:
    """The forward pass and errors of the closed network over rows of E, as relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.cells, self.ids = e_cells(spark, sf_dir), e_ids(spark, sf_dir)
        self.labels = e_rows(spark, sf_dir).select("row_id", "label")
        self.w1, self.b1, self.w2, self.b2 = _closed(spark)
        self.hidden = mlp.hidden(mlp.layer(self.cells, self.ids, self.w1, self.b1, HIDDEN))
        self.out = mlp.softmax(mlp.layer(mlp.as_cells(self.hidden), self.ids, self.w2, self.b2, OUTPUTS))
        self.err = mlp.output_errors(self.out, self.labels)


@query(f"SELECT vec_id AS row_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS y FROM embeddings")
def n3_sigmoid(spark, sf_dir):
    return rounded(e_rows(spark, sf_dir).select("row_id", sigmoid(F.get("dense", F.lit(0))).alias("y")), "y")


@query(MLP_SQL + "SELECT row_id, k::INT AS k, round(out, 6) AS out FROM h")
def n2_hidden(spark, sf_dir):
    return rounded(_Net(spark, sf_dir).hidden, "out")


@query(MLP_SQL + "SELECT row_id, k::INT AS k, round(out, 6) AS out FROM p")
def n4_softmax(spark, sf_dir):
    return rounded(_Net(spark, sf_dir).out, "out")


def _closed_model() -> mlp.Mlp:
    m = mlp.Mlp([COLS, HIDDEN, OUTPUTS], RATE)
    i, k = np.arange(COLS)[:, None], np.arange(HIDDEN)
    j, o = np.arange(HIDDEN)[:, None], np.arange(OUTPUTS)
    m.weights = [((i * 7 + k * 3) % 11 - 5) / 10, ((j * 5 + o * 7) % 13 - 6) / 10]
    m.offsets = [(k * 5 % 7 - 3) / 10, (o * 3 % 5 - 2) / 10]
    return m


@query(MLP_SQL + "SELECT row_id, k::INT AS k, round(out, 6) AS out FROM p")
def n5_forward_encoded(spark, sf_dir):
    """The forward pass on batches as stored."""
    model = _closed_model()

    def apply(batch, first):
        p = model.forward(batch)[-1]
        r, k = np.divmod(np.arange(p.size), OUTPUTS)
        return {"row_id": first + r, "k": k.astype(np.int32), "out": p.reshape(-1)}

    return rounded(linalg.on_encoded(e_batches(spark, sf_dir, "toc"), "toc", SIZE, apply, "row_id long, k int, out double"), "out")


@query(MLP_SQL + "SELECT row_id, k::INT AS k, round(err, 6) AS err FROM err")
def n6_error(spark, sf_dir):
    return rounded(_Net(spark, sf_dir).err, "err")


# Steps of every batch of the table, each from the closed weights.

_EACH = f""",
ids AS (SELECT vec_id AS row_id, vec_id // {SIZE} AS batch_id FROM embeddings),
errb AS (SELECT * FROM err JOIN ids USING (row_id)),
nb AS (SELECT batch_id, count(*) AS n FROM ids GROUP BY batch_id),
g2b AS (SELECT batch_id, h.k AS i, errb.k, sum(h.out * errb.err) AS g FROM h JOIN errb USING (row_id) GROUP BY batch_id, h.k, errb.k),
w2b AS (SELECT batch_id, i, k, {_W2.format(i='i', k='k')} - g * ({RATE} / n) AS w FROM g2b JOIN nb USING (batch_id)),
bpb AS (SELECT errb.batch_id, errb.row_id, w2b.i AS k, sum(errb.err * w2b.w) AS e FROM errb JOIN w2b ON w2b.batch_id = errb.batch_id AND w2b.k = errb.k GROUP BY errb.batch_id, errb.row_id, w2b.i),
ehb AS (SELECT bpb.batch_id, bpb.row_id, bpb.k, e * out * (1 - out) AS err FROM bpb JOIN h ON h.row_id = bpb.row_id AND h.k = bpb.k),
g1b AS (SELECT batch_id, col AS i, ehb.k, sum(val * err) AS g FROM cells JOIN ehb USING (row_id) GROUP BY batch_id, col, ehb.k)
"""
_BY = ("batch_id",)


def _each_batch(net: _Net) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Errors with their batch; updated weights of the last layer, errors that pass through them, updated weights of the first, by batch."""
    err = net.err.withColumn("batch_id", F.floor(F.col("row_id") / SIZE))
    sizes = batching.contiguous(net.ids, SIZE).groupBy("batch_id").agg(F.count("*").alias("n"))

    def step(weights: DataFrame, gradient: DataFrame) -> DataFrame:
        return mlp.updated(sizes.crossJoin(weights), gradient, ["batch_id", "col", "k"], "b", RATE, F.col("n"))

    w2 = step(net.w2, mlp.weight_gradient(mlp.as_cells(net.hidden), err, _BY))
    eh = mlp.back(err, w2, net.hidden, _BY)
    return err, w2, eh, step(net.w1, mlp.weight_gradient(net.cells, eh, _BY))


@query(MLP_SQL + _EACH + "SELECT batch_id, i::INT AS col, k::INT AS k, round(g, 6) AS g FROM g2b")
def n7_grad_w(spark, sf_dir):
    net = _Net(spark, sf_dir)
    return rounded(mlp.weight_gradient(mlp.as_cells(net.hidden), _each_batch(net)[0], _BY), "g")


@query(MLP_SQL + _EACH + "SELECT batch_id, k::INT AS k, round(sum(err), 6) AS g FROM errb GROUP BY batch_id, k")
def n7_grad_b(spark, sf_dir):
    return rounded(mlp.offset_gradient(_each_batch(_Net(spark, sf_dir))[0], _BY), "g")


@query(MLP_SQL + _EACH + "SELECT batch_id, row_id, k::INT AS k, round(err, 6) AS err FROM ehb")
def n8_backprop(spark, sf_dir):
    return rounded(_each_batch(_Net(spark, sf_dir))[2], "err")


_N9_EACH = (
    MLP_SQL
    + _EACH
    + f"""SELECT nb.batch_id, 1 AS layer, c.i::INT AS col, t.k::INT AS k, round({_W1.format(i='c.i', k='t.k')} - coalesce(g, 0) * ({RATE} / n), 6) AS w
FROM nb CROSS JOIN range({COLS}) c(i) CROSS JOIN range({HIDDEN}) t(k) LEFT JOIN g1b ON g1b.batch_id = nb.batch_id AND g1b.i = c.i AND g1b.k = t.k
UNION ALL SELECT batch_id, 2, i::INT, k::INT, round(w, 6) FROM w2b"""
)


@query(_N9_EACH)
def n9_step(spark, sf_dir):
    _, w2, _, w1 = _each_batch(_Net(spark, sf_dir))
    both = w1.select("batch_id", F.lit(1).alias("layer"), "col", "k", F.col("b").alias("w")).unionAll(w2.select("batch_id", F.lit(2), "col", "k", "b"))
    return rounded(both, "w")


@query(_N9_EACH)
def n9_step_encoded(spark, sf_dir):
    """The same steps by the trainer, on every batch as stored."""
    import pyarrow as pa

    model, cls = _closed_model(), codec("toc")

    def run(it):
        for b in it:
            for batch_id, payload, labels in zip(*(b.column(c).to_pylist() for c in ("batch_id", "payload", "labels"))):
                own = mlp.Mlp([COLS, HIDDEN, OUTPUTS], RATE)
                own.weights, own.offsets = list(model.weights), list(model.offsets)
                own.step(cls.read(payload), np.array(labels))
                for n, w in enumerate(own.weights):
                    i, k = np.divmod(np.arange(w.size, dtype=np.int32), np.int32(w.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array([batch_id] * w.size, pa.int64()), pa.array([n + 1] * w.size, pa.int32()), pa.array(i), pa.array(k), pa.array(w.reshape(-1))], ["batch_id", "layer", "col", "k", "w"])

    made = e_batches(spark, sf_dir, "toc").select("batch_id", "payload", "labels")
    return rounded(made.mapInArrow(run, "batch_id long, layer int, col int, k int, w double"), "w")


@query(MLP_SQL + f"SELECT round(sum(0.5 * err * err) / (SELECT count(*) FROM embeddings) / {OUTPUTS}, 6) AS loss FROM err")
def n10_loss(spark, sf_dir):
    net = _Net(spark, sf_dir)
    return rounded(mlp.loss(net.err, net.ids.count(), OUTPUTS), "loss")


@query(MLP_SQL + "SELECT round(avg((b.k = e.label)::INT), 6) AS accuracy FROM (SELECT row_id, k, row_number() OVER (PARTITION BY row_id ORDER BY out DESC, k) AS r FROM p) b JOIN embeddings e ON e.vec_id = b.row_id WHERE r = 1")
def n11_accuracy(spark, sf_dir):
    net = _Net(spark, sf_dir)
    return rounded(mlp.accuracy(net.out, net.labels), "accuracy")


# Jobs.


@query(f"SELECT (vec_id // {SIZE})::INT AS shard_id, vec_id // {SIZE} AS batch_id, count(*)::INT AS num_rows, sum(label)::BIGINT AS labels FROM embeddings GROUP BY 1, 2")
def j7_generate(spark, sf_dir):
    made = _generated(spark, sf_dir, "toc")
    return made.select("shard_id", "batch_id", "num_rows", F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))


# Training: QUARTERS batches an epoch, two a shard, from the closed weights.

QUARTERS, EPOCHS = 4, 2


def _training_sql(epochs: int) -> str:
    """The steps one after another, each a few tables, and after each shard loss and accuracy over all rows."""
    cut = f"{E_SQL}, n AS (SELECT greatest(1, (count(*) + {QUARTERS - 1}) // {QUARTERS}) AS n, count(*) AS every FROM embeddings), ids AS (SELECT vec_id AS row_id, label, vec_id // n AS batch FROM embeddings, n)"
    parts = [
        f"WITH {cut}",
        f"w1_0 AS (SELECT i, k, {_W1.format(i='i', k='k')} AS w FROM range({COLS}) a(i), range({HIDDEN}) b(k))",
        f"b1_0 AS (SELECT k, {_B1.format(k='k')} AS w FROM range({HIDDEN}) b(k))",
        f"w2_0 AS (SELECT i, k, {_W2.format(i='i', k='k')} AS w FROM range({HIDDEN}) a(i), range({OUTPUTS}) b(k))",
        f"b2_0 AS (SELECT k, {_B2.format(k='k')} AS w FROM range({OUTPUTS}) b(k))",
    ]

    def forward(name: str, s: int, rows: str) -> None:
        parts.extend(
            [
                f"h{name} AS MATERIALIZED (SELECT x.row_id, b.k, 1 / (1 + exp(-(coalesce(z, 0) + b.w))) AS out FROM ({rows}) x CROSS JOIN b1_{s} b LEFT JOIN (SELECT c.row_id, w.k, sum(c.val * w.w) AS z FROM cells c JOIN ({rows}) y USING (row_id) JOIN w1_{s} w ON w.i = c.col GROUP BY c.row_id, w.k) m ON m.row_id = x.row_id AND m.k = b.k)",
                f"z{name} AS (SELECT h.row_id, w.k, sum(h.out * w.w) + any_value(b.w) AS z FROM h{name} h JOIN w2_{s} w ON w.i = h.k JOIN b2_{s} b ON b.k = w.k GROUP BY h.row_id, w.k)",
                f"p{name} AS (SELECT row_id, k, exp(z - max(z) OVER (PARTITION BY row_id)) AS e FROM z{name})",
                f"e{name} AS MATERIALIZED (SELECT p.row_id, p.k, e / sum(e) OVER (PARTITION BY p.row_id) AS out, e / sum(e) OVER (PARTITION BY p.row_id) - (label = p.k)::INT AS err FROM p{name} p JOIN ids USING (row_id))",
            ]
        )

    answers = []
    for s in range(epochs * QUARTERS):
        b = s % QUARTERS
        rows = f"SELECT row_id FROM ids WHERE batch = {b}"
        rate = f"({RATE} / greatest(1, (SELECT count(*) FROM ids WHERE batch = {b})))"
        forward(str(s), s, rows)
        parts += [
            f"w2_{s + 1} AS MATERIALIZED (SELECT w.i, w.k, w.w - coalesce(g, 0) * {rate} AS w FROM w2_{s} w LEFT JOIN (SELECT h.k AS i, e.k, sum(h.out * e.err) AS g FROM h{s} h JOIN e{s} e USING (row_id) GROUP BY h.k, e.k) g ON g.i = w.i AND g.k = w.k)",
            f"b2_{s + 1} AS MATERIALIZED (SELECT w.k, w.w - coalesce(g, 0) * {rate} AS w FROM b2_{s} w LEFT JOIN (SELECT k, sum(err) AS g FROM e{s} GROUP BY k) g USING (k))",
            f"d{s} AS MATERIALIZED (SELECT h.row_id, h.k, b.e * h.out * (1 - h.out) AS err FROM h{s} h JOIN (SELECT e.row_id, w.i AS k, sum(e.err * w.w) AS e FROM e{s} e JOIN w2_{s + 1} w ON w.k = e.k GROUP BY e.row_id, w.i) b ON b.row_id = h.row_id AND b.k = h.k)",
            f"w1_{s + 1} AS MATERIALIZED (SELECT w.i, w.k, w.w - coalesce(g, 0) * {rate} AS w FROM w1_{s} w LEFT JOIN (SELECT c.col AS i, d.k, sum(c.val * d.err) AS g FROM cells c JOIN d{s} d USING (row_id) GROUP BY c.col, d.k) g ON g.i = w.i AND g.k = w.k)",
            f"b1_{s + 1} AS MATERIALIZED (SELECT w.k, w.w - coalesce(g, 0) * {rate} AS w FROM b1_{s} w LEFT JOIN (SELECT k, sum(err) AS g FROM d{s} GROUP BY k) g USING (k))",
        ]
        if b % 2 or b == QUARTERS - 1:
            forward(f"t{s}", s + 1, "SELECT row_id FROM ids")
            right = f"SELECT avg((b.k = ids.label)::INT) FROM (SELECT row_id, k, row_number() OVER (PARTITION BY row_id ORDER BY out DESC, k) AS r FROM et{s}) b JOIN ids USING (row_id) WHERE r = 1"
            answers.append(f"SELECT {s // QUARTERS}::INT AS epoch, {b // 2}::INT AS shard, (SELECT count(DISTINCT batch) FROM ids WHERE batch // 2 = {b // 2})::INT AS batches, round(sum(0.5 * err * err) / (SELECT every FROM n) / {OUTPUTS}, 6) AS loss, round(({right}), 6) AS accuracy FROM et{s}")
    return ",\n".join(parts) + ", answers AS (" + " UNION ALL ".join(answers) + ") "


def _quarters(spark: SparkSession, sf_dir: str) -> tuple[jobs.GenerateConfig, jobs.TrainConfig]:
    size = max(1, -(-e_ids(spark, sf_dir).count() // QUARTERS))
    return (
        jobs.GenerateConfig(batch_size=size, batches_per_shard=2, end_shard=None, scale=0.0, num_cols=COLS),
        jobs.TrainConfig(hidden=(HIDDEN,), outputs=OUTPUTS, num_cols=COLS, epochs=EPOCHS, rate=RATE),
    )


_LOG = "epoch int, shard int, batches int, loss double, accuracy double"


def _figures(log: list[jobs.Timing]) -> list[tuple]:
    return [(t.epoch, int(t.shard), t.batches, round(t.loss, 6), round(t.accuracy, 6)) for t in log]


@query(_training_sql(EPOCHS) + "SELECT * FROM answers WHERE batches > 0")
def train_epochs(spark, sf_dir):
    """epoch, shard, batches, loss, accuracy of a training on stored shards, tested on all rows after each shard."""
    path = scratch_path(spark)
    generating, training = _quarters(spark, sf_dir)
    shards.write_shards(jobs.generate(e_rows(spark, sf_dir), generating), path, "toc")
    made = shards.read_shards(spark, path, "toc")
    _, log = jobs.train(made, training, model=_closed_model(), test=made)
    return spark.createDataFrame(_figures(log), _LOG)


@query(_training_sql(1) + "SELECT f.format, answers.* FROM answers, (SELECT unnest([" + ", ".join(f"'{x}'" for x in jobs.TRAINED) + "]) AS format) f WHERE batches > 0")
def j9_sweep(spark, sf_dir):
    """The same for one epoch, generated, stored and trained on in every format of the sweep."""
    generating, training = _quarters(spark, sf_dir)
    training.epochs = 1
    logs = jobs.sweep(e_rows(spark, sf_dir), scratch_path(spark), generating, training, model=_closed_model, test=True)
    return spark.createDataFrame([(name, *x) for name, log in logs.items() for x in _figures(log)], f"format string, {_LOG}")


@query("SELECT unnest([1, 2, 3])::INT AS layer, unnest([784, 200, 50])::INT AS inputs, unnest([200, 50, 10])::INT AS outputs, unnest([200, 50, 10])::INT AS offsets, true AS standard")
def n1_layers(spark, sf_dir):
    """Shapes of the default model's layers, and whether their weights look drawn from a standard normal distribution."""
    config = jobs.TrainConfig()
    m = mlp.Mlp([config.num_cols, *config.hidden, config.outputs], config.rate, config.seed)
    looks = lambda w: bool(abs(w.mean()) < 5 / np.sqrt(w.size) and abs(w.std() - 1) < 5 / np.sqrt(2 * w.size))
    return spark.createDataFrame([(i + 1, *w.shape, len(b), looks(w)) for i, (w, b) in enumerate(zip(m.weights, m.offsets))], "layer int, inputs int, outputs int, offsets int, standard boolean")


@query(f"WITH {E_SQL} SELECT (row_id // 100)::INT AS shard_id, e.label, col::INT AS col, val FROM cells JOIN embeddings e ON e.vec_id = row_id")
def s10_libsvm_shards(spark, sf_dir):
    """Rows written as one LIBSVM file a shard, `file-<i>.libsvm`, and read back with the shard's number from the name."""
    path = scratch_path(spark)
    text.write_libsvm_shards(e_rows(spark, sf_dir).withColumn("shard_id", F.floor(F.col("row_id") / 100).cast("int")), path)
    return text.read_libsvm_shards(spark, f"{path}/file-*.libsvm", COLS).select("shard_id", "label", F.inline("cells"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: a matrix product on batches encoded with the dictionary of shared runs."""
    return QUERIES["m3_toc"](spark, sf_dir)
