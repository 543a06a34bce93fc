"""Skew-safe ordered numbering.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a
key to one task; with one key holding a third of the data that task holds
a third of the data. ``running_count`` numbers rows per key without that. Keys
of up to ``HOT_ROWS`` rows are numbered by a plain window: one shuffle, whose
tasks are bounded by that many rows a key. Only the rows of larger keys go on:

1. a bounded random sample of the (key, order) columns -- about
   ``per_part`` rows per target partition, so its size is fixed by the
   partition count, not by the data -- gives range bounds, as a range
   partitioner would;
2. each row's chunk is the number of bounds at or below its (key, order)
   tuple, computed by a balanced binary-search ``CASE`` (a pure function
   of the row, so a lost task recomputes the same chunk); a hot key spans
   many chunks;
3. ``row_number`` over (key, chunk) numbers rows inside a chunk -- one
   shuffle, every partition bounded by a chunk;
4. row counts per (key, chunk), a partial aggregate, become offsets with a
   window over that small table (a key has at most one row per chunk);
5. the offsets join back on (key, chunk); the big side is already
   hash-partitioned on those columns, so only the small side moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def _parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _sort_key(row):
    # Spark orders NULL first, strings by code point (= UTF-8 bytes).
    return tuple((0, 0) if v is None else (1, v) for v in row)


def range_bounds(df: DataFrame, cols, partitions: int, per_part: int = 32,
                 seed: int = 7, count: int | None = None) -> list[tuple]:
    """Up to ``partitions - 1`` sorted bounds over ``cols`` from a sample of
    about ``per_part * partitions`` rows (bounded, independent of size)."""
    if partitions <= 1:
        return []
    n = df.count() if count is None else count
    if n <= per_part * partitions:
        return []  # small input: one chunk per key is already bounded
    frac = min(1.0, per_part * partitions / n)
    rows = df.select(*cols).sample(False, frac, seed).collect()
    # arrays (e.g. BFS order keys) become tuples: hashable, same ordering
    sample = sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows),
                    key=_sort_key)
    if not sample:
        return []
    out, seen = [], set()
    for k in range(1, partitions):
        b = sample[min(len(sample) - 1, k * len(sample) // partitions)]
        if b not in seen:
            seen.add(b)
            out.append(b)
    return sorted(out, key=_sort_key)


CASE_TREE_MAX = 64  # up to this many bounds: a CASE tree; above: array search


def chunk_of(df: DataFrame, cols, bounds: list[tuple]) -> Column:
    """Number of bounds <= struct(cols).

    Few bounds: a balanced binary-search CASE tree (codegen friendly). Many
    bounds (thousands of partitions on a cluster): the bounds are one array
    literal (parsed once from JSON and constant-folded) and a binary search
    of ceil(log2(n)) steps runs as an ``aggregate``, so the expression stays
    small whatever the partition count."""
    if not bounds:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    if len(bounds) > CASE_TREE_MAX:
        return _array_search(row, cols, types, bounds)

    def lit(b):
        return F.struct(*[F.lit(list(v) if isinstance(v, tuple) else v).cast(types[c]).alias(c)
                          for v, c in zip(b, cols)])

    def search(lo, hi):  # answer in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2  # is bounds[mid-1] <= row ?
        return F.when(row >= lit(bounds[mid - 1]), search(mid, hi)).otherwise(search(lo, mid - 1))

    return search(0, len(bounds))


def _array_search(row: Column, cols, types, bounds) -> Column:
    import datetime as _dt
    import json
    from pyspark.sql import types as T

    def enc(v):
        if isinstance(v, tuple):
            return [enc(x) for x in v]
        if isinstance(v, (_dt.datetime, _dt.date)):
            return v.isoformat()
        return v

    schema = T.ArrayType(T.StructType([T.StructField(c, types[c]) for c in cols]))
    payload = json.dumps([{c: enc(v) for c, v in zip(cols, b)} for b in bounds])
    arr = F.from_json(F.lit(payload), schema)
    n = len(bounds)
    steps = max(1, (n).bit_length())
    init = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(acc, _i):
        mid = ((acc.lo + acc.hi + 1) / 2).cast("int")
        go_up = F.element_at(arr, F.greatest(mid, F.lit(1))) <= row
        return F.when(acc.lo >= acc.hi, acc).otherwise(
            F.when(go_up, F.struct(mid.alias("lo"), acc.hi.alias("hi")))
             .otherwise(F.struct(acc.lo.alias("lo"), (mid - 1).alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc.lo)


#: A key with more rows than this is numbered by chunks.
HOT_ROWS = 500_000


def _same(a: DataFrame, b: DataFrame, cols, how: str) -> DataFrame:
    """``a`` joined to ``b`` on equal ``cols`` (null equals null), with ``b``'s other columns."""
    b = b.withColumnsRenamed({c: "_b_" + c for c in cols})
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col("_b_" + c))
    return a.join(b, on, how).drop(*["_b_" + c for c in cols])


def running_count(df: DataFrame, keys, order, out: str = "n",
                  partitions: int | None = None, per_part: int = 32,
                  cluster=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``out`` = 1-based rank of each row within its key, by ``order``.

    ``order`` must be a total order within a key (end it with a unique id).
    ``cluster`` (some of the keys) places the rows: a later count by those
    alone, in the order of the other keys and ``order``, moves and sorts nothing.
    """
    keys, order = list(keys), list(order)
    by = list(cluster or keys)
    hot = bounded_broadcast(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_hot")).filter(F.col("_hot") > hot_rows))

    def plain(rows):
        placed = rows.repartition(*by) if cluster else rows
        w = Window.partitionBy(*keys).orderBy(*order)
        return placed.withColumn(out, F.row_number().over(w).cast("long"))

    if hot.isEmpty():
        return plain(df)
    few = plain(_same(df, hot, by, "left_anti"))
    many = chunked_count(_same(df, hot.drop("_hot"), by, "left_semi"), keys, order, out, partitions, per_part)
    return few.unionByName(many)


def chunked_count(df: DataFrame, keys, order, out: str = "n",
                  partitions: int | None = None, per_part: int = 32,
                  count: int | None = None) -> DataFrame:
    """:func:`running_count` by chunks, whatever the size of the keys.
    ``count`` (the row count, if the caller knows it) saves one pass."""
    keys, order = list(keys), list(order)
    cols = keys + order
    p = _parts(df, partitions)
    bounds = range_bounds(df, cols, p, per_part, count=count)
    tagged = df.withColumn("_chunk", chunk_of(df, cols, bounds))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = tagged.withColumn("_local", F.row_number().over(w))
    if not bounds:
        return local.withColumn(out, F.col("_local").cast("long")).drop("_chunk", "_local")
    # summary from the windowed side: same shuffle (reused), no second pass
    # over the input; the window output is already clustered on (key, chunk)
    stats = local.groupBy(*keys, "_chunk").agg(F.max("_local").cast("long").alias("_cnt"))
    ws = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select(*keys, "_chunk", F.coalesce(F.sum("_cnt").over(ws), F.lit(0)).alias("_off"))
    return (_same(local, offs, keys + ["_chunk"], "inner")
                 .withColumn(out, (F.col("_local") + F.col("_off")).cast("long"))
                 .drop("_chunk", "_local", "_off"))


def global_rank(df: DataFrame, order, out: str = "n",
                partitions: int | None = None) -> DataFrame:
    """1-based rank over the whole table by ``order`` without a one-task
    window."""
    tmp = df.withColumn("_all", F.lit(0))
    return chunked_count(tmp, ["_all"], order, out=out, partitions=partitions).drop("_all")


def running_max(df: DataFrame, keys, order, values: dict, exclusive: bool = True,
                partitions: int | None = None, per_part: int = 32) -> DataFrame:
    """Adds, per output name, the running ``max`` of a value Column per key
    in ``order`` (rows strictly before the row when ``exclusive``), with
    the same chunking as :func:`running_count`: a window per (key, chunk)
    plus the carry-in from earlier chunks of the key (a small table)."""
    keys, order = list(keys), list(order)
    cols = keys + order
    p = _parts(df, partitions)
    bounds = range_bounds(df, cols, p, per_part)
    tagged = df.withColumn("_chunk", chunk_of(df, cols, bounds))
    for name, expr in values.items():
        tagged = tagged.withColumn("_v_" + name, expr)
    hi = -1 if exclusive else 0
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = tagged
    for name in values:
        local = local.withColumn("_l_" + name, F.max("_v_" + name).over(w))
    if not bounds:
        for name in values:
            local = local.withColumnRenamed("_l_" + name, name)
        return local.drop("_chunk", *["_v_" + n for n in values])
    stats = local.groupBy(*keys, "_chunk").agg(*[F.max("_v_" + n).alias("_m_" + n) for n in values])
    ws = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = stats.select(*keys, "_chunk", *[F.max("_m_" + n).over(ws).alias("_c_" + n) for n in values])
    out = local.join(carry, keys + ["_chunk"], "left")
    for name in values:
        out = out.withColumn(name, F.greatest(F.col("_l_" + name), F.col("_c_" + name)))
    return out.drop("_chunk", *[p + n for n in values for p in ("_v_", "_l_", "_c_")])


def running_sum(df: DataFrame, keys, order, values: dict, partitions: int | None = None, per_part: int = 32) -> DataFrame:
    """Adds, per output name, the running sum of a value Column (signed, nulls
    count 0) per key in ``order``, this row included: a window per (key, chunk)
    and the sums of the key's earlier chunks carried in (a small table)."""
    keys, order = list(keys), list(order)
    bounds = range_bounds(df, keys + order, _parts(df, partitions), per_part)
    tagged = df.withColumn("_chunk", chunk_of(df, keys + order, bounds))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumns({name: F.sum(F.coalesce(v, F.lit(0)).cast("long")).over(w) for name, v in values.items()})
    if not bounds:
        return local.drop("_chunk")
    local = local.withColumn("_last", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    ends = local.groupBy(*keys, "_chunk").agg(*[F.max_by(n, "_last").alias("_t_" + n) for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_chunk", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_c_" + n) for n in values])
    out = local.join(carry, keys + ["_chunk"])
    return out.withColumns({n: F.col(n) + F.col("_c_" + n) for n in values}).drop("_chunk", "_last", *["_c_" + n for n in values])


# Largest table broadcast, in bytes as written (Parquet); memory is a few times that.
BROADCAST_MAX_BYTES = 16 << 20


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` written once to the shared folder and read back, with a broadcast
    hint when its files are within ``max_bytes``; else without one (a shuffle
    join, with AQE skew splitting)."""
    spark = df.sparkSession
    path = shared_path(spark, "bounded")
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    out = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(out) if size <= max_bytes else out
