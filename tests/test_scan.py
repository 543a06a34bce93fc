"""Skew-safe numbering equals row_number, also when one key holds all rows."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators.scan import global_rank, running_count


def test_running_count_hot_key(spark):
    rnd = random.Random(3)
    rows = [(("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}"), rnd.randrange(1000), i)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    a = running_count(df, ["k"], ["t", "id"], out="n", partitions=8, per_part=4)
    b = df.withColumn("m", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert a.join(b, ["id"]).filter("n != m").count() == 0
    assert a.count() == 3000


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("v"))
    r = global_rank(df, ["v"], partitions=4)
    assert sorted(x.n for x in r.collect()) == list(range(1, 501))
    assert r.filter("n != v + 1").count() == 0


def test_running_max_hot_key(spark):
    from docmill.operators.scan import running_max
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else "k%d" % rnd.randrange(5), i, rnd.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    a = running_max(df, ["k"], ["t"], {"m": F.col("v")}, exclusive=True, partitions=8, per_part=4)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    b = df.withColumn("m2", F.max("v").over(w))
    j = a.join(b, ["k", "t"])
    assert j.filter("NOT (m <=> m2)").count() == 0 and a.count() == 2000


def test_running_count_many_bounds_array_search(spark):
    # more bounds than the CASE-tree limit: the array-literal binary search path
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(30)}", rnd.randrange(10**6), i)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    a = running_count(df, ["k"], ["t", "id"], out="n", partitions=200, per_part=3)
    b = df.withColumn("m", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert a.join(b, ["id"]).filter("n != m").count() == 0


def test_chunk_array_search_matches_case_tree(spark):
    from docmill.operators import scan as SC
    df = spark.range(3000).select((F.col("id") % 7).cast("string").alias("k"), (F.col("id") * 37 % 3001).alias("t"))
    bounds = SC.range_bounds(df, ["k", "t"], 150, per_part=4)
    assert len(bounds) > SC.CASE_TREE_MAX
    big = df.select(SC.chunk_of(df, ["k", "t"], bounds).alias("c"), "k", "t")
    old_max = SC.CASE_TREE_MAX
    try:
        SC.CASE_TREE_MAX = 10**6
        tree = df.select(SC.chunk_of(df, ["k", "t"], bounds).alias("c2"), "k", "t")
    finally:
        SC.CASE_TREE_MAX = old_max
    assert big.join(tree, ["k", "t"]).filter("c != c2").count() == 0


def test_running_sum_hot_key(spark):
    """Signed sums carried across chunks, with one key of all rows and nulls."""
    from docmill.operators.scan import running_sum
    rnd = random.Random(6)
    for hot in (0.5, 1.0):
        rows = [("hot" if rnd.random() < hot else "cold", rnd.randrange(500), i, rnd.choice([None, -3, 0, 2, 9])) for i in range(2000)]
        df = spark.createDataFrame(rows, "k string, t long, id long, v long")
        got = {r.id: (r.s, r.n) for r in running_sum(df, ["k"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, partitions=16, per_part=4).collect()}
        want, at = {}, {}
        for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
            s, n = at.get(k, (0, 0))
            at[k] = want[i] = (s + (v or 0), n + 1)
        assert got == want


def test_running_count_large_keys_by_chunks_small_ones_by_a_window(spark):
    """Keys above the bound (one of them null) and below it, ranked alike."""
    rnd = random.Random(11)
    rows = [(rnd.choice(["hot", "hot", None, None, f"k{rnd.randrange(9)}"]), rnd.randrange(3), rnd.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, g int, t long, id long")
    for by in (None, ["k"]):
        a = running_count(df, ["k", "g"], ["t", "id"], partitions=80, per_part=4, cluster=by, hot_rows=150)
        b = df.withColumn("m", F.row_number().over(Window.partitionBy("k", "g").orderBy("t", "id")))
        assert a.count() == 3000 and a.join(b, ["id"]).filter("n != m").count() == 0
