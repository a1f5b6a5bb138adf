from datetime import datetime as T

from pyspark.sql import functions as F

from memlattice.plans import dictionary, settle, versions


def test_newest_version(spark):
    rows = [("a", "old", T(2025, 1, 1), 1), ("a", "new", T(2025, 1, 2), 1), ("a", "new", T(2025, 1, 2), 1), ("a", None, None, 1), ("b", "x", T(2025, 1, 1), 1), ("b", "y", T(2025, 1, 1), 1), (None, "n", None, 1)]
    df = spark.createDataFrame(rows, "k string, v string, at timestamp_ntz, __rank int")
    out = versions.newest(df, {"k": F.col("k")}, "at", {"v": F.col("v")})
    assert {tuple(r) for r in out.collect()} == {("a", "new"), ("b", "y"), (None, "n")}
    assert versions.newest(df.limit(0), {"k": F.col("k")}, "at", {"v": F.col("v")}).count() == 0


def test_dense_ids_follow_the_order(spark):
    words = [f"w{i:04}" for i in range(500)]
    df = settle.settle(spark.createDataFrame([(w,) for w in reversed(words)], "w string").repartition(7))
    got = {r.w: r.id for r in dictionary.dense_ids(df, ["w"], "id").collect()}
    assert got == {w: i for i, w in enumerate(words)}
    assert dictionary.dense_ids(settle.settle(df.limit(0)), ["w"], "id").count() == 0


def test_look_up_with_and_without_hot_keys(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)] + [(99, None)], "n int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 30, 2)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, facts.join(table, ["k"], how).select("k", "n", "v").collect()), key=str)
        hot = dictionary.hot_keys(settle.settle(facts.groupBy("k").count()), ["k"], "count")
        assert [r.k for r in hot.collect()] == ["hot"]
        for keys in (hot, None, spark.createDataFrame([("k2",), ("k38",), ("hot",)], "k string")):
            got = dictionary.look_up(facts, table, ["k"], keys, how).select("k", "n", "v")
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_settled_tables_can_be_discarded(spark):
    df = settle.settle(spark.range(5).toDF("x"))
    assert df.count() == 5
    settle.discard(df)
    settle.discard(None)
    other = settle.settle(spark.range(2).toDF("x"))
    settle.discard_all(spark)
    assert settle._SETTLED == [] and not __import__("os").path.exists(other._settled_at.removeprefix("file://"))


def test_hot_keys_are_bounded(spark):
    most = int(spark.conf.get("spark.sql.shuffle.partitions")) * dictionary.HOT_PER_PARTITION
    counts = settle.settle(spark.range(1000).selectExpr("id as k", "if(id < 10, 100000, 3) as n"))
    assert sorted(r.k for r in dictionary.hot_keys(counts, ["k"]).collect()) == list(range(10)) and most > 10
    assert dictionary.hot_keys(settle.settle(spark.range(1000).selectExpr("id as k", "5 as n")), ["k"]) is None
    assert dictionary.hot_keys(settle.settle(counts.limit(0)), ["k"]) is None


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="test"))
    assert settle.shared_folder(session("local[4]", None)).startswith("file:///")
    assert settle.shared_folder(session("spark://somewhere:7077", "hdfs://there/")) == "hdfs://there"
    with pytest.raises(ValueError):
        settle.shared_folder(session("spark://somewhere:7077", None))
