"""Ordered duplicates over two keys, components, names that clash, folders that go."""

import random

from pyspark.sql import functions as F

from newsloom.operators import components, growth, storage
from newsloom.streaming import ingest


def brute(rows):
    """Rows (r, key, key) in order, without those that share a key with a kept one."""
    taken, out = set(), []
    for r, *ks in sorted(rows):
        own = {(i, k.strip()) for i, k in enumerate(ks) if k and k.strip()}
        if not own & taken:
            taken |= own
            out.append(r)
    return out


def kept(spark, rows, **more):
    df = spark.createDataFrame(rows, "r long, article_id string, article_url string").withColumns({"k0": F.lit("x"), "component": F.lit(1), "node": F.lit(2)})
    got = growth.first_of_each(df.repartition(3), "r", **more)
    assert got.columns == df.columns
    return sorted(x.r for x in got.collect())


def test_first_of_each_against_the_definition(spark):
    r = random.Random(1)
    for most in (growth.COMPONENT, 3, 0):
        rows = [(i, r.choice([None, "", " ", *[f"a{r.randrange(40)}" for _ in range(5)]]), r.choice([None, " ", *[f"b{r.randrange(40)} " for _ in range(5)]])) for i in range(120)]
        rows += [(1000 + i, "hot", f"c{i % 7}") for i in range(50)]
        assert kept(spark, rows, most=most) == brute(rows)
    assert kept(spark, rows[:0]) == [] and kept(spark, [(1, None, ""), (2, None, None)]) == [1, 2]


def test_long_chains_take_no_rounds(spark, monkeypatch):
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(3000)]
    steps = []
    monkeypatch.setattr(growth, "written", lambda df, n="": steps.append(n) or storage.written(df, n))
    assert kept(spark, rows) == list(range(0, 3000, 2))
    assert steps.count("left") <= 1 and steps.count("heads") == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(40)] + [(7, 7), (-5, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y"), (3, "b", 7, "z")], "k long, g string, _n int, place string")
    top = growth.capped(df, "g", [F.col("k").asc()], 1)
    assert top.columns == df.columns and sorted(tuple(x) for x in top.collect()) == [(1, "a", 5, "x"), (3, "b", 7, "z")]
    new = spark.createDataFrame([(1, "new"), (1, "newer"), (9, "no")], "k long, place string")
    clash = df.withColumns({"_new_place": F.lit("own"), "new_place": F.lit("own too")})
    out = growth.back_filled(clash, new, "k", ["place"], F.col("k") < 3)
    assert out.columns == clash.columns and {(x.k, x.place, x._new_place, x.new_place) for x in out.collect()} == {(1, "new", "own", "own too"), (2, "y", "own", "own too"), (3, "z", "own", "own too")}


def test_folders_go(spark):
    df = storage.written(spark.range(3))
    path = storage._PATH[id(df)]
    storage.removed(df)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_a_stream_keeps_what_the_batch_would(spark, tmp_path):
    """Any cut into micro-batches, a restart between, a batch put twice."""
    r = random.Random(7)
    rows = [(i, r.choice([None, " ", f"a{r.randrange(60)}", f"a{r.randrange(60)}"]), r.choice(["", f"b{r.randrange(60)}", f"b{r.randrange(60)}"])) for i in range(150)]
    kind, at, path = "r long, article_id string, article_url string", 0, f"{tmp_path}/table"
    put = ingest.append_first(path, "r", buckets=8)
    for n in range(3):
        for _ in range(2):  # two files, so two micro-batches a start
            size = r.randrange(5, 40)
            spark.createDataFrame(rows[at : at + size], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
            at += size
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source")
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame(rows[at:], kind).createOrReplaceTempView("rest")
    for _ in range(2):
        put(spark.table("rest"), 99)
    assert sorted(x.r for x in ingest.appended(spark, path).collect()) == brute(rows)


def test_a_bucket_of_a_batch_is_one_file(spark, tmp_path):
    """However many tasks write it, so files don't grow with the input."""
    rows = [(i, f"a{i}", f"b{i // 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "r long, article_id string, article_url string").repartition(8)
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ingest.append_first(str(tmp_path), "r", buckets=8)(df, 0)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [len(list(d.glob("*.parquet"))) for d in sorted((tmp_path / "keys" / "batch=0").glob("bucket=*"))] == [1] * 8
    assert ingest.appended(spark, str(tmp_path)).count() == 200


def test_edges_of_a_task_are_contracted(spark):
    r = random.Random(5)
    chain = [(i + 1, i) for i in range(5000)]
    edges = chain + [(r.randrange(10**6, 10**6 + 3000), r.randrange(10**6, 10**6 + 3000)) for _ in range(2000)]
    df = spark.createDataFrame(edges, "u long, v long").coalesce(1)
    stars = [tuple(x) for x in components.contracted(df).collect()]
    assert len(stars) == len(set(stars)) <= len(edges) and all((i, 0) in set(stars) for i in range(1, 5001))
    assert {x.node: x.component for x in components.components(df).collect()} == {**{u: v for u, v in stars}, **{v: v for _, v in stars}}
    assert len(components.contracted(df, 7).collect()) <= len(edges)
