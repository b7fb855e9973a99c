"""Order-sensitive and composed operators against small models."""

import datetime as dt
import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import conflicts, dashboard, growth, places, raster, rules
from newsloom.sources import tables
from newsloom.streaming import ingest


def kept_in_order(rows):
    ids, urls, out = set(), set(), []
    for n, i, u in rows:
        i, u = (i or "").strip(), (u or "").strip()
        if (i and i in ids) or (u and u in urls):
            continue
        out.append(n)
        ids |= {i} - {""}
        urls |= {u} - {""}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_of_each(spark, seed):
    r = random.Random(seed)
    rows = [(n, r.choice(["", None, *"abcdef"]), r.choice(["", " ", *"1234567"])) for n in range(40)]
    df = spark.createDataFrame(rows, "row_id long, article_id string, article_url string")
    assert sorted(x.row_id for x in growth.first_of_each(df).collect()) == kept_in_order(rows)
    assert growth.first_of_each(df.limit(0)).count() == 0


def test_first_of_each_chain(spark):
    rows = [(1, "A", "1"), (2, "B", "1"), (3, "B", "3")]
    df = spark.createDataFrame(rows, "row_id long, article_id string, article_url string")
    assert sorted(x.row_id for x in growth.first_of_each(df).collect()) == [1, 3]


def test_order_and_cap(spark):
    df = spark.createDataFrame([(0, "2024-01-01"), (1, ""), (2, "2025-01-01"), (3, "2024-01-01"), (4, None), (5, "Jan 3")], "row_id long, date_published string")
    assert [r.row_id for r in df.orderBy(*growth.date_order()).collect()] == [5, 2, 0, 3, 1, 4]
    seeds = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "d")], "seed int, url string")
    assert growth.seeds_within(seeds, 2).select("url").distinct().count() == 3


def fit(a, b):
    """Whether two titles fit and how well, by the rules as they are told."""
    if not (a and b):
        return False, 0.0
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    x, y = ({w for w in t.split() if len(w) >= 4} for t in (a, b))
    if not (x and y):
        return ratio >= 0.6, ratio
    telling, share = len([w for w in x & y if len(w) >= 5]), len(x & y) / min(len(x), len(y))
    return ratio >= 0.6 or telling >= 2 or (telling >= 1 and share >= 0.3), ratio + share + 0.25 * telling


def cluster(rows, days=120):
    seeds, out = {}, {}
    for key, country, title, day in sorted(rows, key=lambda x: (x[3] is None, x[3] or 0, x[0])):
        best, score = None, -1
        for i, (t, d) in enumerate(seeds.setdefault(country, [])):
            if d is not None and day is not None and abs(day - d) > days:
                continue
            ok, s = fit(title, t)
            if ok and s > score:
                best, score = i, s
        if best is None:
            seeds[country].append((title, day))
            best = len(seeds[country]) - 1
        out[key] = (country, best)
    return out


def test_leader_clusters(spark):
    r = random.Random(3)
    words = ["mine", "bambas", "apurimac", "river", "protest", "cusco", "gold", "spill", "x"]
    rows = [(i, r.choice(["peru", "brazil"]), " ".join(r.sample(words, r.randrange(0, 5))), r.choice([None, r.randrange(0, 500)])) for i in range(120)]
    df = spark.createDataFrame([(k, c, t, None if d is None else (dt.date(2023, 1, 1) + dt.timedelta(d)).isoformat()) for k, c, t, d in rows], "k long, country string, article_title string, date_published string")
    got = {x.k: (x.conflict_id, x.coverage_count) for x in conflicts.assign(df, "k").collect()}
    want = cluster(rows)
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {k: v[1] for k, v in got.items()} == {k: sizes[c] for k, c in want.items()}
    together = {}
    for k, c in want.items():
        together.setdefault(c, set()).add(got[k][0])
    assert all(len(v) == 1 for v in together.values())


def test_windows_and_blank_titles(spark):
    rows = [(1, "Peru", "Gold mine protest Cusco", "2024-01-01"), (2, "Peru", "Gold mine protest Cusco", "2024-04-30"), (3, "Peru", "Gold mine protest Cusco", "2024-05-01"), (4, "Peru", "", "2024-01-01"), (5, "Peru", "", "2024-01-01")]
    got = {x.k: x for x in conflicts.assign(spark.createDataFrame(rows, "k long, country string, article_title string, date_published string"), "k").collect()}
    assert [got[i].coverage_count for i in range(1, 6)] == [2, 2, 1, 1, 1] and got[1].conflict_id == got[3].conflict_id


def test_csv_round_trip(spark, tmp_path):
    text = 'He said "no", \\ then\n left '
    df = spark.createDataFrame([("1", text, "x"), ("2", "", None)], "article_id string, article_title string, extra string")
    tables.write_rows(df, f"{tmp_path}/c")
    back = {r.article_id: r for r in tables.read_rows(spark, f"{tmp_path}/c").collect()}
    assert back["1"].article_title == text and back["2"].extra == "" and back["1"].notes == ""
    assert tables.read_rows(spark, f"{tmp_path}/none").count() == 0
    assert tables.admin_last(df.withColumn("admin_2", F.lit("x"))).columns[-5:] == tables.V.ADMIN_COLUMNS


def test_points(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]
    areas = spark.createDataFrame([("B", "P", [ring, hole], 0.0, 4.0, 0.0, 4.0), ("A", "P", [[[3.0, 3.0], [9.0, 3.0], [9.0, 9.0]]], 3.0, 9.0, 3.0, 9.0)], "gid string, iso3 string, rings array<array<array<double>>>, xmin double, xmax double, ymin double, ymax double")
    pts = [(0, 0.5, 0.5), (1, 1.5, 1.5), (2, 4.0, 2.0), (3, 3.8, 3.5), (4, 20.0, 20.0), (5, 1.0, 1.5)]
    df = spark.createDataFrame([(i, x, y, "P") for i, x, y in pts], "k long, x double, y double, iso3 string")
    assert {r.k: r.gid for r in places.in_polygons(df, areas, "k", ["iso3"]).collect()} == {0: "B", 1: None, 2: None, 3: "A", 4: None, 5: None}


def test_text_resolution(spark):
    second = spark.createDataFrame([("PER", "Cusco", "Piedras", "PER.1.1_1"), ("PER", "Cusco", "Colombia", "PER.1.2_1"), ("PER", "Lima", "Ate Vitarte", "PER.2.1_1"), ("PER", "Lima", "Ica", "PER.2.2_1")], "iso3 string, region string, name string, gid string")
    third = spark.createDataFrame([("PER", "PER.1.1_1", "Rio Alto", "PER.1.1.1_1")], "iso3 string, gid2 string, name string, gid string")
    texts = ["las piedras", "en Piedras, Río Alto", "Colombia Colombia", "Ate Vitarte", "Ate Vitarte y ATE VITARTE", "Piedras"]
    rows = spark.createDataFrame([(i, "PER", "cuscó" if i in (0, 1, 2) else "", t) for i, t in enumerate(texts)], "k long, iso3 string, region string, text string")
    got = {r.k: (r.a2, r.a3, r.gid) for r in places.resolve_text(rows, second, third, "k").collect()}
    assert got == {1: ("Piedras", "Rio Alto", "PER.1.1.1_1"), 4: ("Ate Vitarte", "", "PER.2.1_1")}
    base = spark.createDataFrame([(1, "Peru", "PER", "town"), (2, "Peru", "PER", "region"), (3, "Nowhere", None, "town"), (4, "Peru", "PER", "town")], "k long, country string, iso3 string, precision string")
    points = spark.createDataFrame([(1, "Lima", "", "PER.2_1"), (2, "Lima", "", "PER.2_1"), (3, "L", "", "X"), (4, "Perú", "", "PER.3_1")], "k long, a2 string, a3 string, gid string")
    by_text = spark.createDataFrame([(2, "Cusco", "", "PER.1_1")], "k long, a2 string, a3 string, gid string")
    assert {r.k: r.a2 for r in places.resolve(base, points, by_text, "k").collect()} == {1: "Lima", 2: "Cusco", 3: "", 4: ""}


def test_geocoded(spark):
    cols = ["country", "region_department", "locality", "location_context", "location_name", "latitude", "longitude", "geocode_precision", "geocode_query", "geocode_display_name", "geocode_status"]
    rows = [["Peru", "Cusco", "", "", "", "", "", "", "", "", ""], ["Peru", "", "Ate", "", "", "", "", "", "", "", "not_found"], ["", "", "", "", "", "", "", "", "", "", ""], ["Peru", "", "", "", "", "1", "2", "town", "q", "d", "ok"]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    answers = spark.createDataFrame([("Cusco, Peru", "pe", -13.5, -71.9, "town", "Cusco"), ("Ate, Peru", "pe", None, None, None, None)], "query string, iso2 string, lat double, lon double, precision string, display_name string")
    got = sorted((r.geocode_status, r.latitude, r.geocode_precision) for r in places.geocoded(df, answers).collect())
    assert got == [("no_location", "", ""), ("not_found", "", ""), ("ok", "-13.500000", "region"), ("ok", "1", "town")]


def test_indices_and_scale(spark):
    df = raster.with_indices(spark.createDataFrame([(0.1, 0.2, 0.1, 0.5, 0.3), (0.0, 0.0, 0.0, 0.0, 0.0)], ", ".join(f"{b} double" for b in raster.BANDS)))
    a, z = df.collect()
    assert a.ndvi == pytest.approx(2 / 3) and a.savi == pytest.approx(0.5454545) and z.ndvi is None and z.evi2 == 0
    v = spark.createDataFrame([(x,) for x in (1.0, 2.0, 5.0, 10.0, math.nan, math.inf)], "v double")
    s = raster.shared_scale(v, "v").first()
    assert (s.vmin, s.vmax) == pytest.approx((1.06, 9.7))
    c = raster.shared_scale(v.where("v = 1.0"), "v").first()
    assert c.vmax == c.vmin + 1e-6
    px = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, math.nan), (0, None), (1, None)], "y int, red double")
    assert {r.y: r.red for r in raster.composite(px, ["y"], ["red"]).collect()} == {0: 2.0, 1: None}
    assert [r.month for r in raster.months(px, dt.date(2023, 11, 5), dt.date(2024, 2, 1)).orderBy("month").collect()] == [dt.date(2023, 11, 1), dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    assert np.isclose(raster.reflectance(px.where("red = 1"), ["red"]).first().red, -0.1999725)


def test_dashboard(spark):
    df = dashboard.derived(spark.createDataFrame([("1", "mining", "2024-01-02", "x"), ("2", " ", "bad", "3")], "article_id string, sector string, date_published string, coverage_count string").withColumn("event_type", F.lit("legal")))
    got = {r.article_id: r for r in df.collect()}
    assert got["2"].theme == "legal" and got["2"].date is None and got["1"].coverage == 1 and got["2"].coverage == 3
    assert dashboard.filtered(df, dates=(dt.date(2024, 1, 2), dt.date(2024, 1, 2))).count() == 1
    rows = dashboard.counts_by(df, "year").collect()
    assert [(r.period, r.theme, r.label, r.n) for r in rows] == [(2024, "mining", "Mining", 1)]
    assert dashboard.map_view(df).first().zoom == 3
    assert dashboard.view(df, ["sector", "nope"]).columns == ["sector"]
    assert dashboard.valid_request(dt.date(2024, 1, 1), dt.date(2024, 2, 1), 0, 0) and not dashboard.valid_request(dt.date(2024, 1, 1), dt.date(2024, 2, 1), 1, 0)


def test_sources(spark):
    s = rules.Source("s", r"^/\d{4}/[a-z-]+/?$", rules={"sector": {"mining": ["gold"]}}, countries={"Peru": ["perú", "lima"]}, regions=["Cusco"], relevance="pair_or_issue", americas_only=True, relevant_slugs=["gold"], slug_pattern="/list/([a-z]+)")
    page = '<title>Gold in Lima</title><meta name="description" content="near cusco"><a href="/list/gold">x</a><a href="/2024/a-b?x">y</a><a href="https://o.org/2024/a-b">z</a>'
    pages = spark.createDataFrame([("https://s.org/2024/gold-lima", page), ("https://s.org/2024/other", "<p>no title</p>")], "url string, html string")
    row = rules.relevant_articles(pages, s).collect()
    assert [(r.sector, r.country, r.region_department, r.slugs) for r in row] == [("mining", "Peru", "Cusco", ["gold"])]
    assert [r.url for r in rules.discover(pages, s, "https://s.org/").collect()] == ["https://s.org/2024/a-b/"]
    assert rules.rules_of(spark.createDataFrame(rules.rule_rows(s.rules), "source string, dimension string, priority int, label string, keyword string")) == s.rules


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 1)), (2, "a", dt.datetime(2024, 1, 1, 2)), (3, "b", dt.datetime(2024, 1, 1, 9))], "id long, k string, ts timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    put = ingest.append_new(f"{tmp_path}/out", "k")
    for i in (1, 2):
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c{i}").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    counted = ingest.window_counts(stream, "ts", "6 hours", "1 hour", "k")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
    first = ingest.first_writer(stream, ["k"], "ts", "1 hour")
    first.writeStream.format("memory").queryName("first").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("first").count() == 2


def test_plans(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("text"), F.col("id").alias("k"), F.lit("X").alias("iso3"))
    names = spark.createDataFrame([("Abcd", "g", "X")], "name string, gid string, iso3 string")
    plan = places.name_hits(df, names, "k", ["iso3"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
