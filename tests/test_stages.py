"""Sources that come with the library, and whole runs over small landed tables."""

import datetime as dt
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import text as X
from newsloom.operators import conflicts, dashboard, growth, places, raster, rules
from newsloom.plans import stages
from newsloom.sources import tables


def page(title, text="", more=""):
    return f'<title>{title}</title><meta property="og:description" content="{text}">{more}'


def links(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


ARTICLE = "https://www.theguardian.com/environment/2024/mar/05/gold-mine-spill-peru"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("https://www.theguardian.com/environment/mining", links("/environment/2024/mar/05/gold-mine-spill-peru?x=1", "/environment/2024/mar/06/plane-crash-lima", "/environment/gallery/2024/mar/05/gold-mine", "/world/2024/mar/05/all", "https://else.org/a/2024/mar/05/a-b"), 200),
        (ARTICLE, page("Gold mine spill near Lima", "Mercury in the river", '<a rel="author" href="/p">Ann <b>Lee</b></a><time datetime="2024-03-05T10:00:00Z">5 March</time>'), 200),
        (ARTICLE, page("Gold mine spill near Lima", "Mercury in the river", '<a rel="author" href="/p">Ann <b>Lee</b></a><time datetime="2024-03-05T10:00:00Z">5 March</time>'), 200),
        ("https://www.theguardian.com/environment/2024/mar/06/plane-crash-lima", page("Gold mine plane crash near Lima"), 200),
        ("https://es.mongabay.com/list/mineria/", links("/2024/01/rio-de-oro/", "/custom-story/2024/02/otro-tema/"), 200),
        ("https://es.mongabay.com/2024/01/rio-de-oro/", page("Algo pasa", "", links("https://es.mongabay.com/list/mineria-ilegal/", "https://es.mongabay.com/list/peru/", "https://es.mongabay.com/list/all-topics/") + '<meta name="author" content="B"><meta property="article:published_time" content="Tue, 05 Mar 2024 10:00:00 GMT">'), 200),
        ("https://es.mongabay.com/custom-story/2024/02/otro-tema/", page("Nada"), 200),
        ("https://www.elespectador.com/ambiente/", links("/ambiente/z-mineria/", "/ambiente/a-mineria/", "/tags/mineria-ilegal/"), 200),
        ("https://www.elespectador.com/ambiente/z-mineria/", page("Minería en el Chocó", "premium", '<meta name="cXenseParse:articleid" content="77"><meta name="keywords" content="a, b;c">'), 200),
        ("https://www.elespectador.com/ambiente/a-mineria/", page("Minería en Antioquia"), 404),
        ("https://ojo-publico.com/ambiente", links("/12345/mineria-en-madre"), 200),
        ("https://ojo-publico.com/12345/mineria-en-madre", page("Título", "", '<meta property="article:tag" content="Minería"><meta property="article:tag" content="Cusco"><meta property="og:country_name" content="Perú"><meta property="article:published_time" content="Dom, 21/06/2026 - 08:00">'), 200),
    ]
    return spark.createDataFrame(rows, "url string, html string, status int")


def test_sources_are_data():
    assert len(rules.shipped()) == 8
    for name in rules.shipped():
        s = rules.shipped_source(name)
        assert s.name == name and s.seeds and s.rules["sector"] and s.countries and s.relevance
        assert all(u.startswith(s.base) for u in s.seeds)


def test_crawl(spark, pages):
    got = {r.article_id.split(":")[0]: r for r in rules.crawl(pages, rules.shipped_source("guardian"), 5).collect()}
    g = got["guardian"]
    assert len(got) == 1 and g.article_url == ARTICLE + "/" and g.source == "The Guardian"
    assert (g.sector, g.event_type, g.environmental_issue, g.country, g.date_published) == ("mining", "pollution", "mercury contamination", "Peru", "2024-03-05")
    assert g.notes == "Author: Ann Lee" and g.source_text_excerpt == "Mercury in the river"
    m = rules.crawl(pages, rules.shipped_source("mongabay"), 5).collect()
    assert [(r.sector, r.country, r.date_published) for r in m] == [("mining", "Peru", "2024-03-05")]
    assert m[0].notes == "Topic tags: mineria-ilegal, peru | No event_type matched; manual review. | Author: B"
    e = rules.crawl(pages, rules.shipped_source("elespectador"), 5).collect()
    assert [(r.article_id, r.sector, r.region_department, r.country) for r in e] == [("elespectador:77", "mining", "Chocó", "Colombia")]
    assert e[0].notes.startswith("Premium/locked")
    o = rules.crawl(pages, rules.shipped_source("ojopublico"), 5).collect()
    assert [(r.sector, r.region_department, r.country, r.date_published) for r in o] == [("mining", "Cusco", "Peru", "2026-06-21")] and o[0].notes.startswith("Tags: minería, cusco")
    assert rules.crawl(pages, rules.shipped_source("grist"), 5).count() == 0 == rules.crawl(pages.limit(0), rules.shipped_source("guardian"), 5).count()


def test_candidates_in_order(spark):
    s = rules.Source("s", r"^/a/", base="https://s.org", seeds=["https://s.org/1", "https://s.org/2"], over_collect=1, order="page", relevance="always")
    rows = [("https://s.org/1", links("/a/z", "/a/b"), 200), ("https://s.org/2", links("/a/q"), 200)] + [(f"https://s.org/a/{x}/", page(x), 200) for x in "zbq"]
    pages = spark.createDataFrame(rows, "url string, html string, status int")
    assert {r.url: (r.seed, r.place) for r in rules.candidates(pages, s, 5).collect()} == {"https://s.org/a/z/": (1, 0), "https://s.org/a/b/": (1, 1), "https://s.org/a/q/": (2, 0)}
    assert rules.candidates(pages, s, 1).count() == 2
    assert [r.article_title for r in rules.crawl(pages, s, 1).collect()] == ["z"]
    s.order = "url"
    assert [r.article_title for r in rules.crawl(pages, s, 1).collect()] == ["b"]


def boundary(gid, level, iso3, n1, n2, n3, x, y, gid2=None):
    ring = [[x, y], [x + 1.0, y], [x + 1.0, y + 1.0], [x, y + 1.0]]
    return gid, level, iso3, gid2, n1, n2, n3, [ring], x, x + 1.0, y, y + 1.0


@pytest.fixture(scope="module")
def areas(spark):
    rows = [
        boundary("PER.1.1_1", 2, "PER", "Cusco", "Piedras", None, 0.0, 0.0),
        boundary("PER.1.1.1_1", 3, "PER", "Cusco", "Piedras", "Alto", 0.0, 0.0, "PER.1.1_1"),
        boundary("BRA.1.1_1", 2, "BRA", "Acre", "Feijó", None, 5.0, 5.0),
        boundary("ECU.1.1_1", 2, "ECU", "Loja", "Macará", None, 8.0, 8.0),
    ]
    return spark.createDataFrame(rows, "gid string, level int, iso3 string, gid_2 string, name_1 string, name_2 string, name_3 string, rings array<array<array<double>>>, xmin double, xmax double, ymin double, ymax double")


def test_points_to_names(spark, areas):
    rows = spark.createDataFrame([(1, "PER", "0.5", "0.5"), (2, "BRA", "5.5", "5.5"), (3, "ECU", "8.5", "8.5"), (4, "PER", "x", "0.5"), (5, "PER", "9", "9"), (6, None, "1", "1")], "k long, iso3 string, latitude string, longitude string")
    got = {r.k: (r.a2, r.a3, r.gid) for r in places.resolve_point(rows, areas, "k").collect()}
    assert got == {1: ("Piedras", "Alto", "PER.1.1.1_1"), 2: ("Feijó", "", "BRA.1.1_1"), 3: ("Macará", "", "ECU.1.1_1")}
    assert places.area_of(areas, "PER.1.1.1_1").first().label == "Alto"
    with pytest.raises(ValueError):
        places.area_of(areas, "PER.9_1")
    near = places.in_degrees(areas.withColumns({"rings": F.lit(None).cast("array<array<array<double>>>"), "xmin": F.lit(111319.49), "xmax": F.lit(111319.49), "ymin": F.lit(111325.14), "ymax": F.lit(111325.14)}), "EPSG:3857").first()
    assert near.xmin == pytest.approx(1, abs=1e-4) and near.ymin == pytest.approx(1, abs=1e-4)
    with pytest.raises(ValueError):
        places.in_degrees(areas, "EPSG:9")


def test_many_areas_meet_points_by_a_shuffle(spark, areas):
    pts = spark.createDataFrame([(i, "PER", 0.01 * i, 0.5) for i in range(150)], "k long, iso3 string, x double, y double")
    own = areas.where("level = 2").select("iso3", "gid", "rings", "xmin", "xmax", "ymin", "ymax")
    a, b = ({r.k: r.gid for r in places.in_polygons(pts, own, "k", ["iso3"], most=m).collect()} for m in (1 << 20, 0))
    assert a == b and sum(g is not None for g in a.values()) == 99


def test_run_all(spark, pages, areas):
    two = ["guardian", "mongabay"]
    out, counts, failed = stages.run_all(pages, None, areas, None, two, most=5)
    rows = out.collect()
    assert not failed and len(rows) == 2 and out.columns[-5:] == tables.V.ADMIN_COLUMNS
    c = counts.first()
    assert (c.fetched, c.merged, c.dropped, c.new) == (2, 2, 0, 2)
    assert all(r.conflict_id and r.coverage_count == 1 for r in rows) and {r.text_status for r in rows} <= {"ok", "empty", "error:fetch_failed"}
    again, counts, _ = stages.run_all(pages, growth.written(out.drop("row_id")), None, None, two[:1], most=5)
    c = counts.first()
    assert (c.fetched, c.merged, c.dropped, c.new) == (1, 3, 1, 0) and again.count() == 2
    assert again.columns.count("conflict_id") == 1


def test_fetch_and_match(spark, areas):
    rows = spark.createDataFrame([(1, "u1", "", "", "Peru", "Cusco", "A"), (2, "u2", "", "error:x", "Peru", "", "B"), (3, "", "", "", "Chile", "", ""), (4, "u4", "old", "ok", "Brazil", "", "C")], "row_id long, article_url string, article_text string, text_status string, country string, region_department string, article_title string")
    pages = spark.createDataFrame([("u1", "<p>in Piedras, Alto</p>", 200), ("u1", "<p>zz</p>", 404), ("u2", "<p>z</p>", 200)], "url string, html string, status int")
    got = {r.row_id: (r.article_text, r.text_status) for r in stages.fetch_texts(rows, pages).collect()}
    assert got == {1: ("in Piedras, Alto", "ok"), 2: ("", "error:x"), 3: ("", "error:no_url"), 4: ("old", "ok")}
    one = {r.row_id: r.text_status for r in stages.fetch_texts(rows, pages, again=True, limit=2).collect()}
    assert one == {1: "ok", 2: "ok", 3: "", 4: "ok"}
    found = {r.row_id: r for r in stages.match_admin(stages.fetch_texts(rows, pages), areas).collect()}
    a0, a1, a2, a3, gid = tables.V.ADMIN_COLUMNS
    assert [found[1][c] for c in (a0, a1, a2, a3, gid)] == ["Peru", "Cusco", "Piedras", "Alto", "PER.1.1.1_1"]
    assert [found[3][c] for c in (a0, a2, gid)] == ["Chile", "", ""] and found[4][gid] == ""


def test_geocode_stage(spark):
    rows = spark.createDataFrame([(1, "Peru", "Cusco", ""), (2, "Peru", "", "Ate"), (3, "", "", "")], "row_id long, country string, region_department string, locality string")
    answers = spark.createDataFrame([("Cusco, Peru", "pe", -13.5, -71.9, "town", "Cusco"), ("Cusco, Peru", "pe", -13.5, -71.9, "town", "Cuzco"), ("Ate, Peru", "pe", None, None, None, None)], "query string, iso2 string, lat double, lon double, precision string, display_name string")
    got = {r.row_id: (r.geocode_status, r.latitude) for r in stages.geocode(rows, answers).collect()}
    assert got == {1: ("ok", "-13.500000"), 2: ("not_found", ""), 3: ("no_location", "")}


def test_cache(spark, tmp_path):
    cache = spark.createDataFrame([("a", "pe", 1.0), ("a", "pe", 2.0), ("b", "", None)], "query string, iso2 string, lat double")
    q = spark.createDataFrame([("a", "pe"), ("b", ""), ("c", "br")], "query string, iso2 string")
    known, missing = tables.with_cache(q, cache)
    assert sorted((r.query, r.lat) for r in known.collect() if r.query != "b") == [("a", 1.0), ("c", None)] and known.count() == 3
    assert [r.query for r in missing.collect()] == ["c"]
    tables.updated_cache(cache, spark.createDataFrame([("c", "br", None), ("a", "pe", 9.0)], "query string, iso2 string, lat double"), f"{tmp_path}/cache")
    assert sorted((r.query, r.lat or 0) for r in spark.read.parquet(f"{tmp_path}/cache").collect()) == [("a", 1.0), ("a", 2.0), ("b", 0), ("c", 0)]


def test_boundaries_and_clip(spark, areas, tmp_path):
    areas.write.partitionBy("iso3", "level").parquet(f"{tmp_path}/b")
    assert [r.gid for r in tables.boundaries(spark, f"{tmp_path}/b", "PER", 3).collect()] == ["PER.1.1.1_1"]
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "y int, x int, red double")
    assert raster.clipped(px, px.where("x = 1").select("y", "x")).count() == 1
    old = spark.createDataFrame([(1, 2)], "SR_B1 int, SR_B2 int")
    assert raster.band_columns(old).columns == ["SR_B1", "SR_B2", "blue", "green"] and raster.band_columns(old).first().blue == 2


def test_by_source_and_admin(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "Peru"), ("2", "b", "")], "article_id string, source string, country string")
    tables.write_by_source(df, f"{tmp_path}/s")
    assert sorted(r.article_id for r in spark.read.option("header", True).csv(f"{tmp_path}/s/source=a").collect()) == ["1"]
    full = tables.ensure(df, [*tables.V.ARTICLE_COLUMNS, *tables.V.ADMIN_COLUMNS]).withColumn(tables.V.ADMIN_COLUMNS[0], F.lit(" Chile "))
    assert sorted(r[tables.V.ADMIN_COLUMNS[0]] for r in places.admin_columns(full).collect()) == ["Chile", "Peru"]


@pytest.mark.parametrize("n", [0, 1, 57, 5000])
def test_numbered(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 5003).alias("v"), "id")
    got = {r.id: r.place for r in growth.numbered(df, [F.col("v").desc(), F.col("id").asc()]).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted((-((i * 7919) % 5003), i) for i in range(n)), 1)}
    assert got == want


def test_order_statistics(spark):
    v = [float((i * 7919) % 997) for i in range(3000)] + [5.0] * 2000 + [1e300, -1e300]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    ranks = [0, 1, 100, 2500, len(v) - 1]
    for few in (10_000, 3):
        assert raster.order_statistics(df, "v", ranks, bins=16, few=few) == {k: sorted(v)[k] for k in ranks}
    assert raster.shared_scale(df.limit(0), "v").first().vmin is None


def test_picker(spark):
    rows = [(0, "c1", "Title A", "Peru", "Cusco", "Cusco", "region"), (1, "c1", "Title B", "Peru", "Cusco", "Lima", "town"), (2, "", "", "Peru", "", "", "town"), (3, "", "zz", "Chile", "", "", "town")]
    cols = tables.V.ADMIN_COLUMNS
    df = spark.createDataFrame(rows, "row_id long, conflict_id string, article_title string, a string, b string, c string, geocode_precision string").withColumnsRenamed({"a": cols[0], "b": cols[1], "c": cols[2]}).withColumns({"latitude": F.lit("1"), "longitude": F.lit("2")})
    got = dashboard.picker(df, {cols[0]: "Peru"}).collect()
    assert [(r.label, r["size"], r.row_id) for r in got] == [("(no article title)", 1, 2), ("Title B — Lima, Cusco · 2 articles", 2, 1)]
    assert dashboard.picker(df).count() == 3


def test_analysis(spark):
    scenes = spark.createDataFrame([("s1", dt.datetime(2024, 1, 3), 5.0), ("s2", dt.datetime(2024, 3, 3), 5.0), ("s3", dt.datetime(2024, 3, 4), 99.0)], "scene_id string, ts timestamp, cloud double")
    px = [(s, 0, x, *[7000.0 + 1000 * b + 100 * x + k for b in range(5)]) for k, s in enumerate(("s1", "s2", "s3")) for x in range(6)]
    pixels = spark.createDataFrame(px, "scene_id string, y int, x int, " + ", ".join(f"{b} double" for b in raster.BANDS))
    area = spark.createDataFrame([(0, x) for x in range(5)], "y int, x int")
    got = stages.run_analysis(scenes, pixels, area, dt.date(2024, 1, 1), dt.date(2024, 3, 31))
    assert got["months"].count() == 10 and [r.mean_ndvi is None for r in got["series"].orderBy("month").collect()] == [False, True, False]
    e = got["ends"].first()
    assert (e.before, e.after, e.n_any, e.n_all) == (dt.date(2024, 1, 1), dt.date(2024, 3, 1), 2, 2)
    v = sorted(r.ndvi for r in got["months"].collect())
    s = {r.name: r for r in got["scales"].collect()}["ndvi"]
    assert v[0] < s.vmin < v[1] and v[-2] < s.vmax < v[-1] and got["manifest"].count() == 8


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "b", "x")], "k long, u string, v string")
    found = spark.createDataFrame([(1, "q"), (1, "p"), (1, None)], "k long, v string")
    assert sorted((r.k, r.v) for r in growth.back_filled(df, found, "k", ["v"], F.col("v") == "").collect()) == [(1, "p"), (2, "x")]
    rows = spark.createDataFrame([(1, "Peru", "Gold mine protest Cusco", "2024-01-01", "old", 9)], "k long, country string, article_title string, date_published string, conflict_id string, coverage_count int")
    got = conflicts.assign(rows, "k")
    assert got.columns.count("conflict_id") == 1 and got.first().coverage_count == 1


@pytest.mark.parametrize("raw, day", [("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05"), ("March 5, 2024 10:00", "2024-03-05"), ("2024-03-05T23:59:59.123-05:00", "2024-03-05"), ("5th of March 2024", "2024-03-05"), ("03/05/2024", "2024-03-05"), ("13/05/2024", "2024-05-13"), ("Sept 5, 2024", "2024-09-05"), ("Thu, 5 Sept. 2024 08:00 +0200", "2024-09-05"), ("2024 March 05", "2024-03-05"), ("5-Mar-2024", "2024-03-05"), ("Mar. 5 2024", "2024-03-05"), ("20240305", "2024-03-05"), ("2024.3.5", "2024-03-05"), ("31/02/2024", "31/02/2024"), ("30 Foo 2024", "30 Foo 2024"), ("March 2024", "March 2024"), ("MAY 1ST, 2024", "2024-05-01"), ("Tuesday, March 5, 2024 at 3:04 pm", "2024-03-05"), ("soon", "soon"), (None, "")])
def test_dates(spark, raw, day):
    assert spark.createDataFrame([(raw,)], "x string").select(X.iso_date(F.col("x"))).first()[0] == day


def test_meta_order(spark):
    rows = ['<meta property="description" content="P"><meta name="description" content="N">', '<meta name="description" content=""><meta property="description" content="P">', '<a href="q" rel=author>Z</a><time>x</time>']
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(H.meta(F.col("x"), "description"), H.author_link(F.col("x")), H.time_tag(F.col("x"))).collect()]
    assert got == [("N", "", ""), ("", "", ""), ("", "Z", "")]
    assert spark.createDataFrame([("near u.s.a x",), ("near u.s. x",)], "x string").select(X.has_word(F.col("x"), ["u.s.", "texas"])).collect() == [(True,), (False,)]


@pytest.mark.parametrize("days, block", [(120, 512), (None, 7), (40, 3)])
def test_leaders_among_many_titles(spark, days, block):
    """Joins and a pass over edges against comparing each row with every seed."""
    import difflib
    import random

    r = random.Random(5)
    parts = ["the", "ing", "tion", "an", "er", "ou", "st", "mine", "oro", "rio"]
    title = lambda: " ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(r.randrange(0, 12)))
    pool = [title() for _ in range(60)]

    def changed(t):
        w = t.split()
        for _ in range(r.randrange(0, 4)):
            if w:
                w[r.randrange(len(w))] = "".join(r.choices(parts, k=2))
        return " ".join(w)

    rows = [(i, r.choice(["p", "q"]), changed(r.choice(pool)), r.choice([None, r.randrange(400)])) for i in range(250)] + [(900, "p", "long word " * 90, 5), (901, "p", "long word " * 90 + "z", 6), (902, None, None, None)]
    began = dt.date(2023, 1, 1)
    df = spark.createDataFrame([(k, c, t, None if d is None else str(began + dt.timedelta(d))) for k, c, t, d in rows], "k long, country string, article_title string, date_published string")
    got = {x.k: (x.conflict_id, x.coverage_count) for x in conflicts.assign(df.withColumn("_key", F.lit(1)), "k", days=days, block=block).collect()}
    titles = {x.k: x.t for x in df.select("k", X.normalised_title(F.coalesce("article_title", F.lit(""))).alias("t")).collect()}
    seeds, where = [], {}
    for k, c, _, d in sorted(rows, key=lambda x: (x[3] is None, x[3] or 0, x[0])):
        t, best, score = titles[k], -1, 0.0
        for i, (oc, o, od) in enumerate(seeds):
            if oc == c and t and o and not (days is not None and d is not None and od is not None and abs(d - od) > days):
                fits, extra = conflicts.shared_weight(conflicts.Title.of(t), conflicts.Title.of(o))
                ratio = difflib.SequenceMatcher(None, t, o).ratio()
                if (fits or ratio >= 0.6) and ratio + extra > score:
                    best, score = i, ratio + extra
        if best < 0:
            seeds.append((c, t, d))
            best = len(seeds) - 1
        where[k] = best
    sizes = Counter(where.values())
    ids = {k: "CONFLICT_" + hashlib.md5(f"{seeds[b][0] or ''}|{seeds[b][1]}".encode()).hexdigest()[:8] for k, b in where.items()}
    assert got == {k: (ids[k], sizes[b]) for k, b in where.items()}


def test_frequent_words_hardly_meet(spark):
    """A word of all titles is in no pair that nothing else makes."""
    r = __import__("random").Random(3)
    word = lambda: "".join(r.choices("abcdefghijkl", k=7))
    rows = [(i, "p", " ".join(["minería", *[word() for _ in range(7)]])) for i in range(400)]
    pairs = conflicts.word_pairs(spark.createDataFrame(rows, "id long, c string, t string"))
    assert pairs.count() == 0


def test_single_words_make_no_pair(spark):
    """Titles that share one word of seven, however rare it is, don't meet; two of seven do, if both or a third are distinctive."""
    r = __import__("random").Random(4)
    word = lambda: "".join(r.choices("abcdefghijkl", k=8))
    pool = [word() for _ in range(300)]
    rows = [(i, "p", " ".join([f"shared{i // 2}", *r.sample(pool, 6)])) for i in range(200)]
    rows += [(200, "p", "alpha bravo charlie delta"), (201, "p", "alpha bravo x"), (202, "p", "alpha zulu"), (203, "q", "alpha zulu"), (204, "p", "bravo this that mine echo foxtrot golf"), (205, "p", "bravo this that mine hotel india juliet")]
    rows += [(210 + i, "p", " ".join(["kilogram", *[word() for _ in range(45)], *["parliament"] * i])) for i in range(2)] + [(220, "p", f"{rows[0][2].split()[0]} parliament"), (221, "p", "kilogram uniform")]
    some = [word()[: r.choice([3, 4, 4, 5, 8])] for _ in range(90)]
    rows += [(300 + i, r.choice("rs"), " ".join(r.sample(some, r.choice([1, 2, 3, 4, 6, 7, 9, 12, 20, 60])))) for i in range(120)]
    known = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and conflicts.shared_weight(conflicts.Title.of(a[2]), conflicts.Title.of(b[2]))[0]}
    pairs = {(x.a, x.b) for x in conflicts.word_pairs(spark.createDataFrame(rows, "id long, c string, t string")).collect()}
    assert known <= pairs and (204, 205) in known and (200, 202) in known and not {p for p in pairs - known if p[1] < 200}


@pytest.mark.parametrize("block", [4096, 3])
def test_titles_alike_by_characters(spark, block):
    """Pairs by bounds hold all that difflib finds, of one, two and many words of bits, and none that a window or the bounds rule out."""
    import difflib
    import random

    r = random.Random(8)
    text = lambda n: "".join(r.choices("aeiounrst ", k=n)).strip() or "x"
    pool = [text(n) for n in (1, 2, 5, 40, 60, 64, 65, 70, 128, 130, 190, 250, 600, 900)]
    cut = lambda t: "".join(x for x in t if r.random() < 0.7) or "y"
    texts = sorted({f(t) for t in pool for f in (str, cut, cut, lambda t: t[::-1])})
    rows = []
    for i, t in enumerate(texts):
        low = r.randrange(400)
        rows.append((i, r.choice("pq"), t, low, low + r.choice([0, 0, 200]), r.random() < 0.1))
    titles = spark.createDataFrame(rows, "id long, c string, t string, low int, high int, undated boolean")

    def common(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(last[j] + 1 if x == y else max(last[j + 1], now[j]))
            last = now
        return last[-1]

    for days in (50, None):
        got = [(x.a, x.b) for x in conflicts.ratio_pairs(titles, days, block).collect()]
        assert len(got) == len(set(got))
        may = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (days is None or a[5] or b[5] or max(a[3], b[3]) - min(a[4], b[4]) <= days)}
        assert set(got) <= may
        for a, b in may:
            s, t = texts[a], texts[b]
            if max(difflib.SequenceMatcher(None, s, t).ratio(), difflib.SequenceMatcher(None, t, s).ratio()) >= 0.6:
                assert (a, b) in set(got)
            elif (a, b) in set(got) and min(len(s), len(t)) <= conflicts.LONG_TITLE:
                assert 2 * common(s, t) / (len(s) + len(t)) >= 0.6
