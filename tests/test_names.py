"""Names in texts by word sequences, against patterns."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from newsloom.functions import vocabulary as V
from newsloom.operators import places


def plain(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def brute(texts, names):
    countries = {plain(c).lower() for c in V.ISO3}
    out = {}
    for k, t in texts:
        for n, g in names:
            if len(plain(n).lower().strip()) >= V.SHORTEST_PLACE and plain(n).lower().strip() not in countries:
                found = [m.start() for m in re.finditer(rf"\b{re.escape(plain(n))}\b", plain(t or ""), re.IGNORECASE) if plain(t)[m.start()].isupper()]
                if found:
                    out[k, n, g] = (found[0], len(found))
    return out


def test_names_as_patterns_would_find_them(spark):
    r = random.Random(1)
    words = ["San", "Santa", "Pedro", "de", "Lloc", "Ñaña", "ñaña", "PUERTO", "Puerto", "puerto", "Élan", "élan", "O'Higgins", "x", "rio", "Río", "(Alto)", "2024", "Silva_1"]
    names = [("San Pedro", "1"), ("San Pedro de Lloc", "2"), ("Santa", "3"), ("Ñaña", "4"), ("Puerto", "5"), ("puerto san", "6"), ("Élan", "7"), ("O'Higgins", "8"), ("Lloc, San", "9"), ("San (Alto)", "10"), ("(Alto)", "11"), ("Río", "12"), ("Peru", "13"), ("San-Pedro", "14"), ("2024 San", "15"), ("San Pedro", "1")]
    texts = [(i, r.choice(["", " ", "\n"]).join([""] + [w + r.choice([" ", ", ", "-", "\n", ". ", "'", "  "]) for w in r.choices(words, k=r.randrange(60))])) for i in range(150)]
    texts += [(900, None), (901, ""), (902, "San Pedro"), (903, "Puerto " * 2000 + "San Pedro de Lloc"), (904, "San (Alto)x San Pedro"), (905, "Peru Perú PERU")]
    t = spark.createDataFrame(texts, "position long, text string").withColumns({"iso3": F.lit("X"), "w": F.lit("kept"), "window": F.lit(1)})
    n = spark.createDataFrame([(a, b, "X") for a, b in names] + [("Santa", "other", "Y"), (None, "null", "X")], "name string, gid string, iso3 string")
    hits = places.name_hits(t, n.distinct(), "position", ["iso3"])
    rows = hits.toDF("key", "name", "gid", "at", "mentions").collect()
    assert {(x["key"], x["name"], x["gid"]): (x["at"], x["mentions"]) for x in rows} == brute(texts, names)
    assert places.name_hits(t, n.limit(0), "position", ["iso3"]).count() == 0 == places.name_hits(t.limit(0), n, "position", ["iso3"]).count()


def test_many_names_of_one_first_word(spark):
    """No pattern for a pair: each capital goes on once for each number of words, whatever number of names begins with it."""
    n = spark.createDataFrame([(f"San {chr(97 + i % 26)}{i}", f"g{i}", "X") for i in range(10_000)], "name string, gid string, iso3 string")
    t = spark.createDataFrame([(i, f"En San {chr(97 + i % 26)}{i} y San Juan", "X") for i in range(200)], "k long, text string, iso3 string")
    hits = places.name_hits(t, n, "k", ["iso3"])
    assert sorted((x.k, x.gid, x.position) for x in hits.collect()) == sorted((i, f"g{i}", 3) for i in range(200))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "regexp_instr" not in plan


def test_sequences_of_a_frequent_word_stay_where_they_are(spark):
    """Few names go to the texts; many meet them by a shuffle, with the same hits."""
    n = spark.createDataFrame([("Puerto", "g1", "X"), ("Puerto Alto", "g2", "X")], "name string, gid string, iso3 string")
    t = spark.createDataFrame([(i, "Puerto Puerto Alto " * (i % 5)) for i in range(40)], "k long, text string").withColumn("iso3", F.lit("X"))
    few, many = (places.name_hits(t, n, "k", ["iso3"], most) for most in (places.NAMES_BROADCAST, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 64
    hinted = [h._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") for h in (few, many)]
    assert hinted == [1, 0]


def test_callers_columns_stay_in_geocoding(spark):
    own = {c: F.lit("own") for c in ("_q", "_query", "_hint", "_iso2", "_need", "_lat", "_lon", "asked", "key", "answer", "lat", "query")}
    cols = "k long, location_context string, location_name string, locality string, region_department string, country string, latitude string, longitude string, geocode_precision string, geocode_query string, geocode_display_name string, geocode_status string"
    df = spark.createDataFrame([(1, "", "", "Piedras", "Lima", "Peru", "", "", "", "", "", ""), (2, "", "", "", "", "", "", "", "", "", "", ""), (3, "", "", "Other", "", "Peru", "", "", "", "", "", "")], cols).withColumns(own)
    answers = spark.createDataFrame([("Piedras, Lima, Peru", V.ISO2["Peru"], 1.5, 2.5, "town", "P")], "query string, iso2 string, lat double, lon double, precision string, display_name string")
    out = places.geocoded(df, answers)
    assert out.columns == df.columns
    rows = {r.k: r for r in out.collect()}
    assert {k: (r.latitude, r.geocode_status) for k, r in rows.items()} == {1: ("1.500000", "ok"), 2: ("", "no_location"), 3: ("", "not_found")} and all(r[c] == "own" for r in rows.values() for c in own)
    one = spark.createDataFrame([(1, "Peru", "PER", "town", "x", "y")], "k long, country string, iso3 string, precision string, _p string, _t string")
    hit = spark.createDataFrame([(1, "Lima", "", "PER.1_1")], "k long, a2 string, a3 string, gid string")
    assert places.resolve(one, hit, hit, "k").first().a2 == "Lima"
