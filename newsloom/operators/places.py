"""Places: queries for a geocoder, precision, points in polygons, names in texts, resolution of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.html import held
from .growth import one_of_each
from .storage import name


def _t(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def candidate_query(context: Column, name: Column, locality: Column, region: Column, country: Column, by_country: bool) -> Column:
    """struct<query, hint>: the most specific text to look up, and how specific it is."""
    c, r, k = (F.trim(F.coalesce(x, F.lit(""))) for x in (context, region, country))
    n = F.trim(F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.coalesce(locality, F.lit(""))))
    made = lambda q, h: F.struct(q.alias("query"), F.lit(h).alias("hint"))
    joined = F.concat_ws(", ", F.nullif(n, F.lit("")), F.nullif(r, F.lit("")), F.nullif(k, F.lit("")))
    out = F.when(c != "", made(c, "specific")).when(n != "", made(joined, "specific")).when((r != "") & (k != ""), made(F.concat_ws(", ", r, k), "region")).when(r != "", made(r, "region"))
    if by_country:
        out = out.when(k != "", made(k, "country"))
    return out.otherwise(made(F.lit(""), ""))


def address_precision(kind: Column) -> Column:
    k = F.coalesce(kind, F.lit(""))
    out = None
    for label, kinds in V.ADDRESS_PRECISION.items():
        out = F.when(k.isin(kinds), label) if out is None else out.when(k.isin(kinds), label)
    return out.when(k == "", "unknown").otherwise(k)


def capped_precision(precision: Column, hint: Column) -> Column:
    """Never more specific than what was asked."""
    return F.when(hint.isin(V.COARSE_HINTS), hint).otherwise(precision)


def precision_rank(precision: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(precision, F.lit(""))))
    ranks = F.create_map(*[F.lit(x) for kv in V.PRECISION_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, p), F.lit(V.UNKNOWN_RANK))


def effective_precision(precision: Column, query: Column, country: Column, region: Column) -> Column:
    """The stored precision, lowered where the query shows that only region or country was asked."""
    q, c, r = X.normalised(query), X.normalised(country), X.normalised(region)
    return F.when((q != "") & (c != "") & (q == c), "country").when((q != "") & (c != "") & (r != "") & ((q == r) | (q == F.concat_ws(", ", r, c))), "region").otherwise(F.lower(F.trim(F.coalesce(precision, F.lit("")))))


def needs_geocode(latitude: Column, status: Column) -> Column:
    return (F.trim(F.coalesce(latitude, F.lit(""))) == "") & ~F.coalesce(status, F.lit("")).eqNullSafe(F.lit("no_location"))


def needs_match(text: Column, title: Column, latitude: Column, longitude: Column, gid: Column, precision: Column, again: bool = False) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    some = ~blank(text) | ~blank(title) | ((F.trim(F.coalesce(latitude, F.lit(""))) != "") & (F.trim(F.coalesce(longitude, F.lit(""))) != ""))
    return some & (blank(gid) | F.lit(again) | precision.isin(V.COARSE_PRECISIONS))


def geocoded(df: DataFrame, answers: DataFrame, by_country: bool = False) -> DataFrame:
    """Rows with the six geocode columns filled from answers (query, iso2, lat, lon, precision, display_name; lat null: none found)."""
    own = name("asked", df.columns)
    key, hit = name("key", [*df.columns, own]), name("answer", [*df.columns, own])
    iso2 = F.create_map(*[F.lit(x) for kv in V.ISO2.items() for x in kv])
    query = candidate_query(F.col("location_context"), F.col("location_name"), F.col("locality"), F.col("region_department"), F.col("country"), by_country)
    asked = F.struct(query.alias("q"), F.coalesce(F.try_element_at(iso2, _t("country")), F.lit("")).alias("iso2"), needs_geocode(F.col("latitude"), F.col("geocode_status")).alias("need"))
    said = one_of_each(answers, ["query", "iso2"], ["lat", "lon", "precision", "display_name"]).select(F.struct("query", "iso2").alias(key), F.struct("lat", "lon", "precision", "display_name").alias(hit))
    got = df.withColumn(own, asked).join(said, (F.col(f"{own}.q.query") == F.col(f"{key}.query")) & (F.col(f"{own}.iso2") == F.col(f"{key}.iso2")), "left")
    need, text, lat = F.col(f"{own}.need"), F.col(f"{own}.q.query"), F.col(f"{hit}.lat")
    found = need & (text != "") & lat.isNotNull()
    status = F.when(~need, F.col("geocode_status")).when(text == "", "no_location").when(lat.isNull(), "not_found").otherwise("ok")
    put = lambda new, old: F.when(found, new).otherwise(F.col(old))
    out = got.withColumns({"latitude": put(X.six_decimals(lat), "latitude"), "longitude": put(X.six_decimals(F.col(f"{hit}.lon")), "longitude"), "geocode_precision": put(capped_precision(F.col(f"{hit}.precision"), F.col(f"{own}.q.hint")), "geocode_precision"), "geocode_query": put(text, "geocode_query"), "geocode_display_name": put(F.col(f"{hit}.display_name"), "geocode_display_name"), "geocode_status": status})
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def inside(x: np.ndarray, y: np.ndarray, rings: list) -> np.ndarray:
    """Strictly inside by even-odd rays over all rings (holes and several parts included); borders are outside."""
    odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        p = np.asarray([list(q) for q in ring], float) if not (isinstance(ring, np.ndarray) and ring.dtype != object) else ring
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0)):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            edge |= (cross == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd & ~edge


#: Bytes of areas (as Arrow) that are broadcast to the workers; beyond it areas meet their points by a shuffle
AREAS_BROADCAST = 64 << 20


def in_polygons(points: DataFrame, areas: DataFrame, key: str, on: list[str], grid: float = 1.0, most: int = AREAS_BROADCAST) -> DataFrame:
    """(key, gid) of the first area (by gid) that holds each point (x, y), null without one.

    Areas (gid, rings: array<array<array<double>>>, xmin, xmax, ymin, ymax, and the columns of ``on``; gids are unique) are dealt to
    the grid squares of their boxes, points to their square: an equi-join of boxes, whatever the sizes; then the box, then exact rays. Rings
    don't go along with each point: they are broadcast while they are small, by a check of their size, and else grouped with the points
    of their area, at most a slice of an area's points in a task.
    """
    square = lambda c: F.floor(c / grid).cast("long")
    spread = areas.drop("rings").withColumn("_gx", F.explode(F.sequence(square(F.col("xmin")), square(F.col("xmax"))))).withColumn("_gy", F.explode(F.sequence(square(F.col("ymin")), square(F.col("ymax")))))
    placed = points.withColumns({"_gx": square(F.col("x")), "_gy": square(F.col("y"))})
    near = placed.join(spread, [*on, "_gx", "_gy"]).where("x between xmin and xmax and y between ymin and ymax").select(key, "x", "y", "gid")
    size = areas.agg(F.sum(F.expr("aggregate(rings, 0L, (n, r) -> n + 16 * size(r)) + 64"))).first()[0] or 0
    if size <= most:
        rings = {r["gid"]: [np.asarray([list(q) for q in ring], float) for ring in r["rings"]] for r in areas.select("gid", "rings").collect()}
        shared = points.sparkSession.sparkContext.broadcast(rings)

        @F.pandas_udf("boolean")
        def holds(x: pd.Series, y: pd.Series, gid: pd.Series) -> pd.Series:
            out = np.zeros(len(x), bool)
            for g, at in gid.groupby(gid).indices.items():
                out[at] = inside(x.to_numpy()[at], y.to_numpy()[at], shared.value[g])
            return pd.Series(out)

        found = near.where(holds("x", "y", "gid"))
    else:
        slices = 64
        dealt = near.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
        wide = areas.select(F.col("gid").alias("_area"), "rings", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("_part"))
        kinds = dict(points.dtypes)

        def test(rows: pa.Table, area: pa.Table) -> pa.Table:
            ok = np.zeros(rows.num_rows, bool)
            if rows.num_rows and area.num_rows:
                ok = inside(rows["x"].to_numpy(), rows["y"].to_numpy(), area["rings"][0].as_py())
            return rows.select([key, "gid"]).filter(pa.array(ok))

        found = dealt.groupBy("gid", "_slice").cogroup(wide.groupBy("_area", "_part")).applyInArrow(test, f"{key} {kinds[key]}, gid string")
    hit = found.groupBy(key).agg(F.min("gid").alias("gid"))
    return points.select(key).join(hit, key, "left")


def in_degrees(areas: DataFrame, crs: str) -> DataFrame:
    """Areas with rings and boxes in degrees, from degrees (EPSG:4326) or spherical Mercator metres (EPSG:3857)."""
    if crs == "EPSG:4326":
        return areas
    if crs != "EPSG:3857":
        raise ValueError(f"{crs} is not known; reproject the boundaries first")
    lon = lambda x: x / 6378137.0 * (180 / np.pi)
    lat = lambda y: (2 * F.atan(F.exp(y / 6378137.0)) - np.pi / 2) * (180 / np.pi)
    rings = F.transform("rings", lambda r: F.transform(r, lambda q: F.array(lon(q[0]), lat(q[1]))))
    return areas.withColumns({"rings": rings, "xmin": lon(F.col("xmin")), "xmax": lon(F.col("xmax")), "ymin": lat(F.col("ymin")), "ymax": lat(F.col("ymax"))})


def area_of(areas: DataFrame, gid: str) -> DataFrame:
    """The area of an id, with the label of its own level, else the second, else the first; an error if there is none."""
    level = gid.split("_")[0].count(".")
    found = areas.where((F.col("gid") == gid) & (F.col("level") == level))
    if found.isEmpty():
        raise ValueError(f"there is no area {gid} of level {level}")
    names = [n for n in dict.fromkeys((f"name_{level}", "name_2", "name_1")) if n in areas.columns]
    return found.withColumn("label", F.col(names[0]) if names else F.lit(gid))


def resolve_point(rows: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """(key, a2, a3, gid) of rows (key, iso3, latitude, longitude as text) with usable coordinates.

    areas: iso3, level, gid, name_2, name_3 and what in_polygons takes. Countries of a third level are searched there if it is loaded, else on the second.
    """
    points = rows.select(key, "iso3", X.number(F.col("longitude")).alias("x"), X.number(F.col("latitude")).alias("y")).where("x is not null and y is not null and iso3 is not null")
    third = areas.where(F.col("iso3").isin(V.THIRD_LEVEL) & (F.col("level") == 3)).select("iso3").distinct().withColumn("_deep", F.lit(True))
    used = areas.join(third, "iso3", "left").where(F.col("level") == F.when(F.col("_deep"), 3).otherwise(2)).drop("_deep")
    hit = in_polygons(points, used.select("iso3", "gid", "rings", "xmin", "xmax", "ymin", "ymax"), key, ["iso3"]).where("gid is not null")
    names = used.select("gid", F.coalesce("name_2", F.lit("")).alias("a2"), F.when(F.col("level") == 3, F.coalesce("name_3", F.lit(""))).otherwise("").alias("a3"))
    return hit.join(names, "gid").select(key, "a2", "a3", "gid")


_WORD = r"[\p{L}\p{N}_]"
_GAP = r"[^\p{L}\p{N}_]"


def _running(lengths: Column, block: int = 256) -> Column:
    """Sum of what is before each element; by blocks, since appending copies an array."""
    ahead = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: ahead(F.slice(lengths, i, block)))
    within = lambda sums, before: F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda x: x + before)
    return held(blocks, lambda bs: held(ahead(F.transform(bs, lambda b: F.element_at(b, -1))), lambda offsets: F.flatten(F.transform(bs, lambda b, i: within(b, F.get(offsets, i))))))


def capital_windows(text: Column, words: int, most: int) -> Column:
    """array<struct<position, window>>: for each word that begins with a capital, where it is and the text from there on, ``words`` words at
    least or ``most`` characters."""
    pieces = F.split(text, rf"(?<!{_WORD})(?=\p{{Lu}})")  # each but perhaps the first begins with a capital

    def made(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: F.length(p).cast("long"))
        each = lambda at, i: F.struct(at.cast("int").alias("position"), F.substring(F.array_join(F.slice(ps, i + 1, words), ""), F.lit(1), F.lit(most)).alias("window"))
        return F.filter(F.transform(_running(sizes), each), lambda w: w["window"].rlike(r"^\p{Lu}"))

    return held(pieces, made)


#: Size of names, about, up to which all tasks get them
NAMES_BROADCAST = 16 << 20


def name_hits(texts: DataFrame, names: DataFrame, key: str, on: list[str], most: int = NAMES_BROADCAST) -> DataFrame:
    """(key, name, gid, position, mentions) of names in texts as proper nouns: whole words, a capital first, whatever other letters' case and accents.

    Texts meet names by whole normalised word sequences: from each capital go as many words as names have, for each number of words that occurs. So a name that begins as
    thousands of others costs nothing, and no pattern is run for a pair. While names are few, by a check of their size, they are broadcast and only hits are shuffled: else the sequences that begin with one frequent word
would all go to a task. Beyond that these short sequences are shuffled, with their place. A name
    counts wherever it begins. Names shorter than four letters or of a country never count; a name that ends in another character needs a
    word right behind it, one that begins in one never counts. Keys of texts are unique; nulls in texts and names mean nothing.
    """
    countries = sorted({X.unicodedata.normalize("NFD", c).encode("ascii", "ignore").decode().lower() for c in V.ISO3})
    more = [c for c in ("region",) if c in names.columns]
    whole = X.normalised(F.col("name"))
    known = names.where((F.length(whole) >= V.SHORTEST_PLACE) & ~whole.isin(countries)).select(F.struct(*on, "name", "gid", *more).alias("of"), F.lower(X.strip_accents(F.col("name"))).alias("whole")).distinct()
    known = known.withColumn("core", F.regexp_replace("whole", f"{_GAP}+$", "")).where(F.col("core").rlike(f"^{_WORD}"))
    n_words = F.size(F.split("core", f"{_GAP}+"))
    shape = known.agg(F.sum(F.length("whole") + 64).alias("size"), F.max(F.length("whole")).alias("longest"), F.sort_array(F.collect_set(n_words)).alias("counts")).first()  # numbers of words: few
    counts = shape["counts"] or [1]
    windows = capital_windows(X.strip_accents(F.coalesce(F.col("text"), F.lit(""))), max(counts), (shape["longest"] or 0) + 1)
    each = texts.select(F.struct(key, *on).alias("row"), F.explode(windows).alias("w"))
    sequences = F.array(*[F.lower(F.regexp_extract("w.window", f"^{_WORD}+(?:{_GAP}+{_WORD}+){{{n - 1}}}", 0)) for n in counts])
    short = each.select("row", "w", F.explode(sequences).alias("core")).where("core <> ''")
    same = [F.col(f"row.{c}") == F.col(f"of.{c}") for c in on]
    sought = known.withColumnRenamed("core", "sought")
    found = short.join(F.broadcast(sought) if (shape["size"] or 0) <= most else sought, [F.col("core") == F.col("sought"), *same])
    tail = F.startswith(F.lower("w.window"), F.col("whole")) & F.substring(F.col("w.window"), F.length("whole") + 1, F.lit(1)).rlike(_WORD)
    hits = found.where((F.col("whole") == F.col("core")) | tail).groupBy("row", "of").agg(F.min("w.position").alias("position"), F.count("*").cast("int").alias("mentions"))
    return hits.select(f"row.{key}", "of.name", "of.gid", "position", "mentions", *[f"of.{c}" for c in more])


def first_mentioned(hits: DataFrame, key: str, least: Column) -> DataFrame:
    """The hit with the least (position, name, gid) among those with enough mentions."""
    best = hits.where(F.col("mentions") >= least).groupBy(key).agg(F.min(F.struct("position", "name", "gid")).alias("_b"))
    return best.select(key, F.col("_b.name").alias("name"), F.col("_b.gid").alias("gid"))


def resolve_text(rows: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """(key, a2, a3, gid) from texts (key, iso3, region, text); boundaries: (iso3, region, name, gid) and (iso3, gid2, name, gid)."""
    rows = rows.select(key, "iso3", "region", "text")
    regions = second.select("iso3", X.normalised(F.col("region")).alias("_r")).distinct()
    r = rows.select(key, "iso3", X.normalised(F.col("region")).alias("_r")).join(regions.withColumn("_known", F.lit(True)), ["iso3", "_r"], "left")
    r = r.withColumn("_narrow", F.coalesce("_known", F.lit(False)) & (F.col("_r") != ""))
    hits = name_hits(rows, second, key, ["iso3"]).withColumn("_hr", X.normalised(F.col("region"))).drop("region")
    hits = hits.join(r.select(key, "_r", "_narrow"), key).where(~F.col("_narrow") | (F.col("_hr") == F.col("_r")))
    a2 = first_mentioned(hits, key, F.when(F.col("_narrow"), 1).otherwise(2)).withColumnsRenamed({"name": "a2", "gid": "gid2"})
    deep = rows.join(a2, key).where(F.col("iso3").isin(V.THIRD_LEVEL)).select(key, "gid2", "text")
    a3 = first_mentioned(name_hits(deep, third, key, ["gid2"]), key, F.lit(1)).withColumnsRenamed({"name": "a3", "gid": "gid3"})
    return a2.join(a3, key, "left").select(key, "a2", F.coalesce("a3", F.lit("")).alias("a3"), F.coalesce("gid3", "gid2").alias("gid"))


def resolve(rows: DataFrame, by_point: DataFrame, by_text: DataFrame, key: str) -> DataFrame:
    """(key, a2, a3, gid): the point where coordinates are precise, else the text; blank where it echoes the country or lies elsewhere.

    rows: key, country, iso3 (null: none known), precision (effective); by_point and by_text: key, a2, a3, gid.
    """
    rows = rows.select(key, "country", "iso3", "precision")
    pack = lambda d, n: d.select(key, F.struct("a2", "a3", "gid").alias(n))
    out = rows.join(pack(by_point, "_p"), key, "left").join(pack(by_text, "_t"), key, "left")
    best = F.coalesce(F.when(~F.col("precision").isin(V.COARSE_PRECISIONS), F.col("_p")), F.col("_t"))
    out = out.withColumn("_b", F.when(F.col("iso3").isNotNull(), best))
    good = F.col("_b").isNotNull() & ~((F.coalesce(F.col("_b.a2"), F.lit("")) != "") & (X.normalised(F.col("_b.a2")) == X.normalised(F.col("country")))) & ((F.coalesce(F.col("_b.gid"), F.lit("")) == "") | F.startswith(F.col("_b.gid"), F.coalesce(F.col("iso3"), F.lit(""))))
    return out.select(key, *[F.when(good, F.coalesce(F.col(f"_b.{c}"), F.lit(""))).otherwise("").alias(c) for c in ("a2", "a3", "gid")])


def admin_columns(df: DataFrame) -> DataFrame:
    """Country and region copied to the admin columns: the first that isn't empty, then trimmed."""
    copy = lambda new, old: F.trim(F.when(F.coalesce(F.col(new), F.lit("")) != "", F.col(new)).otherwise(F.coalesce(F.col(f"`{old}`"), F.lit(""))))
    return df.withColumns({V.ADMIN_COLUMNS[0]: copy("country", V.ADMIN_COLUMNS[0]), V.ADMIN_COLUMNS[1]: copy("region_department", V.ADMIN_COLUMNS[1])})


def boundary_level(gid: Column) -> Column:
    """How deep an area is in the hierarchy: the dots of its id."""
    head = F.split(gid, "_")[0]
    return F.length(head) - F.length(F.replace(head, F.lit("."), F.lit("")))


def children(parents: DataFrame, kids: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents with their children in the hierarchy; parents without any stay."""
    return parents.join(kids, F.col(parent) == F.col(child), "left")
