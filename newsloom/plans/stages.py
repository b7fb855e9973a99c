"""Whole runs over landed tables: crawl and merge, text, places, analysis. Pages, geocoder answers and boundaries are tables; nothing is fetched here."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import conflicts, growth, places, raster
from ..sources import tables

_A0, _A1, _A2, _A3, _GID = V.ADMIN_COLUMNS


def fetch_texts(rows: DataFrame, pages: DataFrame, row_id: str = "row_id", again: bool = False, limit: int | None = None) -> DataFrame:
    """Rows with article_text and text_status, filled for those (the first ``limit``) that need text; pages: url, html, status."""
    rows = tables.ensure(rows, ["article_text", "text_status"])
    todo = growth.first_needed(rows, growth.needs_text(F.col("article_text"), F.col("text_status"), again), limit, row_id).select(row_id, "article_url")
    landed = growth.one_of_each(pages, ["url"], ["status", "html"])
    got = todo.join(landed, F.col("article_url") == F.col("url"), "left")
    text = F.when(F.col("status") == 200, H.main_text(F.col("html"))).otherwise("")
    status = F.when(F.trim(F.coalesce("article_url", F.lit(""))) == "", "error:no_url").when(F.col("status").isNull(), "error:fetch_failed").otherwise(H.text_status(F.col("_t"), F.col("status")))
    found = got.withColumn("_t", text).select(row_id, F.col("_t").alias("article_text"), status.alias("text_status"))
    return growth.back_filled(rows, found, row_id, ["article_text", "text_status"], "text_status")


def geocode(rows: DataFrame, answers: DataFrame, row_id: str = "row_id", by_country: bool = True, limit: int | None = None) -> DataFrame:
    """Rows with the six geocode columns, filled for those (the first ``limit``) that need coordinates."""
    rows = tables.ensure(rows, [*V.GEOCODE_COLUMNS, "location_context", "location_name"])
    todo = growth.first_needed(rows, places.needs_geocode(F.col("latitude"), F.col("geocode_status")), limit, row_id)
    done = places.geocoded(todo, answers, by_country).select(row_id, *V.GEOCODE_COLUMNS)
    return growth.back_filled(rows, done, row_id, V.GEOCODE_COLUMNS, "geocode_status")


def match_admin(rows: DataFrame, areas: DataFrame, row_id: str = "row_id", again: bool = False, limit: int | None = None) -> DataFrame:
    """Rows with the five admin columns last, resolved for those (the first ``limit``) that need it.

    areas: iso3, level (2 and, for some countries, 3), gid, gid_2, name_1, name_2, name_3, rings, xmin, xmax, ymin, ymax.
    """
    extra = ["article_text", "geocode_precision", "geocode_query", "title"]
    rows = tables.ensure(rows, [*V.ARTICLE_COLUMNS, *extra, *V.ADMIN_COLUMNS])
    either = lambda a, b: F.trim(F.when(F.coalesce(F.col(f"`{a}`"), F.lit("")) != "", F.col(f"`{a}`")).otherwise(F.coalesce(F.col(f"`{b}`"), F.lit(""))))
    country, region = either("country", _A0), either("region_department", _A1)
    precision = places.effective_precision(F.col("geocode_precision"), F.col("geocode_query"), country, region)
    title = X.or_else(F.col("article_title"), F.col("title"))
    needs = places.needs_match(F.col("article_text"), title, F.col("latitude"), F.col("longitude"), F.col(f"`{_GID}`"), precision, again)
    iso3 = F.create_map(*[F.lit(x) for kv in V.ISO3.items() for x in kv])
    todo = growth.first_needed(rows, needs, limit, row_id).select(row_id, country.alias("country"), region.alias("region"), F.try_element_at(iso3, country).alias("iso3"), precision.alias("precision"), "latitude", "longitude", F.trim(F.concat_ws("\n\n", title, "article_text")).alias("text"))
    base = growth.written(todo, "to-match")
    second = areas.where("level = 2").select("iso3", F.col("name_1").alias("region"), F.col("name_2").alias("name"), "gid")
    third = areas.where("level = 3").select("iso3", F.col("gid_2").alias("gid2"), F.col("name_3").alias("name"), "gid")
    coarse = F.col("precision").isin(V.COARSE_PRECISIONS)
    by_point = places.resolve_point(base.where(~coarse), areas, row_id)
    by_text = places.resolve_text(base.where("iso3 is not null").select(row_id, "iso3", "region", "text"), second, third, row_id)
    found = places.resolve(base, by_point, by_text, row_id).select(row_id, F.col("a2").alias(_A2), F.col("a3").alias(_A3), F.col("gid").alias(_GID))
    marked = rows.drop(_A2, _A3, _GID).join(found.withColumn("_done", F.lit(True)), row_id, "left")
    old = rows.select(row_id, *[F.col(f"`{c}`").alias(f"_old{i}") for i, c in enumerate((_A2, _A3, _GID))])
    out = marked.join(old, row_id)
    keep = {c: F.when(F.col("_done"), F.col(f"`{c}`")).otherwise(F.coalesce(F.col(f"_old{i}"), F.lit(""))) for i, c in enumerate((_A2, _A3, _GID))}
    return tables.admin_last(places.admin_columns(out.withColumns(keep).drop("_done", "_old0", "_old1", "_old2")))


def run_all(pages: DataFrame, existing: DataFrame | None = None, areas: DataFrame | None = None, answers: DataFrame | None = None, names: list[str] | None = None, most: int = 50, order: str = "ordinal") -> tuple[DataFrame, DataFrame | None, dict[str, str]]:
    """The combined table after a run, its counters and the sources that failed.

    Articles of the sources among landed pages come after the existing rows (which have ``order``; None starts anew); the first row of
    each id or address stays, latest first; then events, texts, and, where tables of answers and areas are given, coordinates and municipalities.
    """
    fresh, failed = tables.run_sources(pages, names, most)
    spark = pages.sparkSession
    if fresh is None:
        fresh = tables.articles(spark.createDataFrame([], "source string"))
    fresh = growth.written(fresh, "fresh")
    numbered = growth.numbered(fresh, [F.col("source").asc(), *growth.date_order("date_published", "article_url"), F.col("article_id").asc()], order)
    before = tables.articles(spark.createDataFrame([], "source string")).withColumn(order, F.lit(0).cast("long")) if existing is None else existing
    both = growth.written(growth.merged(before, numbered, order), "merged")
    kept = growth.written(growth.first_of_each(both), "kept")
    counts = growth.run_counts(fresh, both, kept, before)
    kept = growth.numbered(kept.drop(order), growth.date_order(), order).drop("row_id")
    out = conflicts.assign(kept, order)
    out = fetch_texts(out, pages, order)
    if answers is not None:
        out = geocode(out, answers, order)
    if areas is not None:
        out = match_admin(out, areas, order)
    return out, counts, failed


def run_analysis(scenes: DataFrame, pixels: DataFrame, area: DataFrame, first: dt.date, last: dt.date, grid: raster.Grid | None = None, store: str | None = None) -> dict[str, DataFrame]:
    """Monthly indices of an area, and what a report needs of them.

    scenes: scene_id, ts, cloud; pixels: scene_id, y, x and bands as stored numbers; area: the mask's pixels (y, x). With a grid, scenes have their own places
    (left, top, step) and boxes (xmin, xmax, ymin, ymax), and area is an area (gid, rings, its box), as ``places.area_of`` gives it: scenes are searched by the padded box, their
    pixels go to the grid, and those in the area count. With a store (a path), months that an earlier run completed aren't computed again, and no pixel
    of theirs is read: what is written of a month counts once it is in the store's list of finished months. A table without one of the bands gives no months.

    Returns ``months`` (pixels' composites with indices), ``series`` (means by month, gaps too), ``ends`` (before, after), ``scales`` (name, vmin, vmax over both ends)
    and ``manifest``.
    """
    spark = pixels.sparkSession
    names = list(raster.indices(*[F.col(b) for b in raster.BANDS]))
    month = F.trunc(F.col("ts").cast("date"), "month").alias("month")
    if grid is not None:
        box = area.agg(F.min("xmin"), F.max("xmax"), F.min("ymin"), F.max("ymax")).first()
        scenes = raster.searched(scenes, raster.padded(*box), first, last)
    usable = raster.usable_scenes(scenes, ["ts", "scene_id"]).select("scene_id", month, *(("left", "top", "step") if grid is not None else ()))
    done = tables.months_done(spark, store) if store else []
    usable = usable.where(~F.col("month").isin(done)) if done else usable
    wanted = {r["scene_id"]: r["month"] for r in usable.select("scene_id", "month").collect()}  # a few for each month
    known = raster.band_columns(pixels)
    if any(b not in known.columns for b in raster.BANDS):
        known = pixels.limit(0).select("scene_id", "y", "x", *[F.lit(None).cast("double").alias(b) for b in raster.BANDS])
    known = known.where(F.col("scene_id").isin(list(wanted)) if wanted else F.lit(False))  # reaches the scan
    if grid is not None:
        known = raster.within(raster.regridded(known, usable, grid), raster.spans(area, grid))
    else:
        known = raster.clipped(known, area)
    inside = known.join(usable.select("scene_id", "month"), "scene_id")
    fresh = raster.with_indices(raster.reflectance(raster.composite(inside, ["month", "y", "x"])))
    monthly = tables.months_added(fresh, store, sorted(set(wanted.values()))) if store else growth.written(fresh, "months")
    means = raster.spatial_mean(monthly, ["month"], names)
    series = raster.on_calendar(means, first, last)
    every = [f"mean_{n}" for n in names]
    ends = raster.before_after(series, every, "month")
    two = ends.first()
    at_ends = monthly.where(F.col("month").isin([d for d in (two["before"], two["after"]) if d is not None]) if two["before"] is not None else F.lit(False))
    scales = None
    for n in names:
        one = raster.shared_scale(at_ends, n).select(F.lit(n).alias("name"), "vmin", "vmax")
        scales = one if scales is None else scales.unionByName(one)
    sections = spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "position long, name string")
    return {"months": monthly, "series": series, "ends": ends, "scales": scales, "manifest": raster.manifest(sections, scales)}
