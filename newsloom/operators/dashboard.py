"""What a dashboard asks of the combined table: derived columns, filters, metrics, roll-ups, texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..sources.tables import ensure
from . import conflicts, places

_GUARANTEED = [*V.ARTICLE_COLUMNS, "conflict_id", "coverage_count", "llm_summary", "geocode_precision", *V.ADMIN_COLUMNS[:4]]


def derived(df: DataFrame) -> DataFrame:
    """With every expected column, and typed date, coverage, lat, lon, theme and summary_display; what doesn't parse is null (coverage: 1)."""
    df = ensure(df, _GUARANTEED)
    return df.withColumns({
        "date": F.col("date_published").try_cast("timestamp_ntz"), "coverage": F.coalesce(F.col("coverage_count").try_cast("double").cast("int"), F.lit(1)),
        "lat": X.number(F.col("latitude")), "lon": X.number(F.col("longitude")),
        "theme": X.or_else(F.col("sector"), F.col("event_type")), "summary_display": X.or_else(F.col("llm_summary"), F.col("source_text_excerpt")),
    })


def filtered(df: DataFrame, chosen: dict[str, list[str]] | None = None, dates: tuple[dt.date, dt.date] | None = None, date: str = "date") -> DataFrame:
    """Rows of the chosen values (an empty choice is none) and dates, both ends at midnight; undated rows go when dates are given."""
    for c, values in (chosen or {}).items():
        if values:
            df = df.where(F.col(f"`{c}`").isin(values))
    if dates:
        df = df.where(F.col(date).between(*[F.lit(d.isoformat()).cast("timestamp_ntz") for d in dates]))
    return df


def counts_by(df: DataFrame, unit: str, theme: str = "theme", date: str = "date", labels: dict[str, str] | None = None) -> DataFrame:
    """Rows by year (or day, month, hour: the start of it) and theme, with the theme's label; undated rows don't count."""
    at = F.year(date).cast("long") if unit == "year" else F.date_format(F.date_trunc(unit, date), "yyyy-MM-dd HH:mm:ss")
    out = df.where(F.col(date).isNotNull()).groupBy(at.alias("period"), F.col(theme).alias("theme")).agg(F.count("*").alias("n"))
    return out.withColumn("label", X.pretty(F.col("theme"), labels or V.SECTOR_LABELS))


def metrics(df: DataFrame, conflict: str, country: str, lat: str, lon: str, date: str) -> DataFrame:
    filled = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
    return df.agg(F.count("*").alias("n_articles"), F.countDistinct(filled(conflict)).alias("n_conflicts"), F.countDistinct(filled(country)).alias("n_countries"), F.count_if(F.col(lat).isNotNull() & F.col(lon).isNotNull()).alias("n_mapped"), F.date_format(F.min(date), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max(date), "yyyy-MM-dd").alias("last_date"))


def map_view(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Centre and zoom: the mean of mapped rows, a wide view without any."""
    both = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    out = both.agg(F.avg(lat).alias("a"), F.avg(lon).alias("b"), F.count("*").alias("n"))
    return out.select(F.coalesce("a", F.lit(-5.0)).alias("center_lat"), F.coalesce("b", F.lit(-65.0)).alias("center_lon"), F.when(F.col("n") > 0, 4).otherwise(3).cast("long").alias("zoom"))


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(f"`{column}`").alias("option")).where(F.trim(F.coalesce("option", F.lit(""))) != "").distinct().orderBy("option")


def table_order(date: str, row_id: str) -> list[Column]:
    return [F.col(date).desc_nulls_last(), F.col(row_id).asc()]


def date_bounds(df: DataFrame, date: str) -> DataFrame:
    """The first and last day of a column, as text."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return df.agg(day(F.min(date)).alias("first_date"), day(F.max(date)).alias("last_date"))


def picker_label(title: Column, municipality: Column, region: Column, n: Column) -> Column:
    """Title (75 characters), place (the region once), number of articles if several."""
    m, r, t = (F.trim(F.coalesce(c, F.lit(""))) for c in (municipality, region, title))
    place = F.concat_ws(", ", F.nullif(m, F.lit("")), F.when((r != "") & (r != m), r))
    head = F.left(F.when(t == "", "(no article title)").otherwise(t), F.lit(75))
    return F.concat(F.when(place != "", F.concat(head, F.lit(" — "), place)).otherwise(head), F.when(n > 1, F.concat(F.lit(" · "), n.cast("string"), F.lit(" articles"))).otherwise(""))


def picker(df: DataFrame, chosen: dict[str, str] | None = None, row_id: str = "row_id") -> DataFrame:
    """A row for each event among the chosen country, region and so on (a blank choice is none), in order of its label.

    Columns: group_key, size, label, and the representative's row_id, coordinates and area id.
    """
    for c, v in (chosen or {}).items():
        if v:
            df = df.where(F.coalesce(F.col(f"`{c}`"), F.lit("")) == v)
    _, region, municipality, _, gid = V.ADMIN_COLUMNS
    df = ensure(df, [*V.ADMIN_COLUMNS, "geocode_precision", "conflict_id"])
    plain = df.withColumns({"_region": F.col(f"`{region}`"), "_municipality": F.col(f"`{municipality}`"), "_gid": F.col(f"`{gid}`"), "_conflict": F.trim(F.coalesce("conflict_id", F.lit(""))), "_row": F.col(row_id)})
    found = conflicts.representative(plain, "_conflict", places.precision_rank(F.col("geocode_precision")), row_id, ["article_title", "_municipality", "_region", "_gid", "_row", "latitude", "longitude"])
    label = picker_label(F.col("article_title"), F.col("_municipality"), F.col("_region"), F.col("size"))
    return found.select("group_key", "size", label.alias("label"), F.col("_row").alias(row_id), "latitude", "longitude", F.col("_gid").alias("gid")).orderBy(F.lower("label"), "group_key")


def _joined_places(places: list[Column]) -> Column:
    return F.concat_ws(" &middot; ", *[F.nullif(X.html_escape(F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit(""))), F.lit("")) for p in places])


def _kind(sector: Column, event: Column) -> Column:
    return F.concat(X.html_escape(X.pretty(sector, V.SECTOR_LABELS)), F.lit(" / "), X.html_escape(X.pretty(event, V.EVENT_LABELS)))


def popup(title: Column, source: Column, date: Column, places: list[Column], sector: Column, event: Column, summary: Column, url: Column) -> Column:
    """A single article's HTML."""
    e = lambda c, n=None: X.html_escape(F.left(F.coalesce(c, F.lit("")), F.lit(n)) if n else F.coalesce(c, F.lit("")))
    day = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("unknown date"))
    where, kind = _joined_places(places), _kind(sector, event)
    return F.concat(F.lit("<b>"), e(title, 120), F.lit("</b><br><small>"), e(source), F.lit(" &middot; "), day, F.lit(" &middot; "), where, F.lit("</small><br><i>"), kind, F.lit("</i><p>"), e(summary, 280), F.lit("</p><a href='"), e(url), F.lit("'>Read source</a>"))


def _item(title: Column, source: Column, date: Column, url: Column) -> Column:
    """An article in a list."""
    day = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("unknown date"))
    text = lambda c: X.html_escape(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("<li><a href='"), text(url), F.lit("'>"), text(source), F.lit(" &middot; "), day, F.lit("</a><br><small>"), text(F.left(title, F.lit(90))), F.lit("</small></li>"))


def popup_items(title: Column, source: Column, date: Column, url: Column) -> Column:
    """A list of a group's articles, latest first: to be used in an aggregate."""
    item = _item(title, source, date, url)
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(date.alias("d"), item.alias("item"))), False), lambda s: s["item"]), "")


def markers(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A marker for each event that has coordinates: group_key, size, lat, lon, color, popup, tooltip.

    df: derived rows (lat, lon, date, summary_display beside the article columns). An event's marker stands where its most precise row is, the first of several; its
    popup is that of its only article, or a heading and the list of all, latest first; a row without an event is one of its own.
    """
    country, region = V.ADMIN_COLUMNS[:2]
    texts = ["conflict_id", "geocode_precision", "article_title", "source", "article_url", "sector", "event_type", "summary_display", country, region]
    df = ensure(df, texts)
    rows = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.struct(F.col(row_id).alias("row"), "lat", "lon", "date", *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(texts)]).alias("r"))
    t = {c: F.col(f"r.t{i}") for i, c in enumerate(texts)}
    group = F.trim(F.coalesce(t["conflict_id"], F.lit("")))
    order = F.struct((-places.precision_rank(t["geocode_precision"])).alias("rank"), F.col("r.row"))
    item = F.struct(F.col("r.date").isNull().alias("undated"), (-F.unix_micros(F.col("r.date").cast("timestamp"))).alias("late"), F.col("r.row"), _item(t["article_title"], t["source"], F.col("r.date"), t["article_url"]).alias("item"))
    found = rows.groupBy(F.when(group == "", F.concat(F.lit("__row"), F.col("r.row").cast("string"))).otherwise(group).alias("group_key")).agg(F.count("*").alias("size"), F.min_by("r", order).alias("r"), F.sort_array(F.collect_list(item)).alias("items"))
    where = [t[country], t[region]]
    one = popup(t["article_title"], t["source"], F.col("r.date"), where, t["sector"], t["event_type"], t["summary_display"], t["article_url"])
    n = F.col("size").cast("string")
    many = F.concat(F.lit("<b>Conflict &middot; "), n, F.lit(" articles</b><br><small>"), _joined_places(where), F.lit(" &middot; <i>"), _kind(t["sector"], t["event_type"]), F.lit("</i></small><ul>"), F.array_join(F.transform("items", lambda i: i["item"]), ""), F.lit("</ul>"))
    colors = F.create_map(*[F.lit(x) for kv in V.SECTOR_COLORS.items() for x in kv])
    tip = F.left(F.coalesce(t["article_title"], F.lit("")), F.lit(110))
    return found.select(
        "group_key", "size", "r.lat", "r.lon", F.coalesce(F.try_element_at(colors, t["sector"]), F.lit("gray")).alias("color"),
        F.when(F.col("size") > 1, many).otherwise(one).alias("popup"), F.when(F.col("size") > 1, F.concat(n, F.lit(" articles · "), tip)).otherwise(tip).alias("tooltip"),
    )


def view(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that there are, codes as labels."""
    labels = {"sector": V.SECTOR_LABELS, "event_type": V.EVENT_LABELS}
    return df.select(*[X.pretty(F.col(c), labels[c]).alias(c) if c in labels else F.col(f"`{c}`") for c in columns if c in df.columns])


def valid_request(start: dt.date, end: dt.date, lat: float | None, lon: float | None) -> str | None:
    """Why an analysis can't be asked for, or None."""
    if start >= end:
        return "the start has to be before the end"
    if lat is None or lon is None:
        return "coordinates are missing"
    return "coordinates are a placeholder" if lat == 0 and lon == 0 else None
