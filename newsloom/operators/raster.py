"""Pixel tables: scaling, monthly composites, spectral indices, series, before and after."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .storage import name

BANDS = ["blue", "green", "red", "nir", "swir1"]


def indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column) -> dict[str, Column]:
    """Spectral indices by name; null where a denominator is 0. Published formulas (Rouse 1974, Jiang 2008, Huete 1988,
    Gao 1996, McFeeters 1996, Xu 2006, Zha 2003, Rikimaru 2002)."""
    ratio = lambda a, b: F.try_divide(a - b, a + b)
    return {
        "ndvi": ratio(nir, red), "evi2": F.try_divide(2.5 * (nir - red), nir + 2.4 * red + 1.0),
        "savi": F.try_divide(1.5 * (nir - red), nir + red + 0.5), "ndmi": ratio(nir, swir1),
        "ndwi": ratio(green, nir), "mndwi": ratio(green, swir1), "ndbi": ratio(swir1, nir),
        "bsi": ratio(swir1 + red, nir + blue),
    }


def with_indices(df: DataFrame) -> DataFrame:
    return df.withColumns(indices(*[F.col(b) for b in BANDS]))


def band_columns(df: DataFrame) -> DataFrame:
    """Bands from the asset columns of a scene's generation: of the names that a band can have, the first that the table has."""
    first = {b: next((a for a in names if a in df.columns), None) for b, names in V.BAND_ASSETS.items()}
    return df.withColumns({b: F.col(a) for b, a in first.items() if a and b not in df.columns})


def reflectance(df: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    return df.withColumns({b: F.col(b) * V.SCALE + V.SHIFT for b in bands})


def searched(scenes: DataFrame, box: tuple[float, float, float, float] | None, first: dt.date, last: dt.date, ts: str = "ts") -> DataFrame:
    """Scenes of the months of both dates and between whose box (xmin, xmax, ymin, ymax) meets another, in that order; borders meet."""
    day = F.trunc(F.col(ts).cast("date"), "month")
    out = scenes.where(day.between(F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month")))
    if box is None:
        return out
    xmin, xmax, ymin, ymax = map(float, box)
    return out.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def usable_scenes(scenes: DataFrame, order: list[str], ts: str = "ts", cloud: str = "cloud", n: int = V.SCENES_A_MONTH) -> DataFrame:
    """The first n scenes of each month, in the catalogue's order, among those of few clouds."""
    w = Window.partitionBy(F.date_trunc("month", ts)).orderBy(*order)
    place = name("place", scenes.columns)
    return scenes.where(F.col(cloud) < V.CLOUD_BELOW).withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).drop(place)


@dataclass(frozen=True)
class Grid:
    """Square pixels: column x covers left + x * step to the next, row y covers top - y * step downwards."""

    left: float
    top: float
    step: float = V.PIXEL

    @classmethod
    def of_box(cls, xmin: float, xmax: float, ymin: float, ymax: float, step: float = V.PIXEL) -> Grid:
        """The grid of multiples of the step on which a box lies."""
        return cls(math.floor(xmin / step) * step, math.ceil(ymax / step) * step, step)

    def x(self, column: Column) -> Column:
        """Where the centre of a column is."""
        return F.lit(self.left) + (column + 0.5) * F.lit(self.step)

    def y(self, row: Column) -> Column:
        return F.lit(self.top) - (row + 0.5) * F.lit(self.step)

    def _first(self, centre: Callable[[Column], Column], guess: Column, reached: Callable[[Column], Column]) -> Column:
        """The first index whose centre has reached a place; the guess may be one off by rounding."""
        low = F.ceil(guess) - 1
        return F.when(reached(centre(low)), low).when(reached(centre(low + 1)), low + 1).otherwise(low + 2)

    def column_from(self, x: Column) -> Column:
        """The first column whose centre isn't left of x."""
        return self._first(self.x, (x - self.left) / self.step - 0.5, lambda c: c >= x)

    def row_from(self, y: Column) -> Column:
        """The first row whose centre isn't above y."""
        return self._first(self.y, (F.lit(self.top) - y) / self.step - 0.5, lambda c: c <= y)


def regridded(pixels: DataFrame, scenes: DataFrame, grid: Grid) -> DataFrame:
    """Pixels of scenes on one grid by nearest neighbour: each pixel of the grid takes the pixel of a scene that holds its centre.

    pixels: scene_id, y, x (ints) and values; scenes: scene_id, left, top, step (of its own pixels; north up). All is arithmetic on a row: a
    pixel goes to the few places whose centres it covers, or to none.
    """
    own = scenes.select("scene_id", F.struct("left", "top", "step").alias("of"))
    joined = pixels.join(own, "scene_id")
    left, top = F.col("of.left") + F.col("x") * F.col("of.step"), F.col("of.top") - F.col("y") * F.col("of.step")
    right, bottom = F.col("of.left") + (F.col("x") + 1) * F.col("of.step"), F.col("of.top") - (F.col("y") + 1) * F.col("of.step")
    span = lambda a, z: F.when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<bigint>"))
    columns, rows = span(grid.column_from(left), grid.column_from(right)), span(grid.row_from(top), grid.row_from(bottom))
    at = F.explode(F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct(r.cast("int").alias("y"), c.cast("int").alias("x"))))))
    rest = [c for c in pixels.columns if c.lower() not in ("scene_id", "y", "x")]
    spread = joined.select(F.col("scene_id").alias("scene_id"), F.struct(*rest).alias("values"), at.alias("at")) if rest else joined.select("scene_id", at.alias("at"))
    return spread.select("scene_id", "at.y", "at.x", *[F.col(f"values.`{c}`") for c in rest])


def spans(areas: DataFrame, grid: Grid) -> DataFrame:
    """(gid, y, first, last): the runs of pixels whose centres lie in an area (gid, rings; holes and several parts by the even-odd rule).

    Each edge crosses the rows between its ends; a row's crossings in order are where the area begins and ends in turn. A centre on an edge
    itself counts where the area is right of it or above. Rows of an area are worked on apart, so a large area is no large task.
    """
    point = lambda p, end: [p[0].cast("double").alias(f"x{end}"), p[1].cast("double").alias(f"y{end}")]
    edges = lambda r: F.transform(r, lambda p, i: F.struct(*point(p, 0), *point(F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0))), 1)))
    ends = areas.select("gid", F.explode(F.flatten(F.transform("rings", edges))).alias("e")).select("gid", "e.*").where("y0 <> y1")
    # rows with least < y <= most of the edge's ends, as in (y0 >= y) <> (y1 >= y)
    least, most = F.least("y0", "y1"), F.greatest("y0", "y1")
    begin, after = grid.row_from(most), grid.row_from(least)
    crossed = ends.where(begin < after).select("gid", "x0", "y0", "x1", "y1", F.explode(F.sequence(begin, after - 1)).alias("y"))
    at = (F.col("x1") - F.col("x0")) * (grid.y(F.col("y")) - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    rows = crossed.select("gid", "y", at.alias("at")).groupBy("gid", "y").agg(F.sort_array(F.collect_list("at")).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(grid.column_from(F.get("at", i)).alias("first"), (grid.column_from(F.get("at", i + 1)) - 1).alias("last")))
    return rows.select("gid", F.col("y").cast("int").alias("y"), F.explode(pairs).alias("s")).where("s.first <= s.last").select("gid", "y", F.col("s.first").cast("int").alias("first"), F.col("s.last").cast("int").alias("last"))


def within(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """Pixels (y, x) in one of the runs (y, first, last): an equi-join by row, then a range."""
    r = runs.select(F.col("y").alias("row"), "first", "last")
    return pixels.join(r, (pixels["y"] == r["row"]) & pixels["x"].between(r["first"], r["last"]), "left_semi")


def composite(pixels: DataFrame, by: list[str], bands: list[str] = BANDS) -> DataFrame:
    """The exact median of each band over time, for each pixel and period; gaps (null, NaN) don't count."""
    return pixels.groupBy(*by).agg(*[F.median(F.nanvl(F.col(b), F.lit(None))).alias(b) for b in bands])


def spatial_mean(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(n), F.lit(None))).alias(f"mean_{n}") for n in names])


def clipped(pixels: DataFrame, area: DataFrame) -> DataFrame:
    """Pixels (y, x) of the area's mask."""
    return pixels.join(area, ["y", "x"], "left_semi")


def months(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The months of both dates and between."""
    span = F.sequence(F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month"), F.expr("interval 1 month"))
    return df.sparkSession.range(1).select(F.explode(span).alias("month"))


def on_calendar(series: DataFrame, first: dt.date, last: dt.date, month: str = "month") -> DataFrame:
    """Every month of the span, with nulls where the series has none."""
    out = months(series, first, last).join(series.withColumnRenamed(month, "month"), "month", "left")
    return out.withColumns({"year": F.year("month"), "month_number": F.month("month"), "date": F.date_format("month", "yyyy-MM")})


def before_after(series: DataFrame, names: list[str], at: str = "month") -> DataFrame:
    """First and last period where all are there, and how many have any and all; no periods without two."""
    some, every = F.coalesce(*names).isNotNull(), F.lit(True)
    for n in names:
        every = every & F.col(n).isNotNull()
    out = series.agg(F.min(F.when(every, F.col(at))).alias("before"), F.max(F.when(every, F.col(at))).alias("after"), F.count_if(some).alias("n_any"), F.count_if(every).alias("n_all"))
    two = F.col("before") < F.col("after")
    return out.select(F.when(two, F.col("before")).alias("before"), F.when(two, F.col("after")).alias("after"), "n_any", "n_all")


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = 4096, few: int = 10_000) -> dict[int, float]:
    """The values at some ranks (from 0) of a column without nulls and NaN.

    Values are counted in ever narrower ranges; of a range with few different values these come to the driver with their counts. So nothing is sorted or grouped whole.
    """
    out: dict[int, float] = {}

    def solve(part: DataFrame, low: float, high: float, below: int, wanted: list[int]) -> None:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            groups = part.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).orderBy("v").limit(few).collect() if low < high else []
            at = below
            for r in groups:
                for k in [k for k in wanted if at <= k < at + r["n"]]:
                    out[k] = r["v"]
                at += r["n"]
            for k in wanted:
                out.setdefault(k, low)
            return
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1)).cast("long")
        counts = sorted((r["i"], r["n"], r["lo"], r["hi"]) for r in part.groupBy(at.alias("i")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect())
        for _, n, lo, hi in counts:
            own = [k for k in wanted if below <= k < below + n]
            if own and (lo == hi or n == 1):
                out.update(dict.fromkeys(own, lo))
            elif own and n <= few:
                values = sorted(r[0] for r in part.where(F.col(column).between(lo, hi)).select(column).collect())
                out.update({k: values[k - below] for k in own})
            elif own:
                solve(part.where(F.col(column).between(lo, hi)), lo, hi, below, own)
            below += n

    low, high = df.agg(F.min(column), F.max(column)).first()
    solve(df, float(low), float(high), 0, sorted(set(ranks)))
    return out


def shared_scale(df: DataFrame, column: str) -> DataFrame:
    """Exact 2nd and 98th percentiles (between neighbours in proportion) of the finite values, kept apart; nulls without any."""
    good = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf"))).select(F.col(column).cast("double").alias(column))
    n = good.count()
    both: list[float | None] = [None, None]
    if n:
        at = [q * (n - 1) for q in (0.02, 0.98)]
        found = order_statistics(good, column, [k for x in at for k in (math.floor(x), math.ceil(x))])
        both = [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at]
        both[1] = both[1] if both[1] > both[0] else both[0] + 1e-6
    return df.sparkSession.createDataFrame([tuple(both)], "vmin double, vmax double")


def padded(xmin: float, xmax: float, ymin: float, ymax: float, pad: float = 0.02) -> tuple[float, float, float, float]:
    """The box of an area as scenes are searched for it."""
    return xmin - pad, xmax + pad, ymin - pad, ymax + pad


def manifest(sections: DataFrame, results: DataFrame) -> DataFrame:
    """A report's slides in order (sections: position, name), with what was found for each."""
    return sections.join(results, "name", "left").orderBy("position")
