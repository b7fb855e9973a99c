"""Grids, runs of pixels in polygons, regridding, months that are done."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import places, raster
from newsloom.plans import stages

AREAS = "gid string, rings array<array<array<double>>>, xmin double, xmax double, ymin double, ymax double"


def area(gid, rings):
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return (gid, [[list(map(float, p)) for p in r] for r in rings], float(min(xs)), float(max(xs)), float(min(ys)), float(max(ys)))


def star(r, x, y, size, n):
    at = np.sort([r.random() * 2 * np.pi for _ in range(n)])
    return [[x + np.cos(a) * size * r.uniform(0.3, 1), y + np.sin(a) * size * r.uniform(0.3, 1)] for a in at]


def test_runs_are_the_centres_inside(spark):
    r = random.Random(1)
    rows = [area(f"g{i}", [star(r, r.uniform(-3, 3), r.uniform(-3, 3), 2, 30), star(r, r.uniform(-3, 3), r.uniform(-3, 3), 1, 9)]) for i in range(6)]
    rows.append(area("square", [[[0.1, 0.1], [2.1, 0.1], [2.1, 2.1], [0.1, 2.1], [0.1, 0.1]], [[0.6, 0.6], [1.1, 0.6], [1.1, 1.1], [0.6, 1.1]]]))  # closed, with a hole
    grid = raster.Grid(-5.0, 5.0, 0.07)
    got = {}
    for s in raster.spans(spark.createDataFrame(rows, AREAS), grid).collect():
        got.setdefault(s.gid, set()).update((s.y, x) for x in range(s.first, s.last + 1))
    n = 143
    y, x = np.divmod(np.arange(n * n), n)
    cx, cy = grid.left + (x + 0.5) * grid.step, grid.top - (y + 0.5) * grid.step
    for gid, rings, *_ in rows:
        inside = places.inside(cx, cy, rings)
        assert got[gid] == set(zip(y[inside].tolist(), x[inside].tolist())), gid
    assert raster.spans(spark.createDataFrame([], AREAS), grid).count() == 0


def test_runs_as_a_semi_join(spark):
    px = spark.createDataFrame([(y, x, "v") for y in range(4) for x in range(5)], "y int, x int, first string")
    runs = spark.createDataFrame([("g", 1, 1, 2), ("g", 1, 4, 4), ("h", 3, 0, 1), ("h", 1, 2, 3)], "gid string, y int, first int, last int")
    assert sorted((r.y, r.x) for r in raster.within(px, runs).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 0), (3, 1)]


def test_regridding_takes_the_pixel_under_each_centre(spark):
    grid = raster.Grid(10.0, 20.0, 0.5)
    scenes = [("same", 10.0, 20.0, 0.5), ("shifted", 9.8, 20.3, 0.5), ("coarse", 9.0, 21.0, 1.7), ("fine", 10.0, 20.0, 0.2)]
    size = {"same": 8, "shifted": 9, "coarse": 4, "fine": 21}
    px = [(s, y, x, float(100 * y + x)) for s, n in size.items() for y in range(n) for x in range(n)]
    got = raster.regridded(spark.createDataFrame(px, "scene_id string, y int, x int, at double"), spark.createDataFrame(scenes, "scene_id string, left double, top double, step double"), grid).collect()
    value = {(r.scene_id, r.y, r.x): r["at"] for r in got}
    assert len(value) == len(got)
    for s, left, top, step in scenes:
        for y in range(8):
            for x in range(8):
                col, row = (10 + (x + 0.5) * 0.5 - left) / step, (top - (20 - (y + 0.5) * 0.5)) / step
                near = {(100 * int(row + e) + int(col + d)) for d in (-1e-9, 1e-9) for e in (-1e-9, 1e-9)}
                if 0 <= col < size[s] and 0 <= row < size[s]:
                    assert value[s, y, x] in near, (s, y, x)


def scene_tables(spark, months, shift):
    """The same ground seen by scenes with or without an origin of their own."""
    r = random.Random(5)
    scenes, px = [], []
    for m in months:
        for k in range(3):
            d = (k - 1 if shift else 0, -k if shift else 0)
            sid = f"s{m}{k}"
            scenes.append((sid, dt.datetime(2023, m, 3 + k), 10.0 * k, 0.0 + d[0] * 0.5, 10.0 - d[1] * 0.5, 0.5, -1.0, 12.0, -1.0, 12.0))
            for y in range(20):
                for x in range(20):
                    ground = [float(8000 + 37 * m + 100 * k + 11 * b + (7 * (x + d[0]) + 13 * (y + d[1])) % 29) for b in range(5)]
                    px.append((sid, y, x, *ground))
    r.shuffle(px)
    return spark.createDataFrame(scenes, "scene_id string, ts timestamp, cloud double, left double, top double, step double, xmin double, xmax double, ymin double, ymax double"), spark.createDataFrame(px, "scene_id string, y int, x int, " + ", ".join(f"{b} double" for b in raster.BANDS))


def means(out):
    return {r.date: tuple(None if r[f"mean_{n}"] is None else round(r[f"mean_{n}"], 12) for n in ("ndvi", "bsi")) for r in out["series"].collect()}


def test_shifted_scenes_give_the_composite_of_aligned_ones(spark):
    """A polygon, scenes of different origin, one grid."""
    grid = raster.Grid(0.0, 10.0, 0.5)
    where = spark.createDataFrame([area("g", [[[2.1, 2.1], [7.9, 2.6], [5.2, 7.3]]])], AREAS)
    span = (dt.date(2023, 1, 1), dt.date(2023, 2, 1))
    a, b = (stages.run_analysis(*scene_tables(spark, (1, 2), shift), where, *span, grid=grid) for shift in (False, True))
    assert means(a) == means(b) and None not in means(a)["2023-01"]
    inside = {(r.y, r.x) for r in a["months"].collect()}
    mask = {(s.y, x) for s in raster.spans(where, grid).collect() for x in range(s.first, s.last + 1)}
    assert inside == mask
    far = spark.createDataFrame([area("g", [[[50, 50], [51, 50], [51, 51]]])], AREAS)
    assert stages.run_analysis(*scene_tables(spark, (1,), False), far, *span, grid=grid)["months"].count() == 0


def test_finished_months_are_not_read_again(spark, tmp_path):
    grid, where = raster.Grid(0.0, 10.0, 0.5), None
    where = spark.createDataFrame([area("g", [[[2.1, 2.1], [7.9, 2.6], [5.2, 7.3]]])], AREAS)
    store = f"file://{tmp_path}/store"
    scenes, pixels = scene_tables(spark, (1, 2, 3), True)
    whole = means(stages.run_analysis(scenes, pixels, where, dt.date(2023, 1, 1), dt.date(2023, 3, 1), grid=grid))
    stages.run_analysis(scenes, pixels, where, dt.date(2023, 1, 1), dt.date(2023, 1, 31), grid=grid, store=store)
    wrong = pixels.withColumn("red", F.when(F.col("scene_id").startswith("s1"), F.raise_error(F.lit("read again"))).otherwise(F.col("red")))
    again = stages.run_analysis(scenes, wrong, where, dt.date(2023, 1, 1), dt.date(2023, 3, 1), grid=grid, store=store)
    assert means(again) == whole
    # a month that was written in part, but not listed, is done again
    os.rename(tmp_path / "store" / "done", tmp_path / "store" / "lost")
    half = tmp_path / "store" / "months" / "month=2023-02-01"
    for f in sorted(half.iterdir())[1:]:
        f.unlink()
    assert means(stages.run_analysis(scenes, pixels, where, dt.date(2023, 1, 1), dt.date(2023, 3, 1), grid=grid, store=store)) == whole


def test_a_table_without_a_band_has_no_months(spark):
    scenes, pixels = scene_tables(spark, (1,), False)
    mask = spark.createDataFrame([(1, 1)], "y int, x int")
    out = stages.run_analysis(scenes, pixels.drop("red"), mask, dt.date(2023, 1, 1), dt.date(2023, 1, 1))
    assert out["months"].count() == 0 and means(out) == {"2023-01": (None, None)}


def test_search_and_grids(spark):
    scenes = spark.createDataFrame([(i, dt.datetime(2023, 1 + i % 4, 5), float(i), float(i) + 1, 0.0, 1.0) for i in range(8)], "k int, ts timestamp, xmin double, xmax double, ymin double, ymax double")
    got = raster.searched(scenes, (2.0, 4.5, 1.0, 3.0), dt.date(2023, 2, 20), dt.date(2023, 4, 1))
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]
    assert raster.padded(0.0, 1.0, 2.0, 3.0) == (-0.02, 1.02, 1.98, 3.02)
    g = raster.Grid.of_box(0.3, 2.0, -1.0, 0.9, 0.5)
    assert (g.left, g.top, g.step) == (0.0, 1.0, 0.5)
    few = raster.usable_scenes(scenes.withColumns({"cloud": F.lit(1.0), "_n": F.lit(3)}), ["ts"], n=1)
    assert "_n" in few.columns and few.count() == 4
