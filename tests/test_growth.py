"""Steps whose memory or time must not grow with the tables: what a join may broadcast, and what a row works out by itself."""

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stitchyard.functions import steps
from stitchyard.operators import histogram, images, lettering, machine, palette, paper, regions

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rows_of_small_files_are_not_broadcast(spark):
    """Files are far smaller than what is made of them: written rounds, pictures, boxes and letters join by sorted keys."""
    px = images.pixels(images.pictures(spark, SF), "label")
    kept = steps.written(px, "growth")
    cells = machine._boxes(spark, SF).withColumn("cx", F.explode(F.expr("sequence(x div 10, (x + w) div 10)")))
    tall = lettering.letters(spark, SF)
    for df, by in ((px, "id"), (kept, "id"), (cells, "page"), (tall, "page")):
        other = df.groupBy(by).agg(F.count("*").alias("n"))
        assert "BroadcastHashJoin" not in plan(df.join(other, by)) and "SortMergeJoin" in plan(df.join(other, by))


def test_components_do_not_look_pixels_up(spark):
    """All columns of a pixel, from the runs alone: the pixels are read once, for their runs."""
    px = spark.createDataFrame([(1, 3, 2, 0, 0, 5), (1, 3, 2, 1, 0, 5), (1, 3, 2, 2, 0, 7), (1, 3, 2, 0, 1, 7), (1, 3, 2, 1, 1, 5), (1, 3, 2, 2, 1, 5)], "id long, w int, h int, x int, y int, label int")
    found = regions.components(px, "growth")
    assert sorted(found.select("x", "y", "w", "h", "label", "comp").collect()) == [(0, 0, 3, 2, 5, 0), (0, 1, 3, 2, 7, 3), (1, 0, 3, 2, 5, 0), (1, 1, 3, 2, 5, 0), (2, 0, 3, 2, 7, 2), (2, 1, 3, 2, 5, 0)]
    assert "Scan ExistingRDD" not in plan(found)


def test_mask_select_works_channels_out_once(spark):
    """No channel is made anew inside the function of another's pixels."""
    text = entry.queries()["mask_select"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(arrays_zip(" in text.lower()


def test_named_colours_meet_in_a_row(spark):
    """The ten names are literals: no row is multiplied, shuffled and grouped."""
    for name in ("nearest_palette_rgb", "nearest_lab_de76", "warm_fill"):
        text = plan(entry.queries()[name](spark, SF))
        assert "Exchange" not in text and "Aggregate" not in text


def test_nearest_embedding_in_single_products(spark, tmp_path):
    """0.009 as a float times 1000 is 9 in single, and 8.9999998 in double precision."""
    e = spark.createDataFrame([(1, 0, [0.0]), (2, 1, [1.0]), (3, 0, [0.009])], "vec_id long, label int, embedding array<float>")
    e.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.near, r.d) for r in palette.nearest_embedding(spark, str(tmp_path)).collect()}
    import numpy as np

    x = int(np.floor(np.float32(0.009) * np.float32(1000)))
    assert x != int(np.floor(float(np.float32(0.009)) * 1000)) and got[3] == (0, x * x)


def test_neighbours_are_compiled(spark):
    """No array of neighbours is made by an interpreted lambda for each pixel: pixels are rows that refer to their image's arrays."""
    for name in ("local_range_3x3", "mode_filter", "boundary_rounds"):
        text = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "explode(sequence(" in text and "lambdafunction(array(" not in text


def test_components_of_small_images_take_no_rounds(spark):
    """An image of one band is labelled in its group: no job a round fills the driver with plans and stages."""
    tracker = spark.sparkContext.statusTracker()
    px = images.picture_pixels(spark, SF, "label")
    spark.sparkContext.setJobGroup("bands", "bands")
    found = regions.components(px, "bands", corners=True)
    assert len(tracker.getJobIdsForGroup("bands")) <= 4 and found.count() == px.count()
    spark.sparkContext._jsc.clearJobGroup()


def test_components_across_bands(spark, monkeypatch):
    """Components that cross borders of bands are the same as in one band, across corners or not."""
    px = images.picture_pixels(spark, SF, "label").filter("id <= 3")
    for corners in (False, True):
        whole = sorted(regions.components(px, "whole", corners).select("id", "x", "y", "comp").collect())
        monkeypatch.setattr(regions, "BAND", 3)
        assert sorted(regions.components(px, "bands", corners).select("id", "x", "y", "comp").collect()) == whole
        monkeypatch.undo()


def test_printed_pixels_are_compiled(spark):
    """The pixels of printed pictures, without a lambda for each."""
    px = paper.printed_pixels(spark, SF)
    assert "lambdafunction" not in plan(px).lower()
    assert sorted(px.collect()) == sorted(images.pixels(paper.printed(spark, SF), "label").collect())


def test_pictures_are_not_tested_for_null(spark):
    """No array of pixels is made for a test of null before the keys are dealt out, which would be in the one task that reads them."""
    text = images.pixels(images.pictures(spark, SF), "label").filter("label = -1")._jdf.queryExecution().optimizedPlan().toString()
    before = text[text.index("RepartitionByExpression") :]
    assert "transform(" not in before and "sequence(" not in before


def test_inks_are_a_row_an_image(spark):
    """Pixels meet their inks by image alone: no shuffle moves them by image and label."""
    px = spark.createDataFrame([(1, 0, 0, 0, [50.0, 9.0, 9.0]), (1, 1, 0, 7, [50.0, 9.0, 9.0])], "id long, x int, y int, label int, lab array<double>")
    inks = spark.createDataFrame([(1, 0, [50.0, 9.0, 9.0])], "id long, label int, ink array<double>")
    found = paper.cores_folded(px, inks)
    assert sorted(found.collect()) == [(1, 0, 0, 0), (1, 1, 0, 7)]
    joins = [line for line in plan(found).split("== Optimized Logical Plan ==")[1].splitlines() if "Join LeftOuter" in line]
    assert joins and not [line for line in joins if "label" in line]


def test_components_of_small_keys_take_no_rounds(spark, monkeypatch):
    """Keys of few edges are rows, whose components take no round however long their chains are; larger keys give the same in rounds."""
    edges = spark.range(120).selectExpr("id % 3 as k", "id div 3 as a", "id div 3 + if(id % 3 = 2 and id div 3 = 20, 0, 1) as b")
    keyed = edges.select(F.struct("k").alias("key"), "a", "b")
    spark.sparkContext.setJobGroup("arrays", "arrays")
    found = sorted(steps.components(keyed, "key", "arrays").select("key.k", "node", "comp").collect())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("arrays")) <= 8
    spark.sparkContext._jsc.clearJobGroup()
    assert {(k, c) for k, n, c in found} == {(0, 0), (1, 0), (2, 0), (2, 21)} and len(found) == 123
    monkeypatch.setattr(steps, "MOST", 39)
    assert sorted(steps.components(keyed, "key", "rounds").select("key.k", "node", "comp").collect()) == found


def test_rims_are_compiled(spark):
    """Rims read their neighbours from a pixel's row; no lambda goes over an image's pixels, before or after its regions are found."""
    images_ = spark.createDataFrame([(1, 2, 1, [0, 1], [0, 0], [20.0, 90.0])], "id long, w int, h int, label array<int>, ext array<int>, luma array<double>")
    assert "lambdafunction" not in plan(paper.rims_folded(images_)).lower()


def test_palettes_are_worked_out_in_rows(spark):
    """No pixel of a palette's images becomes a row, and no image is joined with its own pixels."""
    text = plan(entry.queries()["histogram_palette"](spark, SF))
    assert "Join" not in text and "ObjectHashAggregate" not in text and "sequence(" not in text


def test_channels_are_those_of_pictures(spark):
    rows = images.pictures(spark, SF).select("id", "w", "h", "r", "g", "b").orderBy("id").collect()
    batch = pa.RecordBatch.from_pylist([{c: r[c] for c in ("id", "w", "h")} for r in rows])
    ends, got = images.channels(batch)
    assert len(rows) == 10 and ends.tolist() == np.cumsum([r.w * r.h for r in rows]).tolist()
    assert [v.tolist() for v in got] == [[v for r in rows for v in r[c]] for c in "rgb"]
    assert [len(v) for v in images.channels(batch.slice(0, 0))[1]] == [0, 0, 0]


def test_palettes_of_parts(spark, monkeypatch):
    """An image's pixels are worked out in parts, whatever its size, with the same inks and accent."""
    noise = np.random.default_rng(5)
    px = [np.concatenate([np.full((n, 3), 240), noise.integers(0, 90, (n // 3, 3)), noise.integers(0, 50, (n // 30, 3)) + [200, 20, 0]]) for n in (300, 900, 5000)]
    ends, rgb = np.cumsum([len(p) for p in px]), list(np.concatenate(px).T)
    whole = histogram._palettes(pa.array([7, 8, 9]), ends, rgb)
    monkeypatch.setattr(histogram, "PIXELS", 101)
    assert histogram._palettes(pa.array([7, 8, 9]), ends, rgb).equals(whole)
    alone = [histogram._palettes(pa.array([k + 7]), np.array([len(p)]), list(p.T)) for k, p in enumerate(px)]
    assert [r for a in alone for r in a.to_pylist()] == whole.to_pylist() and all(len(r["inks"]) > 1 for r in whole.to_pylist())
