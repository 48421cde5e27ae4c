"""Operators on hand-made frames whose answers are worked out by hand, and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmere.functions import geometry, parsing, scalars
from gridmere.operators import components, objects, raster, reshape, series, spatial, statistics, tiling


def cells(spark, points, width=100):
    return spark.createDataFrame([(r, c, r * width + c, 1) for r, c in points], "row long, col long, id long, value long")


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_u_shape_across_two_tiles_is_one_object(spark):
    u = [(r, c) for r in range(5) for c in range(5) if c in (0, 4) or r == 4]
    fragments = raster.label_tiles(raster.tiled(cells(spark, u), 4, 5))
    assert fragments.select("fragment").distinct().count() == 3
    whole = raster.merged(fragments, raster.contacts(fragments))
    assert whole.select("object").distinct().count() == 1


@pytest.mark.parametrize(("connectivity", "n"), [(8, 1), (4, 2)])
def test_corner_contact(spark, connectivity, n):
    assert raster.labelled(cells(spark, [(0, 0), (1, 1)]), connectivity).select("object").distinct().count() == n


def test_fragments_of_distant_edges_are_not_merged(spark):
    """One on the right edge at row 2 of the first tile, one on the left edge at row 2 of the tile below."""
    fragments = raster.label_tiles(raster.tiled(cells(spark, [(2, 4), (7, 0)]), 5, 5))
    assert raster.contacts(fragments).count() == 0


    assert raster.contacts_by_code(fragments, 5, 5).count() == 0
    assert raster.contacts_by_code(fragments, 5, 5, own_edges=False).count() == 1  # as such tables were merged


def test_group_maximum_reaches_all_rows(spark):
    df = spark.createDataFrame([(1, 10), (1, 80)], "object long, hydropoly int")
    from pyspark.sql.window import Window

    assert {r["m"] for r in df.withColumn("m", F.max("hydropoly").over(Window.partitionBy("object"))).collect()} == {80}


def test_fill_takes_the_first_clear_year(spark):
    rows = [(0, 0, y, v, c) for y, v, c in ((2018, 1, 90), (2017, 2, 80), (2019, 3, 10), (2016, 4, 0), (2020, 5, 0))]
    df = spark.createDataFrame(rows, "row long, col long, year long, value long, cloud long")
    assert table(raster.cloud_filled(df).filter("year = 2018"), "value", "priority") == [(3, 2)]
    assert table(raster.cloud_filled(df.withColumn("cloud", F.lit(76))).filter("year = 2018"), "value") == [(255,)]


def test_cells_at_the_edge_are_eroded(spark):
    square = [(r, c) for r in range(3) for c in range(3)]
    assert table(raster.eroded(cells(spark, square)), "row", "col") == [(1, 1)]


def test_land_class_at_the_bound(spark):
    df = spark.createDataFrame([(1000, 5000), (999, 1001), (1001, 5000)], "ag int, nat int")
    assert [r[0] for r in df.select(scalars.land_class(F.col("ag"), F.col("nat"))).collect()] == ["other", "natural", "ag"]


def test_both_interval_conventions(spark):
    df = spark.createDataFrame([(4.0,), (5.0,), (5.1,), (None,)], "v double")
    assert [tuple(r) for r in df.select(scalars.size_class(F.col("v"), [5]), scalars.size_class(F.col("v"), [5], "right")).collect()] == [(0, 0), (1, 0), (1, 1), (None, None)]


def test_smoothing_at_the_ends(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 5.0, 10.0, 2.0])], "k int, i int, v double")
    assert [round(r[0], 6) for r in df.select("i", series.smoothed("v", ["k"], ["i"]).alias("s")).orderBy("i").select("s").collect()] == [4.0, 6.0, 5.666667, 6.0]


def test_transition_code(spark):
    df = spark.createDataFrame([("forest", "pasture"), ("crop", "crop"), (None, "crop")], "a string, b string")
    assert [r[0] for r in df.select(scalars.transition_code(F.col("a"), F.col("b"))).collect()] == [10, 1, 0]


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", None), (None, 3.0)], "k string, area_ha double")
    assert [tuple(r) for r in statistics.area_statistics(scalars.null_if_nan(df), ["k"]).collect()] == [("a", 0.0, 0, None)]


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "p double")
    assert [r[0] for r in df.select(scalars.quantized(F.col("p"), 1)).collect()] == [0, 2, 2]


def test_points_on_the_boundary_are_not_within(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))))
    df = spark.createDataFrame([(2.0, 2.0), (4.0, 2.0), (0.0, 0.0), (2.0, 0.0), (5.0, 2.0), (-1.0, 4.0)], "x double, y double").select("*", ring.alias("ring"))
    assert [r[0] for r in df.select(geometry.within(F.col("x"), F.col("y"), F.col("ring"))).collect()] == [True, False, False, False, False, False]
    hole = F.transform("ring", lambda p: F.struct((p["x"] / 4 + 1.5).alias("x"), (p["y"] / 4 + 1.5).alias("y")))
    rings = df.select("*", F.array("ring", hole).alias("rings"))
    assert [r[0] for r in rings.select(geometry.within_polygon(F.col("x"), F.col("y"), F.col("rings"))).collect()] == [False] * 6
    assert rings.select(geometry.polygon_area(F.col("rings"))).first()[0] == 15.0


def test_years_in_names(spark):
    df = spark.createDataFrame([("a_1999_b_2021.tif",), ("none",)], "s string")
    assert [r[0] for r in df.select(parsing.last_year(F.col("s"))).collect()] == [2021, None]
    with pytest.raises(Exception, match="no year"):
        df.select(parsing.last_year(F.col("s"), strict=True)).collect()


def test_parsed_arrays_and_maps(spark):
    df = spark.createDataFrame([("[0 3 4]", "{3: 120, 15: 40}"), ("[]", "{}"), (None, None)], "a string, m string")
    assert [tuple(r) for r in df.select(parsing.number_array(F.col("a")), parsing.count_map(F.col("m"))).collect()] == [([3, 4], {3: 120, 15: 40}), ([], {}), (None, None)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_roots_are_least_members(edges):
    import numpy as np

    a, b = (np.array(x, np.int64) for x in zip(*edges))
    node, root = components.roots(a, b)
    group = {int(n): {int(n)} for n in node}
    for x, y in edges:
        merged = group[x] | group[y]
        for m in merged:
            group[m] = merged
    assert {int(n): int(r) for n, r in zip(node, root)} == {n: min(g) for n, g in group.items()}


def test_distributed_rounds_agree_with_one_task(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert table(components.components(df), "node", "root") == table(components.components(df, one_task=0), "node", "root")


def test_tiles_do_not_change_objects(spark):
    rng = random.Random(9)
    mask = cells(spark, sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(1300)}))
    whole = table(raster.labelled(mask, 8, (64, 64)), "id", "object")
    for tile in ((7, 11), (60, 1), (5, 5)):
        assert table(raster.labelled(mask, 8, tile), "id", "object") == whole
    sizes = raster.object_table(raster.labelled(mask, 8)).agg(F.sum("n_cells")).first()[0]
    assert sizes == mask.count()
    eroded, plain, dilated = (set(table(x, "row", "col")) for x in (raster.eroded(mask), mask, raster.dilated(mask)))
    assert eroded <= plain <= dilated


def test_nearest_is_exact_and_breaks_ties(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(150)] + [(999, 50.0, 50.0)]
    targets = [(i, float(rng.randrange(100)), float(rng.randrange(100))) for i in range(40)] + [(7000, 50.0, 51.0), (6999, 51.0, 50.0), (7001, 49.0, 50.0)]
    p, t = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(targets, "target_id long, tx double, ty double")
    want = sorted((i, min(targets, key=lambda t: (((x - t[1]) ** 2 + (y - t[2]) ** 2) ** 0.5, t[0]))[0]) for i, x, y in points)
    assert table(spatial.nearest(p, t, 5.0), "point_id", "target_id") == want
    assert table(spatial.nearest_small(p, t), "point_id", "target_id") == want
    with pytest.raises(ValueError):
        spatial.nearest_small(p, t, most=10)


def test_union_of_sources_counts_each_object_once(spark):
    left, right = spark.createDataFrame([(1, 5.0), (2, 1.0)], "id long, area double"), spark.createDataFrame([(10, 7.0), (11, 2.0), (12, 3.0)], "id long, area double")
    pairs = spark.createDataFrame([(1, 10), (1, 11)], "left_id long, right_id long")
    assert sorted(tuple(r) for r in objects.union_of_two(left, right, pairs).collect()) == [(1, 10, 7.0, "both"), (2, None, 1.0, "left"), (12, None, 3.0, "right")]


def test_greedy_claims(spark):
    df = spark.createDataFrame([(0, 1, 5, 9), (0, 1, 4, 9), (0, 2, 4, 8), (0, 2, 6, 1), (1, 1, 4, 1)], "image long, truth long, predicted long, cells long")
    assert table(objects.greedy_matches(df), "image", "truth", "predicted") == [(0, 1, 4), (0, 2, 6), (1, 1, 4)]


def test_tile_starts_end_flush(spark):
    index = tiling.tile_index(spark, 10, 4, 4, 1)
    assert table(index, "row_start", "col_start") == [(0, 0), (3, 0), (6, 0)]
    assert table(tiling.tile_index(spark, 11, 3, 4, 1), "row_start", "col_start") == [(0, 0), (3, 0), (6, 0), (7, 0)]


def test_t_quantiles():
    assert abs(geometry.t_quantile(0.975, 1) - 12.7062047364) < 1e-9
    assert abs(geometry.t_quantile(0.95, 9) - 1.8331129327) < 1e-9
    assert geometry.t_quantile(0.025, 5) == -geometry.t_quantile(0.975, 5)


def test_outer_chain_and_transpose(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, a double"), spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, b double")
    assert sorted(tuple(r) for r in statistics.outer_chain({"a": a, "b": b}, "k").collect()) == [(1, 2.0, None), (2, 3.0, 5.0), (3, None, 6.0)]
    t = reshape.transposed(spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "k string, p int, q int"), "k", ["p", "q"], ["x", "y"])
    assert sorted(tuple(r) for r in t.collect()) == [("p", 1, 3), ("q", 2, 4)]


def test_numbering_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = sorted((r["v"], r["id"]) for r in series.numbered(df, ["v"]).collect())
    assert [n for _, n in rows] == list(range(1, 1001))


def test_empty_inputs(spark):
    none = cells(spark, [])
    assert raster.labelled(none).count() == raster.eroded(none).count() == raster.max_filter(none).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert statistics.area_statistics(spark.createDataFrame([], "k string, area_ha double"), ["k"]).count() == 0


def test_median_by_counts(spark):
    rng = random.Random(11)
    rows = [(k, float(rng.randrange(9)) if rng.random() < 0.9 else None) for k in range(12) for _ in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k int, v double").filter("v IS NOT NULL OR k < 12")
    want = table(df.filter("v IS NOT NULL").groupBy("k").agg(F.median("v").alias("median")), "k", "median")
    assert table(statistics.median_by_counts(df, ["k"], "v"), "k", "median") == want


def test_union_by_cell_makes_no_pairs(spark):
    left = spark.createDataFrame([(i, float(i % 7), i % 5) for i in range(0, 300, 3)] + [(9000, None, 0), (9003, 2.0, 77)], "id long, area double, cell long")
    right = spark.createDataFrame([(i, float(i % 11), i % 5) for i in range(1, 300, 3)] + [(9001, None, 0), (9004, 5.0, 78), (9007, None, 79)], "id long, area double, cell long")
    pairs = left.select(F.col("id").alias("left_id"), "cell").join(right.filter("area is not null").select(F.col("id").alias("right_id"), "cell"), "cell")
    columns = "id", "partner", "area", "source"
    matched = right.filter("id <> 9001")  # a null area is the least, so that object is never the partner
    assert sorted(map(repr, table_of(objects.union_by_cell(left, right), columns))) == sorted(map(repr, [*table_of(objects.union_of_two(left, matched, pairs), columns)]))
    many = spark.range(300_000).select("id", F.col("id").cast("double").alias("area"), F.lit(1).alias("cell"))
    found = objects.union_by_cell(many.filter("id % 2 = 0"), many.filter("id % 2 = 1"))  # 2.25e10 pairs
    assert found.agg(F.count("partner"), F.min("partner"), F.max("partner")).first()[:] == (150_000, 299_999, 299_999)


def table_of(df, columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_groups_by_steps_without_pairs(spark):
    """Against all pairs; a square's places are one link, however many."""
    draw = random.Random(8)
    for side in (300, 900):
        places = [(i, float(draw.randrange(-side, side)), float(draw.randrange(-side, side))) for i in range(400)] + [(900, None, 1.0), (901, float("inf"), 1.0), (902, 5000.0, 0.0), (903, 5040.0, 40.0), (904, 5080.0, 0.0), (905, 5121.0, 0.0)]
        group = {i: i for i, *_ in places}

        def root(i, group=group):
            return i if group[i] == i else root(group[i])

        for i, x, y in places:
            for j, u, v in places:
                if None not in (x, u) and abs(x - u) <= 40 and abs(y - v) <= 40:
                    a, b = sorted((root(i), root(j)))
                    group[b] = a
        df = spark.createDataFrame(places, "id long, x double, y double")
        assert dict(table_of(objects.dissolved_near(df, 40.0), ("id", "group"))) == {i: root(i) for i in group}
    crowd = spark.range(200_000).select("id", (F.col("id") % 40).cast("double").alias("x"), F.lit(1.0).alias("y"))  # 2e10 pairs
    assert objects.dissolved_near(crowd, 40.0).select("group").distinct().count() == 1


def test_near_join_measures_only_boxes_in_reach(spark):
    ring = [{"x": float(a), "y": float(b)} for a, b in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))]
    polygons = spark.createDataFrame([(7, ring)], "poly long, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(0, 5.0, 5.0), (1, 12.0, 5.0), (2, 12.0, 12.0), (3, 12.1, 12.2), (4, 90.0, 90.0), (5, None, 1.0), (6, float("nan"), 1.0), (8, -3.0, 5.0)], "point_id long, x double, y double")
    near = spatial.near_join(points, polygons, 100.0, 3.0)
    assert {i: round(a, 6) for i, a in table_of(near, ("point_id", "apart"))} == {0: 0.0, 1: 2.0, 2: round(8**0.5, 6), 8: 3.0}
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hypot") <= plan.count("HYPOT") + 1 if "hypot" in plan else plan.count("HYPOT") == 1  # once, not in a filter too
