"""Raster algebra, objects and their merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import objects, raster, reshape, spatial, statistics, tiling
from ..sources.storage import cut
from . import views
from .registry import query, r6

C = views.COLUMNS
#: Tile size of the tiled queries.
TILE = (50, 10)


def _mask(spark, d):
    return views.with_ids(raster.mask_above_percentile(views.grid(spark, d), 0.8))


@query("q25_mask_cells", f"WITH {views.MASK} SELECT row, col, CAST(value AS BIGINT) AS value FROM mask")
def q25(spark, d):
    return raster.mask_above_percentile(views.grid(spark, d), 0.8).select("row", "col", "value")


def _objects_sql(near: str) -> str:
    return f"""WITH RECURSIVE {views.MASK}, e AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON {near}),
  reach(a, b) AS (SELECT id, id FROM mask UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
  label AS (SELECT a AS id, min(b) AS object FROM reach GROUP BY a)
  SELECT object, count(*) AS n_cells, min(row) AS row_start, min(col) AS col_start, max(row) - min(row) + 1 AS box_rows, max(col) - min(col) + 1 AS box_cols,
    round(avg(row), 6) AS center_row, round(avg(col), 6) AS center_col, CAST(max(value) AS BIGINT) AS value_max FROM mask JOIN label USING (id) GROUP BY object"""


_NEAR8, _NEAR4 = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1", "abs(a.row - b.row) + abs(a.col - b.col) <= 1"


def _shown(table):
    return table.select("object", "n_cells", "row_start", "col_start", "box_rows", "box_cols", r6("center_row", "center_row"), r6("center_col", "center_col"), "value_max")


@query("q26_components8", _objects_sql(_NEAR8))
def q26(spark, d):
    return _shown(raster.object_table(raster.labelled(_mask(spark, d), 8)))


@query("q27_components4", _objects_sql(_NEAR4))
def q27(spark, d):
    return _shown(raster.object_table(raster.labelled(_mask(spark, d), 4)))


_SAME_TILE = f"a.row // {TILE[0]} = b.row // {TILE[0]} AND a.col // {TILE[1]} = b.col // {TILE[1]}"
_FRAGMENTS = f"""WITH RECURSIVE {views.MASK}, e AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON {_NEAR8} AND {_SAME_TILE}),
  reach(a, b) AS (SELECT id, id FROM mask UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), f AS (SELECT a AS id, min(b) AS fragment FROM reach GROUP BY a)"""


def _fragments(spark, d):
    return raster.label_tiles(raster.tiled(_mask(spark, d), *TILE), 8)


@query("q28_tile_components", f"{_FRAGMENTS} SELECT CAST(row // {TILE[0]} AS INTEGER) AS tile_row, CAST(col // {TILE[1]} AS INTEGER) AS tile_col, fragment, count(*) AS n_cells FROM f JOIN mask USING (id) GROUP BY ALL")
def q28(spark, d):
    return _fragments(spark, d).groupBy("tile_row", "tile_col", "fragment").agg(F.count(F.lit(1)).alias("n_cells"))


def _merged_sql(near: str, variant: str) -> str:
    return f"""SELECT '{variant}' AS variant, object, count(*) AS n_cells, CAST(max(value) AS BIGINT) AS value_max FROM (
    WITH RECURSIVE l AS (SELECT DISTINCT fa.fragment AS a, fb.fragment AS b FROM mask a JOIN mask b ON {near} JOIN f fa ON fa.id = a.id JOIN f fb ON fb.id = b.id WHERE NOT ({_SAME_TILE})),
    r(a, b) AS (SELECT fragment, fragment FROM f UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT mask.id, value, o.object FROM mask JOIN f USING (id) JOIN (SELECT a AS fragment, min(b) AS object FROM r GROUP BY a) o USING (fragment)) GROUP BY object"""


@query("q29_border_merge", f"{_FRAGMENTS} {_merged_sql(_NEAR8, 'diagonal')} UNION ALL {_merged_sql(_NEAR4, 'offset')}")
def q29(spark, d):
    fragments, _ = cut(_fragments(spark, d))
    out = []
    for name, diagonal in (("diagonal", True), ("offset", False)):
        whole = raster.merged(fragments, raster.contacts(fragments, 8, diagonal, TILE))
        out.append(whole.groupBy(F.lit(name).alias("variant"), "object").agg(F.count(F.lit(1)).alias("n_cells"), F.max("value").alias("value_max")))
    return reshape.stacked(*out)


_CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(r, c)"


@query("q30_erode_dilate", f"""WITH {views.MASK} SELECT 'eroded' AS op, m.row, m.col FROM mask m CROSS JOIN {_CROSS} JOIN mask n ON n.row = m.row + r AND n.col = m.col + c GROUP BY ALL HAVING count(*) = 5
  UNION ALL SELECT DISTINCT 'dilated', row + r, col + c FROM mask CROSS JOIN {_CROSS}""")  # fmt: skip
def q30(spark, d):
    mask = _mask(spark, d)
    return raster.eroded(mask).select(F.lit("eroded").alias("op"), "row", "col").unionByName(raster.dilated(mask).select(F.lit("dilated").alias("op"), "row", "col"))


@query("q31_maxfilter", f"WITH {views.GRID} SELECT a.row, a.col, CAST(max(b.value) AS BIGINT) AS value FROM grid a JOIN grid b ON b.row BETWEEN a.row - 5 AND a.row + 4 AND b.col BETWEEN a.col - 5 AND a.col + 4 GROUP BY a.row, a.col")
def q31(spark, d):
    return raster.max_filter(views.grid(spark, d), 10)


@query("q32_cloud_mask_fill", f"""WITH {views.WEEKS}, o AS (SELECT a.row, a.col, a.year, b.value, CASE WHEN b.cloud <= 75 THEN CASE WHEN b.year = a.year THEN 0 WHEN b.year < a.year THEN 2 * (a.year - b.year) - 1 ELSE 2 * (b.year - a.year) END END AS k
    FROM weeks a JOIN weeks b ON a.row = b.row AND a.col = b.col AND abs(a.year - b.year) <= 2),
  f AS (SELECT row, col, year, arg_min(value, k) AS value, min(k) AS priority FROM o GROUP BY ALL)
  SELECT f.row, f.col, f.year, CAST(coalesce(f.value, 255) AS BIGINT) AS value, CAST(priority AS BIGINT) AS priority, CAST(CASE WHEN cloud > 50 THEN 255 ELSE w.value END AS BIGINT) AS masked FROM f JOIN weeks w USING (row, col, year)""")  # fmt: skip
def q32(spark, d):
    weeks = views.weeks(spark, d)
    masked = raster.cloud_masked(weeks, F.col("cloud")).select("row", "col", "year", F.col("value").cast("long").alias("masked"))
    filled = raster.cloud_filled(weeks).select("row", "col", "year", F.col("value").cast("long").alias("value"), F.col("priority").cast("long").alias("priority"))
    return filled.join(masked, ["row", "col", "year"])


_CLASS = "CASE value " + " ".join(f"WHEN '{t}' THEN {scalars.CLASS_ORDER.index(c)}" for t, c in views.TYPE_CLASS.items()) + " END"


@query("q33_recode_transition", f"""WITH {views.HISTORY}, c AS (SELECT row, year, {_CLASS} AS k FROM history), t AS (SELECT year, 5 * k + lead(k) OVER w + 1 AS code FROM c WINDOW w AS (PARTITION BY row ORDER BY year))
  SELECT CAST(year AS INTEGER) AS year, {', '.join(f'count(*) FILTER (WHERE code = {i}) AS t{i}' for i in range(1, 26))} FROM t WHERE code IS NOT NULL GROUP BY year""")  # fmt: skip
def q33(spark, d):
    name = scalars.mapped(F.col("value"), views.TYPE_CLASS)
    changes = raster.transitions(views.class_history(spark, d), ["row"], "year", name)
    return reshape.wide(changes, ["year"], "code", range(1, 26), F.count(F.lit(1)), "t").na.fill(0)


@query("q34_last_different", f"""WITH {views.HISTORY}, f AS (SELECT row, value AS final_value FROM history WHERE year = 30)
  SELECT row, final_value, CAST(max(year) FILTER (WHERE value <> final_value AND year < 30) AS INTEGER) AS changed_at, arg_max(value, year) FILTER (WHERE value <> final_value AND year < 30) AS value_before FROM history JOIN f USING (row) GROUP BY row, final_value""")  # fmt: skip
def q34(spark, d):
    return raster.last_different(views.class_history(spark, d), 30, ["row"])


@query("q35_constant_run", f"""WITH {views.HISTORY}, n AS (SELECT row, year, value, coalesce(CAST(value <> lag(value) OVER w AS INTEGER), 0) AS new FROM history WINDOW w AS (PARTITION BY row ORDER BY year)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY year) AS run FROM n)
  SELECT row, CAST(run AS BIGINT) AS run, any_value(value) AS value, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, count(*) AS n FROM r GROUP BY row, run""")  # fmt: skip
def q35(spark, d):
    runs = raster.constant_runs(views.class_history(spark, d), ["row"])
    return runs.groupBy("row", "run").agg(F.min("value").alias("value"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n"))


@query("q36_mosaic_avg", f"""WITH {views.GRID}, p AS (SELECT row, col, CASE WHEN value = 0 THEN 255 ELSE value END AS value FROM grid WHERE row % 40 < 25 UNION ALL SELECT row, col, CASE WHEN value % 3 = 0 THEN 255 ELSE value + 3 END FROM grid WHERE row % 40 >= 15)
  SELECT row, col, CAST(coalesce(floor(avg(value) FILTER (WHERE value <> 255)), 255) AS INTEGER) AS mean, CAST(max(value) AS BIGINT) AS most FROM p GROUP BY row, col""")  # fmt: skip
def q36(spark, d):
    g = views.grid(spark, d)
    a = g.filter("row % 40 < 25").withColumn("value", F.when(F.col("value") == 0, 255).otherwise(F.col("value")))
    b = g.filter("row % 40 >= 15").withColumn("value", F.when(F.col("value") % 3 == 0, 255).otherwise(F.col("value") + 3))
    mean = raster.mosaic_mean(a.unionByName(b)).withColumnRenamed("value", "mean")
    return mean.join(raster.mosaic_max(a, b).select("row", "col", F.col("value").cast("long").alias("most")), ["row", "col"])


@query("q37_band_prep", f"""WITH {views.BANDS}, s AS (SELECT band, quantile_cont(v, 0.8) AS p80, min(v) AS low, avg(v) AS mean, stddev_samp(v) AS std FROM bands GROUP BY band),
  b AS (SELECT band, v, p80, low, mean, std, round_even(255 * (least(v, p80) - low) / (p80 - low), 0) AS byte FROM bands JOIN s USING (band))
  SELECT band, round(any_value(p80), 6) AS p80, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, CAST(sum(byte) AS BIGINT) AS bytes, round(sum(abs((v - mean) / std)), 4) AS standardized FROM b GROUP BY band""")  # fmt: skip
def q37(spark, d):
    bands = views.bands(spark, d)
    stats = bands.groupBy("band").agg(F.percentile("v", F.lit(0.8)).alias("p80"), F.min("v").alias("low"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    v = bands.join(F.broadcast(stats), "band").withColumns({"byte": scalars.rescaled(F.col("v"), F.col("low"), F.col("p80")), "z": scalars.standardized(F.col("v"), F.col("mean"), F.col("std"))})
    return v.groupBy("band").agg(r6(F.any_value("p80"), "p80"), r6(F.any_value("mean"), "mean"), r6(F.any_value("std"), "std"), F.sum("byte").cast("long").alias("bytes"), F.round(F.sum(F.abs("z")), 4).alias("standardized")).withColumn("band", F.col("band").cast("long"))


@query("q51_label_overlaps", f"""WITH RECURSIVE {views.MASK}, high AS (SELECT * FROM mask WHERE value > (SELECT quantile_cont(value, 0.9) FROM grid)),
  e AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON {_NEAR8}), r(a, b) AS (SELECT id, id FROM mask UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a AS id, min(b) AS object FROM r GROUP BY a),
  e2 AS (SELECT a.id AS a, b.id AS b FROM high a JOIN high b ON {_NEAR8}), r2(a, b) AS (SELECT id, id FROM high UNION SELECT r2.a, e2.b FROM r2 JOIN e2 ON r2.b = e2.a), l2 AS (SELECT a AS id, min(b) AS other FROM r2 GROUP BY a),
  o AS (SELECT object, count(*) AS size, count(DISTINCT other) AS n FROM l LEFT JOIN l2 USING (id) GROUP BY object)
  SELECT CAST(sum(size) AS DOUBLE) AS total_area, round(avg(size), 6) AS mean_size, count(*) AS count, CAST(coalesce(sum(size) FILTER (WHERE n > 0), 0) AS DOUBLE) AS overlap_total_area, round(avg(size) FILTER (WHERE n > 0), 6) AS overlap_mean_size, count(*) FILTER (WHERE n > 0) AS overlap_count,
    CAST(coalesce(sum(size) FILTER (WHERE n = 0), 0) AS DOUBLE) AS no_overlap_total_area, round(avg(size) FILTER (WHERE n = 0), 6) AS no_overlap_mean_size, count(*) FILTER (WHERE n = 0) AS no_overlap_count FROM o""")  # fmt: skip
def q51(spark, d):
    base = raster.labelled(_mask(spark, d), 8)
    other = raster.labelled(views.with_ids(raster.mask_above_percentile(views.grid(spark, d), 0.9)), 8)
    split = statistics.overlap_split(objects.label_overlaps(base, other), [], F.size("overlaps") > 0, "size")
    return split.select(*(r6(c, c) if "mean" in c else F.col(c).cast("double").alias(c) if "area" in c else F.col(c) for c in split.columns))


@query("q52_resample", f"""WITH {views.GRID}, up AS (SELECT row * 3 + a AS row, col * 3 + b AS col, value FROM grid CROSS JOIN (SELECT unnest(range(0, 3)) AS a) CROSS JOIN (SELECT unnest(range(0, 3)) AS b))
  SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM up GROUP BY ALL""")  # fmt: skip
def q52(spark, d):
    return raster.resampled_down(raster.resampled_up(views.grid(spark, d), 3), 2)


@query("q53_tile_index", """WITH r AS (SELECT DISTINCT s FROM (SELECT unnest(range(0, 1000 - 128 + 1, 112)) AS s UNION ALL SELECT 1000 - 128)), c AS (SELECT DISTINCT s FROM (SELECT unnest(range(0, 700 - 128 + 1, 112)) AS s UNION ALL SELECT 700 - 128)),
  done AS (SELECT DISTINCT 112 * (user_id % 4) AS row_start, 112 * (user_id % 3) AS col_start FROM events)
  SELECT CAST(r.s AS INTEGER) AS row_start, CAST(c.s AS INTEGER) AS col_start FROM r CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM done WHERE row_start = r.s AND col_start = c.s)""")  # fmt: skip
def q53(spark, d):
    from ..sources.storage import parquet_table, pending

    done = parquet_table(spark, d, "events").select((112 * (F.col("user_id") % 4)).cast("int").alias("row_start"), (112 * (F.col("user_id") % 3)).cast("int").alias("col_start"))
    return pending(tiling.tile_index(spark, 1000, 700, 128, 16), done, ["row_start", "col_start"])


def _evaluated(spark, d):
    """Images are days of ten columns: truth is the mask above 0.8, predictions that of the day before, shifted in."""
    truth = raster.labelled(_mask(spark, d), 4).select("row", "col", F.col("object").alias("truth"))
    shifted = views.with_ids(raster.mask_above_percentile(views.grid(spark, d), 0.8).withColumn("col", (F.col("col") + 1) % C))
    predicted = raster.labelled(shifted, 4).select("row", "col", F.col("object").alias("predicted"))
    return truth.join(predicted, ["row", "col"], "full").select(F.floor(F.col("row") / 50).alias("image"), "row", "col", "truth", "predicted")


_SHIFT = _objects_sql(_NEAR4).split(", e AS", 1)[0] + f""", s AS (SELECT row, (col + 1) % {C} AS col, row * {C} + (col + 1) % {C} AS id FROM mask),
  e AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON {_NEAR4}), r(a, b) AS (SELECT id, id FROM mask UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), t AS (SELECT a AS id, min(b) AS truth FROM r GROUP BY a),
  e2 AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON {_NEAR4}), r2(a, b) AS (SELECT id, id FROM s UNION SELECT r2.a, e2.b FROM r2 JOIN e2 ON r2.b = e2.a), p AS (SELECT a AS id, min(b) AS predicted FROM r2 GROUP BY a),
  cells AS (SELECT id // {C} // 50 AS image, id, truth, predicted FROM t FULL JOIN p USING (id))"""


@query("q54_object_iou", f"""{_SHIFT}, z AS (SELECT image, truth, count(*) AS cells, count(predicted) AS overlap FROM cells WHERE truth IS NOT NULL GROUP BY ALL HAVING count(*) > 2),
  q AS (SELECT image, predicted, count(*) AS n FROM cells WHERE predicted IS NOT NULL GROUP BY ALL), x AS (SELECT DISTINCT image, truth, predicted FROM cells WHERE truth IS NOT NULL AND predicted IS NOT NULL),
  w AS (SELECT image, truth, sum(n) AS touching FROM x JOIN q USING (image, predicted) GROUP BY ALL)
  SELECT image, truth, cells, CAST(coalesce(touching, 0) AS BIGINT) AS touching, overlap, round(overlap / (cells + coalesce(touching, 0) - overlap), 6) AS iou FROM z LEFT JOIN w USING (image, truth)""")  # fmt: skip
def q54(spark, d):
    return objects.object_iou(_evaluated(spark, d), 2).select("image", "truth", "cells", "touching", "overlap", r6("iou", "iou"))


@query("q55_greedy_matches")
def q55(spark, d):
    met = _evaluated(spark, d).filter("truth IS NOT NULL AND predicted IS NOT NULL").groupBy("image", "truth", "predicted").agg(F.count(F.lit(1)).alias("cells"))
    return objects.greedy_matches(met)


@query("q56_nearest_fill", f"""WITH {views.GRID}, k AS (SELECT * FROM grid WHERE value > 2), m AS (SELECT * FROM grid WHERE value <= 2),
  n AS (SELECT m.row, m.col, k.value, row_number() OVER (PARTITION BY m.row, m.col ORDER BY (m.row - k.row) * (m.row - k.row) + (m.col - k.col) * (m.col - k.col), k.row, k.col) AS p FROM m CROSS JOIN k)
  SELECT row, col, CAST(value AS BIGINT) AS value FROM n WHERE p = 1 UNION ALL SELECT row, col, CAST(value AS BIGINT) FROM k""")  # fmt: skip
def q56(spark, d):
    g = views.grid(spark, d)
    return spatial.nearest_fill(g.select("row", "col", F.when(F.col("value") > 2, F.col("value")).alias("value")))


@query("q57_median_composite", f"""WITH {views.WEEKS}, m AS (SELECT row, col, min(cloud) AS least FROM weeks GROUP BY ALL)
  SELECT row, col, CAST(median(value) AS DOUBLE) AS value FROM weeks JOIN m USING (row, col) WHERE cloud <= least + 20 GROUP BY row, col""")  # fmt: skip
def q57(spark, d):
    return raster.median_composite(views.weeks(spark, d).withColumnRenamed("year", "shot"))


@query("q58_kept_labels", f"""WITH RECURSIVE {views.MASK}, e AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON {_NEAR8}), r(a, b) AS (SELECT id, id FROM mask UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  l AS (SELECT a AS id, min(b) AS object FROM r GROUP BY a), k AS (SELECT object FROM l GROUP BY object HAVING count(*) BETWEEN 3 AND 12)
  SELECT row, col, CAST(CASE WHEN value >= 7 THEN 255 WHEN object IN (SELECT object FROM k) THEN 1 ELSE 0 END AS INTEGER) AS value FROM mask JOIN l USING (id)""")  # fmt: skip
def q58(spark, d):
    cells = raster.labelled(_mask(spark, d), 8)
    kept = raster.object_table(cells).filter(F.col("n_cells").between(3, 12))
    return raster.kept_labels(cells, kept, cells.filter("value >= 7").select("row", "col"))


@query("q59_difference_bands", f"""WITH {views.BANDS}, w AS (SELECT vec_id, max(v) FILTER (WHERE band = 4) AS b4, max(v) FILTER (WHERE band = 5) AS b5, max(v) FILTER (WHERE band = 2) AS b2 FROM bands GROUP BY vec_id)
  SELECT vec_id, round(coalesce((b4 - b5) / nullif(b4 + b5, 0), 0), 6) AS nd45, round(coalesce((b2 - b5) / nullif(b2 + b5, 0), 0), 6) AS nd25, CAST(CASE WHEN abs(b4) > 0.25 THEN 255 ELSE round_even(abs(b4) * 254, 0) END AS INTEGER) AS quantized FROM w""")  # fmt: skip
def q59(spark, d):
    from ..sources.storage import parquet_table

    b = [F.get("embedding", i).cast("double") for i in range(6)]
    return parquet_table(spark, d, "embeddings").select(
        "vec_id", r6(scalars.normalized_difference(b[4], b[5]), "nd45"), r6(scalars.normalized_difference(b[2], b[5]), "nd25"), scalars.quantized(F.abs(b[4]), 254, F.abs(b[4]) > 0.25).alias("quantized")
    )


@query("q89_contacts_by_code", f"""{_FRAGMENTS}, t AS (SELECT DISTINCT tile_row, tile_col, fragment, CASE WHEN r = 49 THEN c + 1 WHEN r = 0 THEN -(c + 1) WHEN c = 9 THEN 11 + r WHEN c = 0 THEN -(11 + r) ELSE 0 END AS code FROM (SELECT row // 50 AS tile_row, col // 10 AS tile_col, row % 50 AS r, col % 10 AS c, fragment FROM mask JOIN f USING (id))),
  k AS (SELECT a.fragment AS a, b.fragment AS b, b.tile_row > a.tile_row AS down, a.code AS own FROM t a JOIN t b ON a.code <> 0 AND b.code = -a.code AND ((b.tile_row = a.tile_row + 1 AND b.tile_col = a.tile_col) OR (b.tile_row = a.tile_row AND b.tile_col = a.tile_col + 1)))
  SELECT 'any edge' AS variant, a, b FROM k GROUP BY ALL UNION ALL SELECT 'own edges', a, b FROM k WHERE (down AND own BETWEEN 1 AND 10) OR (NOT down AND own > 10) GROUP BY ALL""")  # fmt: skip
def q89(spark, d):
    fragments = _fragments(spark, d)
    return reshape.stacked(*(raster.contacts_by_code(fragments, *TILE, own).select(F.lit(n).alias("variant"), "a", "b") for n, own in (("any edge", False), ("own edges", True))))
