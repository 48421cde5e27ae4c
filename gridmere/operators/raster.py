"""Rasters in long form: one row a cell, with integer columns row and col and a value; absent cells are nodata.

Neighbourhoods are made by sending each cell to the cells around it, so that halos need no special reads. Windows and
shuffles are keyed by cell or tile, never by raster.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import NODATA, class_of_code, transition_code
from ..sources.storage import cut
from .components import components, roots
from .statistics import quantiles

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
#: Half of the neighbours: each pair of cells meets once.
HALF = {8: ((0, 1), (1, -1), (1, 0), (1, 1)), 4: ((0, 1), (1, 0))}


def tiled(cells: DataFrame, height: int, width: int) -> DataFrame:
    return cells.withColumns({"tile_row": F.floor(F.col("row") / height).cast("int"), "tile_col": F.floor(F.col("col") / width).cast("int")})


def mask(cells: DataFrame, cutoff: float, closed: bool = False, nodata: int | None = NODATA) -> DataFrame:
    """Cells above the cutoff (or at it, if closed) that are no nodata."""
    value = F.col("value")
    kept = value >= cutoff if closed else value > cutoff
    return cells.filter(kept if nodata is None else kept & (value != nodata))


def mask_above_percentile(cells: DataFrame, p: float) -> DataFrame:
    """Cells above the exact percentile of all cells, linearly interpolated."""
    cut_at = quantiles(cells, [], "value", {"cut_at": p})
    return cells.crossJoin(F.broadcast(cut_at)).filter("value > cut_at").drop("cut_at")


def neighbours(cells: DataFrame, offsets: Sequence[tuple[int, int]], *columns: str) -> DataFrame:
    """Each cell, sent to the places at the offsets: row and col are those of the place that receives it."""
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets))).alias("s")
    return cells.select("row", "col", *columns, steps).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), *columns)


def dilated(cells: DataFrame, offsets: Sequence[tuple[int, int]] = CROSS) -> DataFrame:
    return neighbours(cells, offsets).distinct()


def eroded(cells: DataFrame, offsets: Sequence[tuple[int, int]] = CROSS) -> DataFrame:
    """Cells all of whose neighbours are set; what lies outside the raster is not."""
    hits = neighbours(cells.select("row", "col").distinct(), [(-r, -c) for r, c in offsets])
    return hits.groupBy("row", "col").count().filter(F.col("count") == len(offsets)).select("row", "col")


def stacked_bands(bands: Mapping[str, DataFrame]) -> DataFrame:
    """(row, col, one column a band) of cells that all bands have: one union and one aggregate, not a join a band."""
    names = list(bands)
    parts = [df.select("row", "col", F.lit(i).alias("band"), F.col("value").cast("double").alias("value")) for i, df in enumerate(bands.values())]
    stack = reduce(DataFrame.unionByName, parts).groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == i, F.col("value"))).alias(n) for i, n in enumerate(names)), F.count_distinct("band").alias("_n"))
    return stack.filter(F.col("_n") == len(names)).drop("_n")


def picked_bands(stack: DataFrame, *groups: Sequence[str], name: str = "bands") -> DataFrame:
    """(row, col, bands): the bands of all groups, one after the other, as one array."""
    return stack.select("row", "col", F.array(*(F.col(b) for g in groups for b in g)).alias(name))


def window_of(cells: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float, x0: float, y0: float, step: float, size: tuple[int, int] | None = None) -> DataFrame:
    """Cells of the window with these bounds on a grid of square cells (x0, y0: its upper left corner, rows go down); with
    a size, of that many rows and columns about the window's centre. Plain comparisons, that reach the scan."""
    top, left = round((y0 - y_max) / step), round((x_min - x0) / step)
    rows, cols = round((y_max - y_min) / step), round((x_max - x_min) / step)
    if size is not None:
        top, left, (rows, cols) = top - (size[0] - rows) // 2, left - (size[1] - cols) // 2, size
    return cells.filter(F.col("row").between(top, top + rows - 1) & F.col("col").between(left, left + cols - 1))


def max_filter(cells: DataFrame, size: int = 10) -> DataFrame:
    """Greatest value in a size x size window, whose larger half is before the cell: two passes of one line each, since
    the maximum of a box is that of its rows' maxima."""
    before, after = size // 2, size - size // 2 - 1
    reach = range(-after, before + 1)  # a cell at x counts for the windows of x - after to x + before
    wide = neighbours(cells, [(0, d) for d in reach], "value").groupBy("row", "col").agg(F.max("value").alias("value"))
    tall = neighbours(wide, [(d, 0) for d in reach], "value").groupBy("row", "col").agg(F.max("value").alias("value"))
    return tall.join(cells.select("row", "col"), ["row", "col"], "left_semi")


def border_code(height: int, width: int) -> Column:
    """Code of a cell on a tile's edge, by its place in the tile (columns r and c, from 0): bottom edge 1 + c, top edge
    -(1 + c), right edge width + 1 + r, left edge -(width + 1 + r); a corner has the code of its row. 0 inside."""
    r, c = F.col("r"), F.col("c")
    return F.when(r == height - 1, c + 1).when(r == 0, -(c + 1)).when(c == width - 1, width + 1 + r).when(c == 0, -(width + 1 + r)).otherwise(0).cast("int")


def label_tiles(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """The fragment of each cell of each tile: its least cell id (column id) among those that it touches inside the tile.

    A tile is one group of bounded size; labelling it needs no other.
    """
    offsets = HALF[connectivity]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, ident = (pdf[c].to_numpy() for c in ("row", "col", "id"))
        width = int(col.max() - col.min()) + 3
        key = (row - row.min()) * width + (col - col.min() + 1)
        order = np.argsort(key)
        a, b = [ident], [ident]
        for r, c in offsets:
            want = key + r * width + c
            at = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
            hit = key[order][at] == want
            a.append(ident[hit])
            b.append(ident[order][at][hit])
        node, root = roots(np.concatenate(a), np.concatenate(b))
        return pdf.assign(fragment=root[np.searchsorted(node, ident)])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return cells.groupBy("tile_row", "tile_col").applyInPandas(label, ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", fragment long")


def contacts(fragments: DataFrame, connectivity: int = 8, diagonal: bool = True, tile: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): fragments of different tiles that touch. Without `diagonal`, only cells of equal offset along an edge do.

    Only cells at a tile's edge have such neighbours: given the tiles' height and width, only they are sent and joined.
    """
    offsets = HALF[connectivity] if diagonal else HALF[4]
    edge = fragments.select("row", "col", "fragment", "tile_row", "tile_col")
    if tile is not None:
        edge = edge.filter((F.col("row") % tile[0]).isin(0, tile[0] - 1) | (F.col("col") % tile[1]).isin(0, tile[1] - 1))
    sent = neighbours(edge, offsets, "fragment", "tile_row", "tile_col").toDF("row", "col", "a", "tr", "tc")
    met = sent.join(edge.withColumnRenamed("fragment", "b"), ["row", "col"])
    return met.filter((F.col("tr") != F.col("tile_row")) | (F.col("tc") != F.col("tile_col"))).select("a", "b").distinct()


def contacts_by_code(fragments: DataFrame, height: int, width: int, own_edges: bool = True) -> DataFrame:
    """(a, b): fragments of a tile and of its right or lower neighbour with opposite border codes.

    A corner cell has one code only, so that some contacts at corners are missed. Without `own_edges`, codes of any edge
    count: a fragment on the right edge then also matches one on the left edge of the tile below, at the same row. That
    is how tables made with such codes were merged, and is here to reproduce them.
    """
    coded = fragments.withColumns({"r": F.col("row") - F.col("tile_row") * height, "c": F.col("col") - F.col("tile_col") * width})
    coded = coded.withColumn("code", border_code(height, width)).filter("code <> 0").select("tile_row", "tile_col", "fragment", "code").distinct()
    steps = F.explode(F.array(F.struct(F.lit(1).alias("down"), F.lit(0).alias("right")), F.struct(F.lit(0).alias("down"), F.lit(1).alias("right")))).alias("s")
    sent = coded.select("tile_row", "tile_col", F.col("fragment").alias("a"), F.col("code").alias("own"), steps)
    sent = sent.select((F.col("tile_row") + F.col("s.down")).alias("tile_row"), (F.col("tile_col") + F.col("s.right")).alias("tile_col"), (-F.col("own")).alias("code"), "a", "own", F.col("s.down").alias("down"))
    met = sent.join(coded.withColumnRenamed("fragment", "b"), ["tile_row", "tile_col", "code"])
    if own_edges:  # the bottom edge meets the tile below, the right edge the tile to the right
        met = met.filter(((F.col("down") == 1) & F.col("own").between(1, width)) | ((F.col("down") == 0) & (F.col("own") > width)))
    return met.select("a", "b").distinct()


def merged(fragments: DataFrame, links: DataFrame) -> DataFrame:
    """Fragments with the object that they belong to: the least fragment that links reach."""
    found = components(links).select(F.col("node").alias("fragment"), F.col("root"))
    return fragments.join(found, "fragment", "left").withColumn("object", F.coalesce("root", "fragment")).drop("root")


def labelled(cells: DataFrame, connectivity: int = 8, tile: tuple[int, int] = (256, 256)) -> DataFrame:
    """Cells (row, col, id) with the object of each: components of the whole raster, tile by tile and then across. The
    fragments are written, so that each tile is labelled once."""
    fragments, _ = cut(label_tiles(tiled(cells, *tile), connectivity))
    return merged(fragments, contacts(fragments, connectivity, tile=tile))


def object_table(cells: DataFrame, key: str = "object", value: str = "value") -> DataFrame:
    """One row an object: cells, box, centre and greatest value of another layer."""
    return cells.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("row").alias("row_start"), F.min("col").alias("col_start"), (F.max("row") - F.min("row") + 1).alias("box_rows"),
        (F.max("col") - F.min("col") + 1).alias("box_cols"), F.avg("row").alias("center_row"), F.avg("col").alias("center_col"), F.max(value).alias("value_max"),
    )


def kept_labels(cells: DataFrame, objects: DataFrame, nodata: DataFrame | None = None) -> DataFrame:
    """1 for cells whose object is listed, 0 for other mask cells, 255 where the nodata layer has a cell."""
    listed = cells.join(objects.select("object").distinct().withColumn("listed", F.lit(1)), "object", "left").select("row", "col", F.coalesce("listed", F.lit(0)).alias("value"))
    return listed if nodata is None else listed.join(nodata, ["row", "col"], "left_anti").unionByName(nodata.select("row", "col", F.lit(NODATA).alias("value")))


def resampled_up(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell as factor x factor cells."""
    r, c = (F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias(n) for n in ("dr", "dc"))
    return cells.select("*", r).select("*", c).select((F.col("row") * factor + F.col("dr")).alias("row"), (F.col("col") * factor + F.col("dc")).alias("col"), "value")


def resampled_down(cells: DataFrame, factor: int) -> DataFrame:
    return cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("value").alias("value"))


def cloud_masked(cells: DataFrame, cloud: Column, cutoff: float = 50) -> DataFrame:
    """Values under clouds become nodata; nodata counts as cloudy."""
    return cells.withColumn("value", F.when((cloud > cutoff) | (F.col("value") == NODATA), NODATA).otherwise(F.col("value")))


def cloud_filled(years: DataFrame, reach: int = 2, cutoff: float = 75) -> DataFrame:
    """For each cell and year, the value of the first clear year in the order y, y-1, y+1, y-2, y+2; nodata if none is.

    years has row, col, year, value and cloud. Each row is sent to the years that it may fill: no self join.
    """
    offers = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d")
    rank = F.when(F.col("d") == 0, 0).when(F.col("d") > 0, 2 * F.col("d") - 1).otherwise(-2 * F.col("d"))
    clear = F.when(F.col("cloud") <= cutoff, rank)
    sent = years.select("row", "col", "year", "value", "cloud", offers)
    placed = sent.select("row", "col", (F.col("year") + F.col("d")).alias("year"), "value", clear.alias("rank"), (F.col("d") == 0).alias("own"))
    filled = placed.groupBy("row", "col", "year").agg(F.min_by("value", "rank").alias("value"), F.min("rank").alias("priority"), F.bool_or("own").alias("own"))
    return filled.filter("own").select("row", "col", "year", F.coalesce("value", F.lit(NODATA)).alias("value"), "priority")


def transitions(history: DataFrame, key: Sequence[str] = ("row", "col"), time: str = "year", name: Column | None = None) -> DataFrame:
    """The code of each cell's change of class from one year to its next; the last year of a cell has none."""
    own = class_of_code(F.col("value")) if name is None else name
    then = Window.partitionBy(*key).orderBy(time)
    return history.withColumn("name", own).withColumn("after", F.lead("name").over(then)).withColumn("next_time", F.lead(time).over(then)).filter("next_time IS NOT NULL").withColumn("code", transition_code(F.col("name"), F.col("after")))


def last_different(history: DataFrame, final: int | str, key: Sequence[str] = ("row", "col"), time: str = "year", value: str = "value") -> DataFrame:
    """For each cell, its value at the final time, and the latest earlier time and value that differ from it."""
    at_end = Window.partitionBy(*key)
    last = F.max(F.when(F.col(time) == final, F.col(value))).over(at_end)
    known = history.withColumn("final_value", last).filter("final_value IS NOT NULL")
    change = F.when((F.col(time) < final) & (F.col(value) != F.col("final_value")), F.struct(time, value))
    return known.groupBy(*key, "final_value").agg(F.max(change).alias("change")).select(*key, "final_value", F.col(f"change.{time}").alias("changed_at"), F.col(f"change.{value}").alias("value_before"))


def constant_runs(history: DataFrame, key: Sequence[str] = ("row", "col"), time: str = "year", value: str = "value") -> DataFrame:
    """Numbers runs of equal values of each cell in time: two rows are of one run iff nothing changed between them."""
    order = Window.partitionBy(*key).orderBy(time)
    new = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(0))
    return history.withColumn("new", new).withColumn("run", F.sum("new").over(order)).drop("new")


def mosaic_mean(parts: DataFrame) -> DataFrame:
    """Mean of overlapping parts by cell, without nodata, cut to whole numbers; nodata where all parts have it."""
    known = F.when(F.col("value") != NODATA, F.col("value"))
    return parts.groupBy("row", "col").agg(F.floor(F.avg(known)).cast("int").alias("mean")).select("row", "col", F.coalesce("mean", F.lit(NODATA)).alias("value"))


def mosaic_max(*rasters: DataFrame) -> DataFrame:
    """Cell-wise maximum: a union and one aggregate, not a chain of joins."""
    both = rasters[0].select("row", "col", "value")
    for r in rasters[1:]:
        both = both.unionByName(r.select("row", "col", "value"))
    return both.groupBy("row", "col").agg(F.max("value").alias("value"))


def median_composite(shots: DataFrame, slack: float = 20, depth: int = 100) -> DataFrame:
    """Median of each cell over the shots whose cloudiness is within `slack` of the cell's least cloudy one, the
    clearest `depth` at most."""
    by_cell = Window.partitionBy("row", "col")
    ranked = shots.withColumns({"least": F.min("cloud").over(by_cell), "place": F.row_number().over(by_cell.orderBy("cloud", "shot"))})
    return ranked.filter((F.col("cloud") <= F.col("least") + slack) & (F.col("place") <= depth)).groupBy("row", "col").agg(F.percentile("value", F.lit(0.5)).alias("value"))


def cropped(cells: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    return cells.filter(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def cleaned_masks(cells: DataFrame, image: str = "image") -> DataFrame:
    """Values above 0 become 1; an image with a single set cell becomes empty. Values are checked to be numbers >= 0."""
    binary = F.when(F.col("value") > 0, 1).otherwise(0)
    checked = F.when(F.col("value") < 0, F.raise_error(F.lit("negative mask value")).cast("int")).otherwise(binary)
    set_ = F.sum(checked).over(Window.partitionBy(image))
    return cells.withColumn("value", F.when(set_ == 1, 0).otherwise(checked))


def predicted(tiles: DataFrame, model, schema: str) -> DataFrame:
    """A caller's model over tiles: it takes and gives a pandas frame of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return tiles.mapInPandas(run, schema)
