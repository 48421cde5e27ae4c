"""Grouped statistics, shares, metrics and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import t_quantile
from ..sources.storage import cut


def ranked_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, _v, _n, _to, _all): each group's distinct values, how often they stand, how many rows of the group stand up to
    them in order, and in all; nulls count 0 times.

    Equal values are counted first, before their shuffle too. Groups and values are then dealt to sorted ranges (written, so
    that all uses see the same ones), and what stands before a range is added to the running counts in it: no task holds a
    group's values or sorts a group, however much of the table it is.
    """
    counted = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count(column).alias("_n"))
    ranged, _ = cut(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *keys).agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    offsets = sums.select(F.col("_part").alias("_at"), *(F.col(k).alias(n) for k, n in named.items()), before.alias("_before"), F.sum("_s").over(group).alias("_all"))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(named[k])), keys, F.col("_part") == F.col("_at"))
    run = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v"))
    return ranged.withColumn("_run", run).join(offsets, same).select(*keys, "_v", "_n", (F.col("_run") + F.col("_before")).alias("_to"), "_all")


def quantile_of(p: float) -> Column:
    """The exact quantile of a group of ranked_counts(), linearly interpolated."""
    place = p * (F.col("_all") - 1)
    low, high = F.floor(place), F.ceil(place)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("_n") <= rank), F.col("_v").cast("double")))

    share = F.max(place - low)
    return F.when(share == 0, at(low)).otherwise((1 - share) * at(low) + share * at(high))


def quantiles(df: DataFrame, keys: Sequence[str], column: str, wanted: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of each group, as F.percentile gives them; null values don't count."""
    return ranked_counts(df, keys, column).groupBy(*keys).agg(*(quantile_of(p).alias(name) for name, p in wanted.items()))


def area_statistics(objects: DataFrame, keys: Sequence[str], area: str = "area_ha", mean: bool = False) -> DataFrame:
    """sum, count and exact median of areas a group (or of all); null keys are no group; sums of nothing are 0."""
    own = objects
    for k in keys:
        own = own.filter(F.col(k).isNotNull())
    total, n = F.sum(F.col("_v") * F.col("_n")), F.coalesce(F.sum("_n"), F.lit(0))
    parts = [F.coalesce(total, F.lit(0.0)).alias("area_sum"), n.alias("area_count"), quantile_of(0.5).alias("area_median")]
    return ranked_counts(own, keys, area).groupBy(*keys).agg(*parts, *([F.try_divide(total, n).alias("area_mean")] if mean else []))


def median_by_counts(df: DataFrame, keys: Sequence[str], column: str, alias: str = "median") -> DataFrame:
    """The exact median, as F.median gives it, for groups with more distinct values than one task's memory holds; groups
    without a value have no row."""
    return quantiles(df.filter(F.col(column).isNotNull()), keys, column, {alias: 0.5})


def statistics_of(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """mean, median, sum and count of several columns in one pass."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count")]
    return df.groupBy(*keys).agg(*out)


def spread_statistics(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    low, high, std, mean = F.min(column), F.max(column), F.stddev_samp(column), F.avg(column)
    return df.groupBy(*keys).agg(std.alias("std"), low.alias("low"), high.alias("high"), (high - low).alias("range"), F.try_divide(std, mean).alias("std_over_mean"))


def counts_with_share(df: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows a key, and their share of all or of the group named by `within`."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def conditional_shares(df: DataFrame, area: str, conditions: Mapping[str, Column]) -> DataFrame:
    """For each named condition, its share of rows and of area, as a row of columns."""
    out = []
    for name, c in conditions.items():
        out += [F.avg(c.cast("int")).alias(f"{name}_count_share"), F.try_divide(F.sum(F.when(c, F.col(area))), F.sum(area)).alias(f"{name}_area_share")]
    return df.agg(*out)


def best_row(df: DataFrame, keys: Sequence[str], by: str, tie: str, columns: Sequence[str], least: bool = False) -> DataFrame:
    """The row of the greatest (or least) value a group, the least `tie` of equal ones."""
    order = F.struct(F.col(by) if least else -F.col(by), F.col(tie))
    return df.groupBy(*keys).agg(F.min_by(F.struct(by, *columns), order).alias("row")).select(*keys, f"row.{by}", *(f"row.{c}" for c in columns))


def top_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, k: int, alias: str) -> DataFrame:
    """Sum of the first k rows of each group in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_k", place).filter(F.col("_k") <= k).groupBy(*keys).agg(F.sum(value).alias(alias))


def first_known(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each column's first value that is not null, in an order, a group."""
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def averaged_metrics(counts: DataFrame, names: Sequence[str] = ("precision", "recall", "f1", "iou")) -> DataFrame:
    """Metrics of summed counts tp, fp and fn (micro_...), and the mean of each row's own metrics (image_...)."""
    m = metrics()
    rows = counts.select("tp", "fp", "fn", *(m[n].alias(f"_{n}") for n in names))
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(f"_{n}").alias(f"image_{n}") for n in names))
    return sums.select(*(m[n].alias(f"micro_{n}") for n in names), *(f"image_{n}" for n in names))


def fold_small(df: DataFrame, upper: str, lower: str, least: int, other: str = "Other") -> DataFrame:
    """(upper, lower, n) with subtotals (null lower) and the total; groups of fewer than `least` rows are folded."""
    counted = df.groupBy(upper, lower).agg(F.count(F.lit(1)).alias("n"))
    folded = counted.withColumn(lower, F.when(F.col("n") < least, other).otherwise(F.col(lower)))
    return folded.rollup(upper, lower).agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, truth: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn")
    )


def metrics(scale: float = 1.0) -> dict[str, Column]:
    """precision, recall, f1 and iou of columns tp, fp and fn; null where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {"precision": scale * F.try_divide(tp, tp + fp), "recall": scale * F.try_divide(tp, tp + fn), "f1": scale * F.try_divide(2 * tp, 2 * tp + fp + fn), "iou": scale * F.try_divide(tp, tp + fp + fn)}


def threshold_sweep(df: DataFrame, score: str, truth: str, cutoffs: Sequence[float]) -> DataFrame:
    """tp, fp, fn at each cutoff (predicted: score > cutoff), in one pass: rows fall into bins between cutoffs, and
    cumulative sums over the bins give every cutoff's counts. The input is not repeated for each cutoff."""
    edges = sorted(cutoffs)
    bin_of = F.size(F.filter(F.array(*(F.lit(float(c)) for c in edges)), lambda c: F.col(score) > c))
    binned = df.groupBy(bin_of.alias("bin")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    spark = df.sparkSession
    all_bins = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    dense = all_bins.join(binned, "bin", "left").select("bin", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    above = Window.orderBy(F.desc("bin"))  # as many rows as cutoffs
    run = dense.select("bin", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(Window.partitionBy()).alias("all_pos"))
    cutoff = F.get(F.array(*(F.lit(float(c)) for c in edges)), F.col("bin") - 1)
    return run.filter("bin > 0").select(cutoff.alias("cutoff"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"))


def best_cutoff(sweep: DataFrame, by: str = "iou") -> DataFrame:
    """The median of the cutoffs that reach the greatest iou, or the least distance of precision and recall."""
    m = metrics()
    goal = m["iou"] if by == "iou" else -F.abs(m["precision"] - m["recall"])
    ranked = sweep.withColumn("goal", F.round(goal, 12))
    return ranked.crossJoin(F.broadcast(ranked.agg(F.max("goal").alias("most")))).filter("goal = most").agg(F.median("cutoff").alias("cutoff"), F.max("goal").alias("goal"))


def precision_recall(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Precision and recall at each distinct score. Counts by score come first; the cumulative sums run over 1,024 blocks
    of equal width between the least score and the greatest, and then inside them, so that no one task holds all scores."""
    by_score = df.groupBy(score).agg(F.count_if(F.col(truth)).alias("pos"), F.count(F.lit(1)).alias("n"))
    low, high = df.agg(F.min(score), F.max(score)).first()
    block = F.floor((F.col(score) - F.lit(low)) * F.lit(1024 / ((high - low) or 1))) if low is not None else F.lit(0)
    inside = Window.partitionBy("block").orderBy(F.desc(score))
    part = by_score.withColumn("block", block)
    sums = part.groupBy("block").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    before = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("block", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("on"), F.sum("bp").over(Window.partitionBy()).alias("all_pos"))
    run = part.select(score, "block", F.sum("pos").over(inside).alias("tp"), F.sum("n").over(inside).alias("called"))
    return run.join(offsets, "block").select(score, (F.col("tp") + F.col("op")).alias("tp"), ((F.col("tp") + F.col("op")) / (F.col("called") + F.col("on"))).alias("precision"), F.try_divide(F.col("tp") + F.col("op"), F.col("all_pos")).alias("recall"))


def t_expansion(z: float, dof: Column) -> Column:
    """Student's quantile for many degrees of freedom from the normal one (Abramowitz and Stegun 26.7.5)."""
    g = (
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    out = F.lit(0.0)
    for x in reversed(g):
        out = (out + x) / dof
    return out + z


def t_interval(df: DataFrame, keys: Sequence[str], column: str, level: float = 0.95, most: int = 200) -> DataFrame:
    """Mean with Student's interval; beyond `most` degrees of freedom the quantile is that of an expansion, right to 12 digits."""
    spark = df.sparkSession
    quantiles = spark.createDataFrame([(n, t_quantile(0.5 + level / 2, n)) for n in range(1, most + 1)], "dof int, t double")
    base = df.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    joined = base.withColumn("dof", (F.col("n") - 1).cast("int")).join(F.broadcast(quantiles), "dof", "left")
    t = F.when(F.col("dof") > most, t_expansion(NormalDist().inv_cdf(0.5 + level / 2), F.col("dof"))).otherwise(F.col("t"))
    half = t * F.col("std") / F.sqrt("n")
    return joined.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 0, n); bins are closed on the left, and the last one on both sides; values outside are left out."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overlap_split(df: DataFrame, keys: Sequence[str], overlaps: Column, size: str, prefix: str = "") -> DataFrame:
    """Total, mean and count of all objects, of those with and of those without overlap."""
    out = []
    for name, cond in (("", F.lit(True)), ("overlap_", overlaps), ("no_overlap_", ~overlaps)):
        kept = F.when(cond, F.col(size))
        out += [F.coalesce(F.sum(kept), F.lit(0.0)).alias(f"{prefix}{name}total_area"), F.avg(kept).alias(f"{prefix}{name}mean_size"), F.count(kept).alias(f"{prefix}{name}count")]
    return df.groupBy(*keys).agg(*out)


def weighted_totals(df: DataFrame, area: str, values: Sequence[str], keys: Sequence[str] = (), unit: float = 1e12) -> DataFrame:
    """sum(value * area) / unit of several values in one pass."""
    return df.groupBy(*keys).agg(*((F.sum(F.col(v) * F.col(area)) / unit).alias(v) for v in values))


def distinct_share(regions: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Share of regions with an object."""
    have = objects.select(key).distinct().withColumn("_has", F.lit(1))
    return regions.select(key).distinct().join(have, key, "left").agg((F.count("_has") / F.count(F.lit(1))).alias("share"))


def column_sums(df: DataFrame) -> DataFrame:
    numeric = [n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return df.agg(*(F.sum(n).alias(n) for n in numeric))


def fragmentation(regions: DataFrame, objects: DataFrame, key: str, flow: str, baseline: str) -> DataFrame:
    """100 * sum of the objects' flow over the region's own greatest flow; a zero baseline counts as 1."""
    sums = objects.groupBy(key).agg(F.sum(flow).alias("flow_sum"))
    base = F.when(F.col(baseline) == 0, 1.0).otherwise(F.col(baseline))
    return regions.join(sums, key, "left").select(key, (100 * F.coalesce("flow_sum", F.lit(0.0)) / base).alias("fragmentation"))


def outer_chain(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of many tables on a key, each with one value column of its own name: one union and one aggregate,
    a single shuffle instead of one for each table. Keys are unique in each table."""
    names = list(tables)
    parts = [df.select(F.col(key), *(F.col(n).cast("double").alias(n) if n == own else F.lit(None).cast("double").alias(n) for n in names)) for own, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(*(F.max(n).alias(n) for n in names))


def clean_predictors(df: DataFrame, zero: Sequence[str] = (), mean: Sequence[str] = (), least_zero: Sequence[str] = (), negate: Sequence[str] = ()) -> DataFrame:
    """Missing values become 0 or the column's mean, negative ones 0, and signs are turned, as asked for each column."""
    new = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero} | {c: F.greatest(F.col(c), F.lit(0.0)) for c in least_zero} | {c: -F.col(c) for c in negate}
    out = df.withColumns(new) if new else df
    if mean:
        means = df.agg(*(F.avg(c).alias(f"_mean_{c}") for c in mean))
        out = out.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in mean}).drop(*(f"_mean_{c}" for c in mean))
    return out


def ratios(df: DataFrame, columns: Sequence[str], by: str, suffix: str) -> DataFrame:
    """Each column over another, as new columns."""
    return df.withColumns({f"{c}{suffix}": F.try_divide(F.col(c), F.col(by)) for c in columns})


def swept(residual: np.ndarray, i: int) -> np.ndarray:
    """Correlations of what regression on variable i leaves; the same again if nothing of it is left."""
    if residual[i, i] < 1e-10:
        return residual
    return residual - np.outer(residual[:, i], residual[i]) / residual[i, i]


def subset_fits(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """(subset bitmask, r2) of the linear fits of a target on every non-empty subset of predictors, bit i for the i-th.

    One pass over the rows gives all covariances; from then on the rows don't count. Subsets are dealt to tasks in the order
    of their masks, whose high bits change least: a task keeps the swept matrices of the bits that stay, and sweeps only
    those that come anew, about two for each subset. Rows with a null take no part. Predictors that others explain, or
    that never vary, add nothing; a target that never varies has null fits.
    """
    names = [*predictors, target]
    k = len(predictors)
    whole = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names))).dropna()
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    row = whole.agg(*(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs), *(F.max(F.abs(f"c{i}")).alias(f"top{i}") for i in range(k + 1))).first()
    cov = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"v{i}_{j}"] or 0.0
    varies = np.array([cov[i, i] > (1e-12 * (row[f"top{i}"] or 0.0)) ** 2 for i in range(k + 1)])  # over the rounding of its mean
    scale = np.sqrt(np.where(varies, np.diag(cov), np.inf))
    first = cov / np.outer(scale, scale)
    known = bool(varies[k])

    def run(batches):
        for pdf in batches:
            held: list[tuple[int, np.ndarray]] = []
            out = []
            for mask in pdf["subset"].tolist():
                bits = [i for i in reversed(range(k)) if mask >> i & 1]
                same = 0
                while same < min(len(held), len(bits)) and held[same][0] == bits[same]:
                    same += 1
                del held[same:]
                for i in bits[same:]:
                    held.append((i, swept(held[-1][1] if held else first, i)))
                out.append(1 - held[-1][1][k, k] if known else None)
            yield pd.DataFrame({"subset": pdf["subset"], "r2": pd.array(out, dtype="Float64")})

    return df.sparkSession.range(1, 1 << k).select(F.col("id").alias("subset")).mapInPandas(run, "subset long, r2 double")


def hierarchical_partition(fits: DataFrame, terms: int) -> DataFrame:
    """(term, unique, average, total) from a table (subset bitmask, r2) of all non-empty subsets of terms.

    unique is the gain of a term over all others; total is its gain averaged over the sizes of the subsets that it joins;
    average is what of it the term shares with others.
    """
    empty = fits.sparkSession.range(1).select(F.lit(0).cast("int").alias("subset"), F.lit(0.0).alias("r2"))
    every = fits.select(F.col("subset").cast("int"), "r2").unionByName(empty)
    term = F.explode(F.sequence(F.lit(0), F.lit(terms - 1))).alias("term")
    bit = F.expr("shiftleft(1, term)")
    without = every.select("subset", "r2", term).withColumn("bit", bit).filter(F.col("subset").bitwiseAND(F.col("bit")) == 0)
    pairs = without.select("term", F.col("r2").alias("r0"), F.bit_count("subset").alias("size"), F.col("subset").bitwiseOR(F.col("bit")).alias("subset")).join(every, "subset")
    by_size = pairs.groupBy("term", "size").agg(F.avg(F.col("r2") - F.col("r0")).alias("gain"))
    total = by_size.groupBy("term").agg(F.avg("gain").alias("total"), F.max(F.when(F.col("size") == terms - 1, F.col("gain"))).alias("unique"))
    return total.select("term", "unique", (F.col("total") - F.col("unique")).alias("average"), "total")
