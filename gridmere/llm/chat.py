"""Chat formatting: roles of transcript blocks by a hidden Markov model, then canonical turns.

A transcript is rows of text in order. Each row is cut into blocks where a line begins with a speaker marker; a block's
features are its marker, length, number of lines, last character and first word class. States are roles. Emissions and
transitions are counted on labelled rows and smoothed; Viterbi finds the likeliest roles, and runs of one role become one
turn under one header. Blocks are numbered within their conversation by sorted ranges, and the chain is cut into segments
of SEGMENT blocks by these numbers, so that no segment is longer, whatever the rows' places are: each becomes a matrix of best scores from the
role before it to its last role, matrices are multiplied in a tree, and the segments' border roles come back down it, so
that the result is that of one Viterbi pass, however long a conversation is.

Null and empty texts are one empty block. Null roles teach nothing; without any labels the roles are the `roles` given
and equally likely. Rows of equal place are ordered by their blocks' numbers and texts; equal rows are kept, in any order.
Null conversation ids are one conversation; null places come first. An empty table gives an empty table; other columns are
ignored. Ties go to the role that comes first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written

SEGMENT = 64
#: Names in speaker markers, by role. Fixed values.
MARKERS = {"assistant": ("assistant", "ai", "bot", "answer", "a", "model"), "system": ("system", "instruction", "context"), "user": ("user", "human", "question", "q", "customer", "prompt")}
#: A line that begins with a speaker's name and a colon, with or without the signs that chat logs put around names.
MARKER = r"(?i)\A[ \t]*[#>*\[<|]{0,3}[ \t]*(" + "|".join(sorted((n for names in MARKERS.values() for n in names), key=lambda n: (-len(n), n))) + r")[ \t]*[\]|>*]{0,3}[ \t]*:[ \t]*"
#: Where such a line begins.
BEGIN = MARKER.replace(r"(?i)\A", r"(?i)(?:(?<=\n)|\A)(?=") + ")"
#: Values of each feature: marker, length, lines, last character, whether first in its row.
FEATURES = {"marker": 4, "length": 16, "lines": 8, "last": 5, "opening": 2}


def blocks(rows: DataFrame, conv_col: str = "conv_id", place_col: str = "turn", text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """(conv_id, place, turn, block, seg, text, role and features) of all rows, written once; place counts the blocks of a
    conversation from 0. Role is null where none is given."""
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), BEGIN)
    parts = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(place_col).cast("long").alias("turn"), (F.col(role_col) if role_col else F.lit(None).cast("string")).alias("role"),
        F.posexplode(F.when(F.size(F.filter(cut, lambda p: p != "")) > 0, F.filter(cut, lambda p: p != "")).otherwise(F.array(F.lit("")))).alias("block", "raw"),
    )
    name = F.lower(F.regexp_extract("raw", MARKER, 1))
    marker = F.lit(0)
    for i, names in enumerate(MARKERS.values(), 1):
        marker = F.when(name.isin(*names), i).otherwise(marker)
    text = F.regexp_replace("raw", MARKER, "")
    out = parts.withColumns({"marker": marker, "text": F.btrim(text, F.lit(" \t\r\n"))})
    last = F.when(F.col("text") == "", 0).when(F.endswith("text", F.lit("?")), 1).when(F.rlike("text", F.lit(r"[.!]$")), 2).when(F.endswith("text", F.lit(":")), 3).otherwise(4)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    log2 = F.ceil(F.log2(F.length("text") + F.lit(1.0))).cast("int")
    featured = out.select(
        "conv_id", "turn", "block", "text", "role", "marker", F.least(log2, F.lit(15)).alias("length"),
        F.least(F.ceil(F.log2(lines + F.lit(1.0))).cast("int"), F.lit(7)).alias("lines"), last.alias("last"), (F.col("block") == 0).cast("int").alias("opening"),
    )
    return written(placed(featured).withColumn("seg", F.floor(F.col("place") / SEGMENT)), "blocks")[0]


def placed(found: DataFrame) -> DataFrame:
    """With the place of each block in its conversation, from 0. Sorted ranges, which may cut a conversation and even equal
    rows, count their own blocks; a range's first conversation goes on where the ranges before it have ended. Only
    conversations that ranges cut have such an offset: two a range at most, which are broadcast."""
    order = ["turn", "block", "text", "marker", "role"]
    tied = found.withColumn("_tie", F.monotonically_increasing_id())
    ranged, _ = written(tied.repartitionByRange("conv_id", *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    edge = ranged.groupBy("_part").agg(F.min(F.struct("conv_id")).alias("low"), F.max(F.struct("conv_id")).alias("high"))
    edges = edge.select("_part", F.explode(F.array_distinct(F.array("low", "high"))).alias("e")).select(F.col("_part").alias("_p"), F.col("e.conv_id").alias("_c"))
    at_edges = counts.join(F.broadcast(edges), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p"))).select("_c", "_p", "_n")
    before = F.sum("_n").over(Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = at_edges.select("_c", "_p", before.alias("_offset")).filter("_offset is not null")
    number = F.row_number().over(Window.partitionBy("_part", "conv_id").orderBy(*order, "_tie"))
    joined = ranged.withColumn("_number", number).join(F.broadcast(offsets), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumn("place", F.coalesce("_offset", F.lit(0)) + F.col("_number") - 1).drop("_part", "_tie", "_number", "_c", "_p", "_offset")


@dataclass(frozen=True)
class Model:
    """Log probabilities; the last row of `step` is that of a conversation's begin."""

    roles: tuple[str, ...]
    step: np.ndarray
    emit: dict[str, np.ndarray]

    def emissions(self, rows: pd.DataFrame) -> np.ndarray:
        return sum(self.emit[f][rows[f].to_numpy()] for f in FEATURES)


def fit(labelled: DataFrame, roles: tuple[str, ...] = ("assistant", "system", "user"), smooth: float = 0.5) -> Model:
    """Counts of features and of neighbouring roles over all labelled blocks: of each pair of blocks next to each other in a
    conversation that are both labelled, and of conversations' first blocks. Neighbours meet by their places."""
    known = labelled.filter("role is not null")
    last = known.select(F.col("conv_id").alias("c"), (F.col("place") + 1).alias("next"), F.col("role").alias("before"))
    own = known.select("conv_id", "place", "role")
    steps = own.join(last, own["conv_id"].eqNullSafe(last["c"]) & (own["place"] == last["next"]), "left")
    steps = steps.select(F.when(F.col("place") == 0, F.lit("")).otherwise(F.col("before")).alias("before"), "role").groupBy("before", "role").count().collect()
    names = tuple(sorted({r["role"] for r in steps} | (set() if steps else set(roles))))
    place = {r: i for i, r in enumerate(names)}
    step = np.full((len(names) + 1, len(names)), smooth)
    for r in steps:
        if r["before"] is not None:
            step[place.get(r["before"], len(names)), place[r["role"]]] += r["count"]
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))).alias("f")
    emit = {f: np.full((n, len(names)), smooth) for f, n in FEATURES.items()}
    for r in known.select("role", values).groupBy("role", "f.feature", "f.value").count().collect():
        emit[r["feature"]][r["value"], place[r["role"]]] += r["count"]
    for i, role in enumerate(MARKERS, 1):  # a marker names its role
        if role in place:
            emit["marker"][i, place[role]] += 100 * smooth
    return Model(names, np.log(step / step.sum(1, keepdims=True)), {f: np.log(e / e.sum(0)) for f, e in emit.items()})


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted batches, cut anew so that each run of equal keys is whole; and where the runs begin and end."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch.reset_index(drop=True) if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(rows), bool)
        for k in keys:
            before = rows[k].shift()
            new |= (rows[k].ne(before) & ~(rows[k].isna() & before.isna())).to_numpy()
        new[0] = True
        starts = np.flatnonzero(new).tolist()
        held = rows.iloc[starts[-1] :]
        if len(starts) > 1:
            yield rows.iloc[: starts[-1]], list(zip(starts, starts[1:]))
    if held is not None:
        yield held, [(0, len(held))]


def chain(step: np.ndarray, emissions: np.ndarray) -> np.ndarray:
    """Best scores of a segment, from the role before (or the begin) to its last role."""
    best = step + emissions[0]
    for e in emissions[1:]:
        best = (best[:, :, None] + step[None, :-1]).max(1) + e
    return best


def best_path(parts: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """Last role of each part of a chain of matrices, when the role before is `entry` and the last one is `leave`."""
    score, back = parts[0][entry], []
    for m in parts[1:]:
        total = score[:, None] + m[:-1]
        back.append(total.argmax(0))
        score = total.max(0)
    state = int(score.argmax()) if leave is None else leave
    out = [state]
    for b in reversed(back):
        state = int(b[state])
        out.append(state)
    return out[::-1]


def _arranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _bounds(found: DataFrame, model: Model, span: int) -> DataFrame:
    """(conv_id, seg, entry, leave): the role before each segment, and its last one, of the conversations given."""
    states = len(model.roles)
    kind = found.schema["conv_id"].dataType.simpleString()
    shape, result = f"conv_id {kind}, seg long, m array<double>", f"conv_id {kind}, seg long, entry int, leave int"

    def matrices(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_list()).reshape(-1, states + 1, states)

    def first(batches):
        for rows, parts in runs(batches, ["conv_id", "seg"]):
            scores, at = model.emissions(rows), [a for a, _ in parts]
            yield pd.DataFrame({"conv_id": rows["conv_id"].iloc[at], "seg": rows["seg"].iloc[at], "m": [chain(model.step, scores[a:b]).ravel().tolist() for a, b in parts]})

    def up(batches):
        for rows, parts in runs(batches, ["conv_id", "seg"]):
            own, at, out = matrices(rows["m"]), [a for a, _ in parts], []
            for a, b in parts:
                m = own[a]
                for x in own[a + 1 : b]:
                    m = (m[:, :, None] + x[None, :-1]).max(1)
                out.append(m.ravel().tolist())
            yield pd.DataFrame({"conv_id": rows["conv_id"].iloc[at], "seg": rows["seg"].iloc[at], "m": out})

    def down(batches):
        for rows, parts in runs(batches, ["conv_id", "parent"]):
            own, entry, leave = matrices(rows["m"]), rows["entry"].to_numpy().copy(), rows["leave"].to_numpy().copy()
            for a, b in parts:
                path = best_path(list(own[a:b]), int(entry[a]), None if leave[a] < 0 else int(leave[a]))
                entry[a + 1 : b], leave[a:b] = path[:-1], path
            yield pd.DataFrame({"conv_id": rows["conv_id"], "seg": rows["seg"], "entry": entry, "leave": leave})

    levels = [_arranged(found.drop("text", "role"), ["conv_id", "seg"], ["place"]).mapInPandas(first, shape)]
    while span:
        span //= SEGMENT
        above = levels[-1].select("conv_id", F.floor(F.col("seg") / SEGMENT).alias("parent"), F.col("seg").alias("place"), "m").withColumnRenamed("parent", "seg")
        levels.append(_arranged(above, ["conv_id", "seg"], ["place"]).mapInPandas(up, shape))
    top = levels[-1].select("conv_id", F.lit(0).cast("long").alias("parent"), "seg", "m", F.lit(states).alias("entry"), F.lit(-1).alias("leave"))
    bounds = _arranged(top, ["conv_id", "parent"], ["seg"]).mapInPandas(down, result)
    for level in reversed(levels[:-1]):
        parent = bounds.select(F.col("conv_id").alias("c"), F.col("seg").alias("p"), "entry", "leave")
        own = level.withColumn("parent", F.floor(F.col("seg") / SEGMENT))
        joined = own.join(parent, own["conv_id"].eqNullSafe(parent["c"]) & (own["parent"] == parent["p"])).drop("c", "p")
        bounds = _arranged(joined, ["conv_id", "parent"], ["seg"]).mapInPandas(down, result)
    return bounds


def roles(found: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, block, role_pred, opens, text): opens is true where a turn begins."""
    states = len(model.roles)
    kind = found.schema["conv_id"].dataType.simpleString()
    small_batches(found.sparkSession)
    other = found.filter("seg <> 0")
    span = other.agg(F.max(F.abs("seg"))).first()[0]
    if span is None:  # one segment a conversation
        ready = found.withColumns({"entry": F.lit(states), "leave": F.lit(-1)})
    else:
        many = other.select(F.col("conv_id").alias("c")).distinct()
        cut = found.join(many, found["conv_id"].eqNullSafe(many["c"]), "left_semi")
        bounds, _ = written(_bounds(cut, model, span), "bounds")
        b = bounds.toDF("c", "s", "entry", "leave")
        joined = found.join(b, found["conv_id"].eqNullSafe(b["c"]) & (found["seg"] == b["s"]), "left").drop("c", "s")
        ready = joined.withColumns({"entry": F.coalesce("entry", F.lit(states)), "leave": F.coalesce("leave", F.lit(-1))})

    def decode(batches):
        for rows, parts in runs(batches, ["conv_id", "seg"]):
            scores, entry, leave = model.emissions(rows), rows["entry"].to_numpy(), rows["leave"].to_numpy()
            path = np.zeros(len(rows), np.int64)
            before = np.zeros(len(rows), np.int64)
            for a, b in parts:
                path[a:b] = best_path([model.step + e for e in scores[a:b]], int(entry[a]), None if leave[a] < 0 else int(leave[a]))
                before[a], before[a + 1 : b] = entry[a], path[a : b - 1]
            yield pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "block": rows["block"], "role_pred": np.array(model.roles, object)[path], "opens": path != before, "text": rows["text"]})

    return _arranged(ready, ["conv_id", "seg"], ["place"]).mapInPandas(decode, f"conv_id {kind}, turn long, block int, role_pred string, opens boolean, text string")


def rendered(parsed: DataFrame) -> DataFrame:
    """Each block's part of the canonical transcript: the parts in order, joined, are the conversation."""
    header = F.when(F.col("opens"), F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"))).otherwise(F.lit(""))
    return parsed.withColumn("rendered", F.concat(header, "text", F.lit("\n")))
