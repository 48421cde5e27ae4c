"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints at Hamming distance 2 or less agree on at least two of four 16-bit blocks. The six choices of two blocks
are the upper nodes of the index: a masked bit pattern that all fingerprints below share. A node with many fingerprints
is split again by the blocks of its other 32 bits, so that no node holds more than 2**16 distinct ones, however large a
group of copies is. Inside a node the fingerprints are sorted by Gray rank, and runs of them are factored into inner
nodes that keep the bits on which all below agree and that no parent has; a search adds up the differences on the way
down and prunes whole groups. A node gives out the links of a spanning forest only, never all pairs of a group.

Nulls and texts without words have fingerprint zero and are linked like any other. Each row keeps its own result row;
rows with a null id take part, and a component of them alone has a null component id. Repeated rows have equal results.
An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_texts, written

#: Fingerprints in a node of the index above which it is split by more bits, and children of an inner node.
NODE, FAN = 4096, 8
#: Fingerprints that one search takes as queries at a time.
QUERIES = 1024
#: Removed ids up to which they are broadcast; beyond it, documents are shuffled to them.
BROADCAST_IDS = 1_000_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    starts, at = [], 0
    for token in tokens:
        starts.append(at)
        at += len(token) + 1
    ends = [s - 1 for s in starts[words:]] + [at - 1]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], ">u8")
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, *others: str) -> DataFrame:
    """(id, others.., fp): the fingerprint's 64 bits as a signed long."""

    def make():
        return lambda *columns: (*columns[:-1], [signed(fingerprint(t or b"", words)) for t in columns[-1]])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *others))
    return map_texts(docs.select(F.col(id_col), *others, F.col(text_col).cast("binary")), f"{schema}fp long", make)


def gray_order(prints: np.ndarray) -> np.ndarray:
    """Indices that sort unsigned fingerprints by their rank in the Gray code."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return np.argsort(rank, kind="stable")


class GrayIndex:
    """levels[0] holds the fingerprints in Gray order; each higher level holds runs of FAN nodes below it."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints[gray_order(prints)]
        agreed, ones, common = [], self.prints, np.full(len(prints), np.uint64(0xFFFFFFFFFFFFFFFF))
        levels = [(common, ones)]
        while len(levels[-1][0]) > 1:
            common, ones = levels[-1]
            starts = np.arange(0, len(ones), FAN)
            all_and, all_or = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(ones, starts)
            shared = np.bitwise_and.reduceat(common, starts) & ~(all_and ^ all_or)
            levels.append((shared, all_and & shared))
        for k, (common, ones) in enumerate(levels):  # keep what no parent has
            if k + 1 < len(levels):
                above = np.repeat(levels[k + 1][0], FAN)[: len(common)]
                agreed.append((common & ~above, ones & ~above))
            else:
                agreed.append((common, ones))
        self.levels = agreed

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions a < b within the distance, a block of queries at a time."""
        for query, node in self.search(np.arange(len(self.prints)), distance, later=True):
            after = node > query
            yield query[after], node[after]

    def search(self, queries: np.ndarray, distance: int, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, position) of all within the distance, or of those not before the query, a block of queries at a time."""
        for start in range(0, len(queries), QUERIES):
            query = queries[start : start + QUERIES]
            node, far = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
            for k in range(len(self.levels) - 1, -1, -1):
                mask, ones = self.levels[k]
                far = far + np.bitwise_count((self.prints[query] ^ ones[node]) & mask[node])
                near = far <= distance
                query, node, far = query[near], node[near], far[near]
                if k:
                    below = len(self.levels[k - 1][0])
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    query, far = np.repeat(query, FAN), np.repeat(far, FAN)
                    span = FAN ** (k - 1)
                    keep = node < below
                    if later:
                        keep &= (node + 1) * span > query  # nodes that hold nothing after the query go
                    query, node, far = query[keep], node[keep], far[keep]
            yield query, node

    def neighboured(self, distance: int) -> np.ndarray:
        """Whether each position has another within the distance: the next in Gray order answers for most of a group."""
        close = np.bitwise_count(self.prints[1:] ^ self.prints[:-1]) <= distance
        found = np.append(close, False) | np.append(False, close)
        for query, node in self.search(np.flatnonzero(~found), distance):
            found[query[node != query]] = True
        return found


def forest(prints: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its group) for those that are linked to a smaller one inside this node."""
    index = GrayIndex(np.array(prints, np.int64).view(np.uint64))
    value = index.prints.view(np.int64)
    label = value.copy()
    for a, b in index.links(distance):
        _join(label, value, a, b)
    found = label != value
    return value[found], label[found]


def _join(label: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all positions that the links connect, with what they were connected to, the least label."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        names, at = np.unique(label, return_inverse=True)
        least = names.copy()
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(least, np.searchsorted(names, high), low)
        for _ in range(64):
            after = least[np.searchsorted(names, least)]
            if (after == least).all():
                break
            least = after
        label[:] = least[at]


def _block(at: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), at * width).bitwiseAND((1 << width) - 1)


def _choices(blocks: list[int], width: int) -> Column:
    """An array of (choice, key): the values of two of the blocks."""
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.shiftleft(_block(a, width), width).bitwiseOR(_block(b, width)).alias("key")) for i, (a, b) in enumerate(combinations(blocks, 2))))


def _splits() -> Column:
    """For a crowded upper node: choices of two of the four 8-bit blocks of its other 32 bits."""
    out = F.lit(None)
    for i, (a, b) in reversed(list(enumerate(combinations(range(4), 2)))):
        rest = [2 * c + d for c in range(4) if c not in (a, b) for d in (0, 1)]
        out = F.when(F.col("choice") == i, _choices(rest, 8)).otherwise(out) if i < 5 else _choices(rest, 8)
    return out


def forest_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (fp, to) among distinct fingerprints that connect all within the distance (2 at most)."""
    if not 0 <= distance <= 2:
        raise ValueError("the index is exact for distances of 0 to 2")
    keyed = prints.select("fp", F.explode(_choices([0, 1, 2, 3], 16)).alias("node")).select("fp", "node.choice", "node.key")
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("choice", "key"))).filter("n > 1")
    whole = F.array(F.struct(F.lit(-1).alias("choice"), F.lit(0).cast("long").alias("key")))
    parts = sized.withColumn("part", F.explode(F.when(F.col("n") <= NODE, whole).otherwise(_splits())))
    nodes = parts.groupBy("choice", "key", "part").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest(fps, distance) for fps in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["fp", "to"])

    return nodes.select("fps").mapInArrow(run, "fp long, to long").distinct()


def _pairs_of_blocks(start: int, stop: int, blocks: int = 8) -> Column:
    """An array of (choice, key) for all pairs of the equal blocks of bits start to stop: what two fingerprints that agree
    on both blocks share."""
    width = (stop - start) // blocks
    block = [F.shiftrightunsigned(F.col("bits"), start + width * i).bitwiseAND((1 << width) - 1) for i in range(blocks)]
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.shiftleft(block[a], width).bitwiseOR(block[b]).alias("key")) for i, (a, b) in enumerate(combinations(range(blocks), 2))))


def _without_bytes() -> Column:
    """The 48 bits of the fingerprint outside the two bytes that a choice agrees on."""
    out = F.lit(0).cast("long")
    for i, (a, b) in enumerate(combinations(range(8), 2)):
        rest = [c for c in range(8) if c not in (a, b)]
        bits = [F.shiftleft(F.shiftrightunsigned("fp", 8 * c).bitwiseAND(255), 8 * k) for k, c in enumerate(rest)]
        out = F.when(F.col("choice") == i, F.expr("bigint(0)") + sum(bits[1:], bits[0])).otherwise(out)
    return out


def _sized(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of several fingerprints: those of NODE at most, and the crowded ones with their size n."""
    count = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    crowded, _ = written(count.filter(F.col("n") > NODE), "crowded")
    return nodes.join(crowded.drop("n"), keys, "left_anti"), nodes.join(crowded, keys)


def neighboured(prints: DataFrame, distance: int) -> DataFrame:
    """The distinct fingerprints (fp) that have another within the distance in a node of the index.

    Upper nodes share two of eight bytes: they hold all pairs of up to 6 different bits, and most of some more. A crowded
    node is split by two of eight blocks of its other 48 bits. One that is crowded still is sorted by Gray rank over
    range partitions: neighbours there answer for most fingerprints; the others are queries against its blocks of NODE.
    No pairs are given out.
    """
    spread = prints.select("fp", F.col("fp").alias("bits")).select("fp", F.explode(_pairs_of_blocks(0, 64)).alias("node")).select("fp", "node.choice", "node.key")
    small, crowded = _sized(spread, ["choice", "key"])
    found = _marked(small.groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps"), distance)
    if crowded.isEmpty():
        return found.distinct()
    cut = crowded.select("fp", "choice", "key", _without_bytes().alias("bits"))
    keys = ["choice", "key", "part"]
    small, crowded = _sized(cut.select("fp", "choice", "key", F.explode(_pairs_of_blocks(0, 48)).alias("part")), keys)
    found = found.union(_marked(small.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps"), distance))
    if crowded.isEmpty():
        return found.distinct()
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    order = ["choice", "key", "part", "rank", "fp"]
    ranked = crowded.select("fp", "choice", "key", "part", "n", rank.alias("rank")).repartitionByRange(*order).sortWithinPartitions(*order)
    adjacent, _ = written(ranked.select(F.col("fp"), F.struct("choice", "key", "part").alias("node"), "n").mapInPandas(_next_to(distance), "fp long, node struct<choice: int, key: long, part: struct<choice: int, key: long>>, n long, near boolean"), "adjacent")
    blocks = F.ceil(F.col("n") / NODE)
    own = adjacent.select("node", F.pmod(F.xxhash64("fp"), blocks).alias("block"), "fp", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("chunk"), "n")
    asking = adjacent.filter("NOT near").select("node", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "fp", F.lit(True).alias("asks"), F.pmod(F.xxhash64("fp"), blocks).alias("chunk"))
    some = asking.select("node", "block", "chunk").distinct()
    members = own.drop("chunk", "n").join(some, ["node", "block"])
    grouped = members.unionByName(asking).groupBy("node", "block", "chunk").agg(F.collect_list(F.when(~F.col("asks"), F.col("fp"))).alias("fps"), F.collect_list(F.when(F.col("asks"), F.col("fp"))).alias("queries"))
    answered = grouped.select("fps", "queries").mapInArrow(_answered(distance), "fp long")
    return found.union(adjacent.filter("near").select("fp")).union(answered).distinct()


def _marked(nodes: DataFrame, distance: int) -> DataFrame:
    """The fingerprints of each list that have another of it within the distance: short lists are compared side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            value = np.asarray(lists.flatten()).view(np.uint64)
            size = np.diff(np.asarray(lists.offsets))
            owner = np.repeat(np.arange(len(size)), size)
            near = np.zeros(len(value), bool)
            left = np.flatnonzero(size[owner] <= 4 * FAN)
            for step in range(1, 4 * FAN):
                left = left[left + step < len(value)]
                left = left[owner[left + step] == owner[left]]
                if not len(left):
                    break
                close = left[np.bitwise_count(value[left] ^ value[left + step]) <= distance]
                near[close] = near[close + step] = True
            out = [value[near]]
            end = np.cumsum(size)
            for i in np.flatnonzero(size > 4 * FAN).tolist():
                index = GrayIndex(value[end[i] - size[i] : end[i]])
                out.append(index.prints[index.neighboured(distance)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], names=["fp"])

    return nodes.mapInArrow(run, "fp long")


def _next_to(distance: int):
    """Whether the one before or after in the same node, in the order of the partition, is within the distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            node = np.array([repr(x) for x in batch["node"]])
            value = batch["fp"].to_numpy().view(np.uint64)
            close = np.append(False, (node[1:] == node[:-1]) & (np.bitwise_count(value[1:] ^ value[:-1]) <= distance))
            if held is not None:
                close[0] = held[1] == node[0] and int(held[2] ^ value[0]).bit_count() <= distance
                held[0].loc[held[0].index[-1], "near"] |= bool(close[0])
                yield held[0]
            held = batch.assign(near=close | np.append(close[1:], False)), node[-1], value[-1]
        if held is not None:
            yield held[0]

    return run


def _answered(distance: int):
    """The queries of each group that have another fingerprint of it within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for fps, queries in zip(*(c.to_pylist() for c in batch.columns)):
                asked = np.array(queries, np.int64).view(np.uint64)
                index = GrayIndex(np.unique(np.concatenate([np.array(fps, np.int64).view(np.uint64), asked])))
                member = np.isin(index.prints, np.array(fps, np.int64).view(np.uint64))
                for query, node in index.search(np.flatnonzero(np.isin(index.prints, asked)), distance):
                    out.append(np.unique(index.prints[query[(node != query) & member[node]]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["fp"])

    return run


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(fp, root): the least value of each one's component, for all that have a link.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing changes; each round is written to the shared
    folder. A hub's neighbours are never collected: minima are pre-aggregated, and joined back.
    """
    spark = links.sparkSession
    now, path = written(links.select(F.greatest("fp", "to").alias("u"), F.least("fp", "to").alias("v")).filter("u <> v").distinct(), name)
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        after, new_path = written(small, name)
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        now, path = after, new_path
        if state == seen:
            return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        state = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): 16 hexadecimal digits, and the least id that links reach."""
    rows, rooted = _rooted(fingerprints(docs, id_col, text_col, words), F.min(id_col), distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select(id_col, hexed, "component_id")


def _rooted(prints: DataFrame, first: Column, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows, written, and (fp, first, root) of each distinct fingerprint."""
    rows, _ = written(prints, "fingerprints")
    distinct = rows.groupBy("fp").agg(first.alias("first"))
    roots = components(forest_links(distinct.select("fp"), distance))
    linked = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    return rows, distinct.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def text_code(text_col: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.col(text_col).isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_first(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component of named (id, code, component), with all its columns: that of the least id, then of the
    least text_code(). Null ids come last. Of rows with equal id and text, the first by a hash of all columns stays."""
    found, _ = written(named.toDF("id", "code", "component"), "components")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("code"))
    first = found.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    joined = found.join(first, "component").withColumn("own", place)
    gone, _ = written(joined.filter(~F.col("own").eqNullSafe(F.col("first"))).select("id", "code").distinct(), "gone")
    again, _ = written(found.groupBy("id", "code").count().filter("count > 1").select("id", "code"), "again")
    code = text_code(text_col)

    def same(d: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
        return d.join(rows, d[id_col].eqNullSafe(rows["id"]) & (code == rows["code"]), how)

    kept = same(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    order = Window.partitionBy(F.col(id_col), code).orderBy(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))
    once = same(kept, again, "left_semi").select("*", F.row_number().over(order).alias("_place")).filter("_place = 1").drop("_place")
    return same(kept, again, "left_anti").unionByName(once)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One document of each component, with all its columns, as keep_first()."""
    coded = docs.select(F.col(id_col).alias("id"), text_code(text_col).alias("code"), F.col(text_col).alias("text"))
    rows, rooted = _rooted(fingerprints(coded, "id", "text", words, "code"), F.count(F.lit(1)), distance)
    return keep_first(docs, rows.join(rooted, "fp").select("id", "code", "root"), id_col, text_col)
