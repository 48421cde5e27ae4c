"""Brown class-based n-grams: a class bigram model from exchange clustering.

Exchange clustering takes the `cluster_words` most frequent words of all training texts and the counts of their bigrams
there: the words move, one after the other, to the class that raises the likelihood of the class bigrams most. All other
words are put into rare-word classes by one exchange step over their contexts. Words, bigrams, class transitions and
contexts are counted over all training texts; the number of clustered words alone is bounded, and with it the matrix of
their bigrams, (cluster_words + 2)**2 cells at most.

A token's probability is `weight` * p(class | class before) * p(word | class) + (1 - weight) * p0(word), with p0 the
add-0.1 unigram of all training tokens; p(class | rare, before) looks at the group of the class before. It sums to one
over the training words and one unknown word, which has p0 alone.

Texts are lower-cased (A-Z only) and split at ASCII white space; each ends with one end token. Null and empty texts are
an end token alone. Without training texts N and V are 0 and all tokens are unknown. Repeated rows have equal scores and
count as often as they occur. Rows with a null id are training rows. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, written

#: Bytes of text that a scoring group holds, the fewest groups, and the most partitions that they are dealt to.
GROUP_BYTES, LEAST_GROUPS, PARTITIONS = 8 << 20, 48, 20_000
#: Groups that contexts are merged into for rare words, which is also the number of rare-word classes.
RARE = 8


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def exchange(bigrams: np.ndarray, classes: int, passes: int = 6) -> np.ndarray:
    """Class of each word from a matrix of bigram counts; words stand in the order in which they move."""
    words = len(bigrams)
    counts = bigrams.astype(np.float64)
    label = np.arange(words) % classes
    one = np.eye(classes)[label]
    after, before = counts @ one, counts.T @ one
    joint = one.T @ after
    total = joint.sum(1), joint.sum(0)

    def g(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(passes):
        moved = 0
        for w in range(words):
            a, own = label[w], counts[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            n_right, n_left = right.sum() + own, left.sum() + own
            joint[a] -= right
            joint[:, a] -= left
            joint[a, a] -= own
            total[0][a] -= n_right
            total[1][a] -= n_left
            diagonal = np.diag(joint)
            gain = (g(joint + right) - g(joint)).sum(1) + (g(joint.T + left) - g(joint.T)).sum(1)
            gain += g(diagonal + right + left + own) - g(diagonal + right) - g(diagonal + left) + g(diagonal)
            gain -= g(total[0] + n_right) - g(total[0]) + g(total[1] + n_left) - g(total[1])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += right
            joint[:, b] += left
            joint[b, b] += own
            total[0][b] += n_right
            total[1][b] += n_left
            if b != a:
                moved += 1
                label[w] = b
                after[:, a] -= counts[:, w]
                after[:, b] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, b] += counts[w]
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Classes:
    """Class 0 is the end token; then come those of clustered words; contexts add one for all other words."""

    of: dict[bytes, int]
    number: int
    group: tuple[int, ...]

    @property
    def rare_context(self) -> int:
        return self.number + 1


def cluster(top: list[bytes], matrix: np.ndarray, classes: int) -> Classes:
    """Classes of the most frequent words, and the groups of contexts, from bigram counts (0: end, 1: any other word)."""
    size = len(top) + 2
    classes = min(classes, max(len(top), 1))
    label = exchange(matrix[2:, 2:], classes) if top else np.zeros(0, np.int64)
    one = np.zeros((size, classes + 2))
    one[0, 0] = one[1, classes + 1] = 1
    one[np.arange(2, size), label + 1] = 1
    joint = one.T @ matrix @ one
    order = np.argsort(-joint.sum(1), kind="stable")
    group = np.zeros(classes + 2, np.int64)
    group[order] = exchange(joint[np.ix_(order, order)], RARE)
    return Classes({w: int(c) + 1 for w, c in zip(top, label)}, classes, tuple(group.tolist()))


def _parts(batch: pa.RecordBatch) -> Iterator[list[bytes | None]]:
    column = batch.column(0)
    for a, b in slices(pc.binary_length(column).fill_null(0).to_pylist(), SLICE_BYTES):
        yield column.slice(a, b - a).to_pylist()


def frequent(texts: DataFrame, number: int) -> list[bytes]:
    """The most frequent words of all texts (one binary column), ties in the order of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                found: Counter[bytes] = Counter()
                for t in part:
                    found.update(tokens_of(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(number).collect()]


def bigrams(texts: DataFrame, top: list[bytes]) -> np.ndarray:
    """Counts of neighbours in all texts, over the end token, any other word, and the words given."""
    size = len(top) + 2
    shared = texts.sparkSession.sparkContext.broadcast({None: 0} | {w: i + 2 for i, w in enumerate(top)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        pairs = np.zeros(size * size, np.int64)
        for batch in batches:
            for part in _parts(batch):
                at = np.fromiter((get(w, 1) for t in part for w in (None, *tokens_of(t))), np.int64)
                at = np.append(at, 0)
                pairs += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        keys = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(pairs[keys])], names=["key", "n"])

    found = texts.mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def _count(docs: DataFrame, classes: Classes) -> DataFrame:
    """(word, key, n, g0..): for each word its count and that of the groups before it, unless it has a class; for each
    key = context * (number + 2) + class, with no word, the transitions; number + 1 stands for all rare words."""
    groups = [f"g{i}" for i in range(RARE)]
    width, rare = classes.number + 2, classes.rare_context
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        group = np.array(own.group)
        moves = np.zeros(width * width, np.int64)
        for batch in batches:
            for part in _parts(batch):
                split = [tokens_of(t) for t in part]
                names: dict[bytes, int] = {}
                for words in split:
                    for w in set(words).difference(names):
                        names[w] = len(names) + 1
                at = np.fromiter((i for words in split for i in (0, *map(names.__getitem__, words))), np.int64)
                at = np.append(at, 0)  # an end token stands before each text and after the last
                kinds = np.array([0] + [own.of.get(w, rare) for w in names])
                kind = kinds[at]
                moves += np.bincount(kind[:-1] * width + kind[1:], minlength=width * width)
                n = np.bincount(at, minlength=len(names) + 1)
                is_rare = kind[1:] == rare
                around = np.bincount(at[1:][is_rare] * RARE + group[kind[:-1][is_rare]], minlength=RARE * (len(names) + 1)).reshape(-1, RARE)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.binary()), pa.array(np.full(len(names), -1, np.int32)), pa.array(n[1:])] + [pa.array(c) for c in np.ascontiguousarray(around[1:].T)], names=["word", "key", "n", *groups])
        keys = np.flatnonzero(moves)
        zero = pa.array(np.zeros(len(keys), np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int32)), pa.array(moves[keys])] + [zero] * RARE, names=["word", "key", "n", *groups])

    found = docs.mapInArrow(run, "word binary, key int, n long, " + ", ".join(f"{g} long" for g in groups))
    return found.groupBy("word", "key").agg(F.sum("n").alias("n"), *(F.sum(g).alias(g) for g in groups))


@dataclass(frozen=True)
class Model:
    classes: Classes
    tokens: int  # N
    words: int  # V
    ends: int
    weight: float
    move: np.ndarray  # log-free p(class | context), the last class being all rare words
    rare: np.ndarray  # p(rare class | group)
    total: np.ndarray  # tokens of each class: end, clustered, rare


def train(docs: DataFrame, train_rows: Column, cluster_words: int = 1500, classes: int = 40, weight: float = 0.8, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and its vocabulary (word, n, class) as a written table."""
    texts = docs.filter(train_rows).select(F.col(text_col).cast("binary"))
    top = frequent(texts, cluster_words)
    made = cluster(top, bigrams(texts, top), classes)
    counted, _ = written(_count(texts, made), "counts")
    width = made.number + 2
    move = np.zeros(width * width)
    for r in counted.filter("word is null").select("key", "n").collect():
        move[r["key"]] = r["n"]
    move = move.reshape(width, width)
    groups = [f"g{i}" for i in range(RARE)]
    before = np.bincount(np.array(made.group), move[:, -1], RARE) + 1.0  # rare words after each group
    lift = [F.col(g) / F.lit(float(b)) for g, b in zip(groups, before)]
    most = F.greatest(*lift)
    rare = F.lit(0)
    for i in range(RARE - 1, -1, -1):
        rare = F.when(lift[i] == most, i).otherwise(rare)
    words = counted.filter("word is not null").select("word", "n", *groups, rare.alias("r"))
    named = docs.sparkSession.createDataFrame([(bytearray(w), c) for w, c in made.of.items()], "word binary, known int")  # at most cluster_words rows
    placed = words.join(F.broadcast(named), "word", "left").withColumn("class", F.coalesce("known", F.col("r") + made.number + 1))
    totals = np.zeros(made.number + 1 + RARE)
    steps, count_words = np.full((RARE, RARE), 0.1), 0
    for r in placed.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), *(F.sum(g).alias(g) for g in groups)).collect():
        totals[r["class"]] = r["n"]
        count_words += r["words"]
        if r["class"] > made.number:
            steps[:, r["class"] - made.number - 1] += [r[g] for g in groups]
    totals[0] = n_docs = int(move[:, 0].sum())
    smooth = move + 0.01
    model = Model(made, int(totals.sum()), count_words + bool(n_docs), n_docs, weight, smooth / smooth.sum(1, keepdims=True), steps / steps.sum(1, keepdims=True), np.maximum(totals, 1))
    return model, placed.select("word", "n", "class")


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Texts are dealt out in groups of bounded size, several to a partition where there are very many. Each group's distinct words are joined to the vocabulary and come
    back as the group's dictionary, so that a frequent word is looked up once a group, not once a token.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-size // GROUP_BYTES))
    dealt = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).alias("part")).repartition(int(min(groups, PARTITIONS)), "part")

    def distinct(rows: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for chunk in rows.column("text").chunks:
            for t in chunk.to_pylist():
                found.update(tokens_of(t))
        part = rows.column("part")[0].as_py()
        return pa.table({"part": pa.array(np.full(len(found), part, np.int64)), "word": pa.array(list(found), pa.binary())})

    words = dealt.groupBy("part").applyInArrow(distinct, "part long, word binary").join(vocabulary, "word")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(rows: pa.Table, entries: pa.Table) -> pa.Table:
        m = shared.value
        place = {w: i + 2 for i, w in enumerate(entries.column("word").to_pylist())}  # 0: end, 1: unknown
        n = np.concatenate([[m.ends, 0], entries.column("n").to_numpy()]).astype(float)
        kind = np.concatenate([[0, -1], entries.column("class").to_numpy()]).astype(np.int64)
        rare = m.classes.rare_context
        context = np.where((kind < 0) | (kind > m.classes.number), rare, kind)
        group = np.array(m.classes.group)
        base_of = (n + 0.1) / (m.tokens + 0.1 * (m.words + 1))
        within = np.where(n > 0, n / m.total[kind], 0)
        moves = np.concatenate([m.move[:, :-1], m.move[:, -1:] * m.rare[group]], 1)
        get = place.get
        sums: list[list] = [[], [], [], []]
        texts = [t for chunk in rows.column("text").chunks for t in chunk.to_pylist()]
        for a, b in slices([len(t or b"") for t in texts], SLICE_BYTES):
            split = [tokens_of(t) for t in texts[a:b]]
            length = np.array([len(s) + 1 for s in split])
            at = np.fromiter((i for s in split for i in (*(get(w, 1) for w in s), 0)), np.int64, int(length.sum()))
            previous = np.concatenate([[0], context[at[:-1]]])
            base = base_of[at]
            p = m.weight * moves[previous, kind[at]] * within[at] + (1 - m.weight) * base
            first = np.cumsum(length) - length
            sums[0].append(length)
            sums[1].append(np.add.reduceat((n[at] > 0).astype(np.int64), first))
            sums[2].append(np.add.reduceat(np.log10(base), first))
            sums[3].append(np.add.reduceat(np.log10(p), first))
        out = [pa.array(np.concatenate(s) if s else []) for s in sums]
        tokens = pa.array(np.full(len(texts), m.tokens, np.int64))
        return pa.table([rows.column(id_col), out[0], out[1], tokens, out[2], out[3]], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(judge, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
