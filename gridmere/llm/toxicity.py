"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a text and their first letters, hashed to 2**HASH_BITS buckets; a text's features are the
buckets that it has. The machine is w0 + sum of w_i + sum over pairs of <v_i, v_j>, so that two terms together, such as
an insult and a mention of a group, count for more or less than both alone. It is fitted on a bounded sample of
labelled rows: at most `per_class` of each label, the first in the order of a hash of their ids. Buckets that at least
three of them have get weights if they tell something alone (their share differs between the labels: chi-square over 11)
or with another (the covariance of two differs between the labels: chi-square over 45, as there are many pairs), so that
two terms that are each neutral alone are kept. Of the first at most `features` are taken, the clearest; pairs are looked
for among the `pair_terms` most frequent buckets of the sample. Scoring covers all texts whole.

Null and empty texts have no term and get the base score. Labels other than 0 and 1, null labels and labels without a
document teach nothing; of rows with one id, that of the least hash of its text teaches; without both labels the score is the share of label 1, or 0. Repeated rows have equal scores. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, map_texts, small_batches

HASH_BITS = 28
#: Bytes of a word that its prefix term has.
PREFIX = 5
#: Words whose features a worker remembers; it bounds memory only.
REMEMBERED = 150_000
#: ASCII letters in lower case, other ASCII bytes as spaces; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def buckets_of(word: bytes) -> list[int]:
    """The hashed terms of a word."""
    out = [xxhash.xxh32_intdigest(b"w" + word) >> (32 - HASH_BITS)]
    if len(word) > PREFIX:
        out.append(xxhash.xxh32_intdigest(b"p" + word[:PREFIX]) >> (32 - HASH_BITS))
    elif len(word) == PREFIX:
        out.append(xxhash.xxh32_intdigest(b"p" + word) >> (32 - HASH_BITS))
    return out


@dataclass(frozen=True)
class Machine:
    """Weights of the buckets: position i of `linear` and `factors` is that of buckets[i]."""

    bias: float
    buckets: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def scorer(self):
        place = {int(b): i for i, b in enumerate(self.buckets)}
        features: dict[bytes, tuple[int, ...]] = {}

        def score(text: bytes) -> float:
            found = words_of(text)
            new = found.difference(features)
            if len(features) + len(new) > REMEMBERED:
                features.clear()
                new = found
            for word in new:
                features[word] = tuple(place[b] for b in buckets_of(word) if b in place)
            at = sorted({i for word in found for i in features[word]})
            total = self.bias
            if at:
                v = self.factors[at]
                total += float(self.linear[at].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
            return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))

        return score


def sample(docs: DataFrame, labels: DataFrame, train: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[tuple[int, np.ndarray]], tuple[int, int]]:
    """Hashed terms of at most per_class labelled rows a label, and how many training labels there are of each."""
    known = labels.filter(train & F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).alias("label"))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.col(id_col)
    chosen = known.filter("label = 0").orderBy(*order).limit(per_class).union(known.filter("label = 1").orderBy(*order).limit(per_class))
    joined = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen.dropDuplicates([id_col])), id_col)
    rows = joined.groupBy(id_col, "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))

    def make():
        return lambda label, texts: (label, [np.unique([b for w in words_of(t or b"") for b in buckets_of(w)]).astype(np.int64).tolist() for t in texts])

    terms = map_texts(rows.select("label", "text"), "label int, terms array<int>", make)
    found = terms.toArrow()  # numbers side by side, not objects
    rows = [(y, np.asarray(t.values)) for y, t in zip(found.column("label").to_pylist(), found.column("terms"))]
    return rows, (count.get(0, 0), count.get(1, 0))


def _telling_pairs(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    """Columns of a 0/1 matrix that have a partner: their covariances differ between the labels, in standard errors."""
    cov, error = [], []
    for label in (0, 1):
        own = x[y == label]
        own = own - own.mean(0)
        cov.append(own.T @ own / max(len(own), 1))
        error.append((own**2).T @ (own**2) / max(len(own), 1) ** 2)
    clear = (cov[1] - cov[0]) ** 2 / (error[0] + error[1] + 1e-9)
    np.fill_diagonal(clear, 0)
    return clear.max(1, initial=0) > bound


def fit(rows: list[tuple[int, list[int]]], counts: tuple[int, int], features: int = 4000, pair_terms: int = 1500, rank: int = 4, steps: int = 250) -> Machine:
    """Adam on the whole sample's log loss, classes weighted alike; the bias then takes on the labels' true share."""
    empty = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank))
    y = np.array([label for label, _ in rows], float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 1e-26
        return Machine(float(np.log(share / (1 - share))), *empty)
    of_row = np.repeat(np.arange(len(rows)), [len(t) for _, t in rows])
    term = np.concatenate([np.asarray(t, np.int64) for _, t in rows])
    names, column = np.unique(term, return_inverse=True)
    pos, neg = np.bincount(column, y[of_row], len(names)), np.bincount(column, 1 - y[of_row], len(names))
    share1, share0 = pos / y.sum(), neg / (1 - y).sum()
    both = (pos + neg) / len(y)
    clear = (share1 - share0) ** 2 / (both * (1 - both) * (1 / y.sum() + 1 / (1 - y).sum()) + 1e-12)  # chi-square, one degree
    clear[pos + neg < 3] = 0
    best = np.lexsort((names, -clear))[:features]
    best = best[clear[best] > 11]
    often = np.lexsort((names, -both))[:pair_terms]
    often = often[(pos + neg)[often] >= 3]
    x = np.zeros((len(rows), len(often)), np.float32)
    place = np.full(len(names), -1)
    place[often] = np.arange(len(often))
    kept = place[column] >= 0
    x[of_row[kept], place[column[kept]]] = 1
    best = np.union1d(best, often[_telling_pairs(x, y, 45)])
    del x
    if not len(best):
        best = np.lexsort((names, -clear))[:1]
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    kept = place[column] >= 0
    x = np.zeros((len(rows), len(best)), np.float32)
    x[of_row[kept], place[column[kept]]] = 1
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    y = y.astype(np.float32)
    rng = np.random.default_rng(17)
    params = [np.zeros(1), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), rank))]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        bias, linear, factors = (p.astype(np.float32) for p in params)
        xv = x @ factors
        z = bias + x @ linear + 0.5 * (xv**2 - x @ factors**2).sum(1)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        by_term = x.T @ error
        grads = [np.array([error.sum()]), by_term + 2e-6 * linear, x.T @ (error[:, None] * xv) - by_term[:, None] * factors + 2e-5 * factors]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g**2
            params[i] = params[i] - 0.05 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-9)
    prior = np.log(max(counts[1], 1) / max(counts[0], 1))
    return Machine(float(params[0][0] + prior), names[best], params[1], params[2])


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = 3000, **columns: str) -> Machine:
    return fit(*sample(docs, labels, train_rows, per_class, **columns))


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every text."""

    def make():
        score = machine.scorer()
        return lambda keys, texts: (keys, [score(t or b"") for t in texts])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col), F.col(text_col).cast("binary")), f"`{id_col}` {kind}, score double", make)


def with_scores(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score, without a join: for filters."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold(__name__)
        score = machine.scorer()
        for texts in batches:
            yield texts.map(score).astype(float)

    return docs.withColumn(score_col, score_of(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))))
