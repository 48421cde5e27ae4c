import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridmere.llm import classlm


def likelihood(bigrams, label):
    one = np.eye(label.max() + 1)[label]
    joint = one.T @ bigrams @ one

    def g(x):
        return (x * np.log(np.maximum(x, 1))).sum()

    return g(joint) - g(joint.sum(0)) - g(joint.sum(1))


def test_exchange_raises_the_likelihood_to_a_local_optimum():
    rng = np.random.default_rng(2)
    bigrams = rng.poisson(0.3, (14, 14)) + np.kron(np.array([[0, 3], [3, 0]]), np.ones((7, 7), int)) * rng.integers(0, 2, (14, 14))
    label = classlm.exchange(bigrams.astype(float), 3, 30)
    best = likelihood(bigrams, label)
    assert best >= likelihood(bigrams, np.arange(14) % 3)
    for w in range(14):
        for c in range(3):
            other = label.copy()
            other[w] = c
            assert likelihood(bigrams, np.append(other, [])[:14].astype(int)) <= best + 1e-6


def check(docs, train_rows, train, **sizes):
    model, vocabulary = classlm.train(docs, train_rows, **sizes)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    counts = Counter()
    for i, words in rows:
        if train(i):
            counts.update(words)
            counts["end"] += 1
    total, distinct = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (total, distinct)
    kinds = {bytes(r["word"]): (r["n"], r["class"]) for r in vocabulary.collect()}
    assert {w: n for w, (n, _) in kinds.items()} == {w: n for w, n in counts.items() if w != "end"}
    got = sorted(map(tuple, classlm.score(docs, model, vocabulary).collect()), key=repr)
    want = []
    group, rare = model.classes.group, model.classes.rare_context
    for i, words in rows:
        base = score = 0.0
        before = known = 0
        for w in [*words, "end"]:
            n = counts[w]
            p0 = (n + 0.1) / (total + 0.1 * (distinct + 1))
            kind = 0 if w == "end" else kinds.get(w, (0, None))[1]
            own = 0.0
            if n and kind is not None:
                step = model.move[before, kind] if kind <= model.classes.number else model.move[before, -1] * model.rare[group[before], kind - model.classes.number - 1]
                own = step * n / model.total[kind]
            base += math.log10(p0)
            score += math.log10(model.weight * own + (1 - model.weight) * p0)
            known += n > 0
            before = rare if kind is None or kind > model.classes.number else kind
        want.append((i, len(words) + 1, known, total, base, score))
    want.sort(key=repr)
    by = lambda rows: sorted(rows, key=lambda r: (repr(r[0]), r[1], round(r[4], 6)))
    for g, w in zip(by(got), by(want), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-9)
    return model


def test_probabilities_sum_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    model, vocabulary = classlm.train(docs, F.lit(True), cluster_words=100, classes=8)
    rows = vocabulary.collect()
    assert np.allclose(model.move.sum(1), 1) and np.allclose(model.rare.sum(1), 1)
    for before in (0, 3, model.classes.rare_context):
        total = model.move[before, 0]
        for r in rows:
            c = r["class"]
            step = model.move[before, c] if c <= model.classes.number else model.move[before, -1] * model.rare[model.classes.group[before], c - model.classes.number - 1]
            total += step * r["n"] / model.total[c]
        assert abs(total - 1) < 1e-6


def test_scores_against_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    fold = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    model = check(docs, ~(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0), fold, cluster_words=200, classes=10)
    assert model.tokens > 1000


def test_bigrams_cover_all_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    texts = docs.select(F.col("text").cast("binary"))
    top = classlm.frequent(texts, 150)
    counts, pairs = Counter(), Counter()
    split = [(r["text"] or "").encode().lower().split() for r in docs.collect()]
    for words in split:
        counts.update(words)
    assert top == sorted(counts, key=lambda w: (-counts[w], w))[:150]
    place = {w: i + 2 for i, w in enumerate(top)}
    for words in split:
        at = [0, *(place.get(w, 1) for w in words), 0]
        pairs.update(zip(at, at[1:]))
    got = classlm.bigrams(texts.repartition(5), top)
    assert {(a, b): int(got[a, b]) for a, b in zip(*np.nonzero(got))} == dict(pairs)


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs, F.lit(True), lambda i: True, cluster_words=20, classes=4)
    check(odd_docs, F.lit(False), lambda i: False, cluster_words=20, classes=4)
    model, vocabulary = classlm.train(no_docs, F.lit(True))
    assert model.tokens == 0 and classlm.score(no_docs, model, vocabulary).count() == 0
