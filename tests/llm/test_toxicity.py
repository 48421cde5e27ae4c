import zlib

import numpy as np
from pyspark.sql import functions as F

from gridmere.llm import queries, toxicity


def test_interaction_is_learned():
    """Neither term alone is toxic, both together are: no linear weights can say that."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append((int(a and b), sorted([1000 + int(rng.integers(50))] + [1] * int(a) + [2] * int(b))))
    machine = toxicity.fit(rows, (1, 1), features=8, steps=400)
    place = {int(b): i for i, b in enumerate(machine.buckets)}
    w, v = machine.linear, machine.factors

    def z(*terms):
        at = [place[t] for t in terms]
        s = v[at]
        return machine.bias + w[at].sum() + 0.5 * ((s.sum(0) ** 2 - (s**2).sum(0)).sum())

    assert z(1) < 0 and z(2) < 0 and z(1, 2) > 0


def plain_z(machine, terms):
    """The machine's sum, pair by pair."""
    at = [i for i, b in enumerate(machine.buckets) if int(b) in terms]
    pairs = sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
    return machine.bias + sum(float(machine.linear[i]) for i in at) + pairs


def test_terms_that_are_neutral_alone_are_kept():
    """The label is that exactly one of two terms stands in a text: neither tells anything alone."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append((int(a != b), sorted({*(1000 + rng.integers(0, 500, 20)).tolist()} | ({1} if a else set()) | ({2} if b else set()))))
    machine = toxicity.fit(rows, (2000, 2000), steps=400)
    assert {1, 2} <= set(machine.buckets.tolist())
    right = [(plain_z(machine, set(terms)) > 0) == bool(label) for label, terms in rows]
    assert np.mean(right) > 0.95


def test_scores_of_documents_match_the_sum_over_pairs(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.train(docs, labels, F.lit(True))
    assert len(machine.buckets) > 1
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, machine).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        terms = {b for w in toxicity.words_of(r["text"].encode()) for b in toxicity.buckets_of(w)}
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(plain_z(machine, terms), -60, 60)))) < 1e-9


def test_scores_match_the_formula():
    machine = toxicity.fit([(1, [3, 4]), (1, [3, 5]), (1, [3]), (0, [4]), (0, [5]), (0, [4, 5])] * 20, (60, 60), features=4)
    word = "insult"
    bucket = toxicity.buckets_of(word.encode())[0]
    own = toxicity.Machine(machine.bias, np.array([bucket]), machine.linear[:1], machine.factors[:1])
    assert abs(own.scorer()(b"An INSULT, an insult!") - 1 / (1 + np.exp(-(own.bias + own.linear[0])))) < 1e-12
    assert abs(own.scorer()(b"") - 1 / (1 + np.exp(-own.bias))) < 1e-12


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, path).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    caught = [got[i]["predicted"] for i in held if labels[i] == 1]
    false = [got[i]["predicted"] for i in held if labels[i] == 0]
    assert np.mean(caught) > 0.6 and np.mean(false) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, 0, None), (99, 1, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), labels.filter("toxic = 1")):
        machine = toxicity.train(odd_docs, own, F.lit(True))
        scored = toxicity.scores(odd_docs, machine).collect()
        assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
        kept = toxicity.with_scores(odd_docs, machine, score_col="_s")
        assert kept.columns == [*odd_docs.columns, "_s"]
        assert sorted(r["_s"] for r in kept.select("_s").collect()) == sorted(r["score"] for r in scored)
    assert toxicity.scores(no_docs, machine).count() == 0
