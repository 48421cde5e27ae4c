import numpy as np
import pytest
import xxhash

from gridmere.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    ids, prints = [i for i, _ in rows], np.array([p for _, p in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = list(range(len(rows)))
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        changed, label = new != label, new
    return [min((ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(rows))]


def check(spark, df):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(rows, plain_components(rows))]
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    check(spark, odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.without_duplicates(no_docs).count() == 0


def test_documents(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) for _ in range(5)]
    return np.unique(np.concatenate([base, *flips]))


def test_index_finds_every_link():
    prints = clusters(150, 3)
    index = simhash.GrayIndex(prints)
    got = {(a, b) for x, y in index.links(2) for a, b in zip(x.tolist(), y.tolist())}
    p = index.prints
    want = {(a, b) for a, b in zip(*np.where(np.bitwise_count(p[:, None] ^ p[None, :]) <= 2)) if a < b}
    assert got == want


@pytest.mark.parametrize("node", [4096, 4])
def test_links_through_nodes_that_are_split(spark, monkeypatch, node):
    monkeypatch.setattr(simhash, "NODE", node)
    prints = np.unique(np.concatenate([clusters(60, 5), np.uint64(0xABCD) << np.uint64(48) | clusters(60, 6) & np.uint64(0x3FF)])).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.forest_links(df)).collect()}
    rows = [(i, int(np.int64(p).view(np.uint64))) for i, p in enumerate(prints)]
    groups = {}
    for (i, _), c in zip(rows, plain_components(rows)):
        groups.setdefault(c, set()).add(int(prints[i]))
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = simhash.without_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8, 9, 10] and ids.count(None) == 1  # the other null id has no words either


@pytest.mark.parametrize("node", [4096, 40, 6])
def test_neighboured(spark, monkeypatch, node):
    """All that have another at up to 6 different bits are found, and none that has no other within the distance."""
    monkeypatch.setattr(simhash, "NODE", node)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[:200].copy()
    for _ in range(5):
        near ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    group = base[300] ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 120, dtype=np.uint64))
    prints = np.unique(np.concatenate([base, near, group]))
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    np.fill_diagonal(far, 64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    got = {r["fp"] for r in simhash.neighboured(df, 8).collect()}
    least = dict(zip(prints.view(np.int64).tolist(), far.min(1).tolist()))
    assert {p for p, d in least.items() if d <= 6} <= got <= {p for p, d in least.items() if d <= 8}
