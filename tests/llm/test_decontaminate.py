import re
import time
from collections import Counter

import numpy as np
import pytest

from gridmere.llm import decontaminate as dc


def plain_leaks(docs, items, overlap=0.8):
    """All pairs of a document and an item whose question and answer stand in it, by runs of five words."""
    out = set()
    split = {i: [w for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if (w := dc.words_of(s.encode()))] for i, text in items}
    for d, text in docs:
        words = dc.words_of((text or "").encode())
        have = dc.shingles(words)
        for i, sentences in split.items():
            parts = [[w for s in sentences[:-1] for w in s] or sentences[0], sentences[-1]] if sentences else []
            shares = []
            for want in parts:
                if len(want) < dc.SHINGLE:
                    shares.append(float(any(words[k : k + len(want)] == want for k in range(len(words)))))
                else:
                    shares.append(len(dc.shingles(want) & have) / len(dc.shingles(want)))
            if shares and min(shares) >= overlap:
                out.add((d, i))
    return out


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_documents(spark, size):
    sf = f"/root/testdata/sf{size}"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_leaks(docs.select("doc_id", "text").collect(), items.collect())
    assert want
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()} == want
    gone = {d for d, _ in want}
    kept = dc.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - gone


def test_shards_find_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    shown = lambda df: sorted((*r[:2], round(r[2], 9), *r[3:]) for r in df.collect())
    whole, kept = shown(dc.leaks(docs, items)), dc.without_leaks(docs, items).count()
    monkeypatch.setattr(dc, "SHARD_BYTES", 3000)
    assert shown(dc.leaks(docs, items)) == whole and dc.without_leaks(docs, items).count() == kept


def test_search_returns_all_above_the_threshold():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        x = rng.random(12)
        rows.append((i, np.sort(rng.choice(60, 12, replace=False)).astype(np.uint64), x / x.sum() / 0.45))
    tier = dc.Tier(16, rows, [0.45] * len(rows))
    for _ in range(200):
        terms = sorted(rng.choice(len(tier.keys), int(rng.integers(1, 50)), replace=False).tolist())
        score = Counter()
        for k in terms:
            for at in range(tier.first[k], tier.first[k + 1]):
                score[int(tier.entry[at])] += float(tier.impact[at])
        got = dict(tier.search(terms))
        assert set(got) == {e for e, s in score.items() if s >= 1 - 1e-9}
        assert all(abs(got[e] - score[e]) < 1e-9 for e in got)


def test_large_index(monkeypatch):
    """20,000 items: built in bounded time, and a clean text costs the same with few items and with many."""
    rng = np.random.default_rng(8)
    lexicon = [f"w{i}".encode() for i in range(30_000)]
    draw = lambda n: [lexicon[min(int(k), 29_999)] for k in rng.zipf(1.2, n)]
    items = [(i, b" ".join(draw(45)) + b". " + b" ".join(draw(5))) for i in range(20_000)]
    began = time.perf_counter()
    large = dc.Index(items, None, len(items), 45.0, 0.8)
    assert time.perf_counter() - began < 60
    small = dc.Index(items[:200], None, 200, 45.0, 0.8)
    texts = [draw(400) for _ in range(200)]
    searched = Counter()
    search = dc.Tier.search
    monkeypatch.setattr(dc.Tier, "search", lambda self, terms: searched.update([len(self.of_item)]) or search(self, terms))
    assert not any(small.candidates(texts)) and not any(large.candidates(texts))
    assert sum(searched.values()) < 20  # of 4,800 passages
    planted = [draw(100) + dc.words_of(items[k][1]) + draw(100) for k in range(0, 20_000, 400)]
    assert all(k in found for k, found in zip(range(0, 20_000, 400), large.candidates(planted)))


def test_no_copy_with_the_overlap_is_missed():
    """Whatever words are changed, an entry of which a passage holds 0.8 of the runs is found."""
    rng = np.random.default_rng(3)
    lexicon = [f"w{i}".encode() for i in range(300)]
    items = [(i, b" ".join(lexicon[int(k) % 300] for k in rng.zipf(1.3, int(rng.integers(5, 60))))) for i in range(400)]
    index = dc.Index(items, None, len(items), 30.0, 0.8)
    met = 0
    for i, text in items:
        words = dc.words_of(text)
        for _ in range(5):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(1, 4))):
                copy[at] = b"changed"
            if len(dc.shingles(copy) & dc.shingles(words)) >= 0.8 * len(dc.shingles(words)):
                met += 1
                assert i in index.candidates([[b"x"] * 7 + copy + [b"y"] * 9])[0]
    assert met > 100


def test_question_and_answer_decide(spark):
    question, answer = "One two three four five six seven eight nine ten eleven twelve?", "Thirteen fourteen fifteen sixteen seventeen eighteen."
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(1, f"{question} {answer}"), (2, f"{question} {filler} {answer}"), (3, f"{question} Another answer stands here."), (4, answer), (5, f"zero {question[4:]} {answer}"), (6, filler)]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, f"{question}\n{answer}")], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 5]


@pytest.mark.parametrize("size", [3, 9, 40, 90, 200])
def test_leaks_anywhere_in_a_text(spark, size):
    rng = np.random.default_rng(size)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = " ".join(word() for _ in range(size)) + ". " + " ".join(word() for _ in range(6)) + "."
    docs = [(k, " ".join([*(word() for _ in range(int(rng.integers(0, 400)))), item.upper() if k % 2 else item, *(word() for _ in range(int(rng.integers(0, 400))))])) for k in range(12)]
    clean = [(100 + k, " ".join(word() for _ in range(300))) for k in range(5)]
    d = spark.createDataFrame(docs + clean, "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, " ".join(word() for _ in range(30)))], "item_id long, text string")
    rows = dc.leaks(d, i).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(k, 1) for k, _ in docs}
    assert all(r["question_overlap"] == r["answer_overlap"] == 1 for r in rows)


@pytest.mark.parametrize("apart", [0, 5, 20, 300])
def test_questions_in_pieces(spark, apart):
    """Questions whose pieces, which overlap by four words, stand in any order and any distance, by brute force."""
    rng = np.random.default_rng(apart)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items, docs = [], []
    for k, size in enumerate((12, 20, 33, 70, 150)):
        question, answer = [word() for _ in range(size)], [word() for _ in range(6)]
        items.append((k, " ".join(question) + ". " + " ".join(answer) + "."))
        for pieces in (2, 3):
            ends = [size * i // pieces for i in range(pieces + 1)]
            parts = [question[max(a - 4, 0) : b] for a, b in zip(ends, ends[1:])] + [answer]
            for share in (1.0, 0.7):  # the second has lost most of its first piece
                own = [p if share == 1 or i else p[: max(len(p) // 4, 1)] for i, p in enumerate(parts)]
                order = rng.permutation(len(own))
                docs.append((len(docs), " ".join(w for i in order for w in (*own[i], *(word() for _ in range(apart))))))
    want = plain_leaks(docs, items)
    assert len(want) >= 10 and len(want) < len(docs)
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(0 <= r["first_word"] < r["last_word"] for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "cat sat on the mat and looked", "x"), (4, "Der Hund und die Katze sind im Haus und nicht im Garten", "x"), (5, "Der Hund und die Katze sind im Haus und nicht im Garten", "y")], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.leaks(odd_docs, items).collect()), key=repr)
    assert got == sorted([(1, None), *((d, i) for d in (5, 6, 6) for i in (4, 5))], key=repr)
    assert dc.leaks(no_docs, items).count() == 0
    assert dc.leaks(odd_docs, items.limit(0)).count() == 0
    assert dc.without_leaks(odd_docs, items).count() == odd_docs.count() - 4
    assert dc.without_leaks(odd_docs, items.limit(0)).count() == odd_docs.count()
