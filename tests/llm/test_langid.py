import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmere.llm import langid, queries


def plain_phrases(symbols, text):
    n = i = 0
    while i < len(symbols):
        k = 1
        while i + k < len(symbols) and symbols[i : i + k + 1] in text:
            k += 1
        n, i = n + 1, i + k
    return n


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd é", min_size=1, max_size=400), st.text(alphabet="abcde éж", min_size=1, max_size=400))
def test_phrases_are_longest_matches(sample, text):
    own, symbols = langid.folded(sample.encode()), langid.folded(text.encode())
    if own is None or symbols is None:
        return
    parser = langid.Parser({"x": own.tobytes()})
    for block in (langid.BLOCK, 64):
        langid.BLOCK, before = block, langid.BLOCK
        try:
            want = sum(plain_phrases(symbols.tobytes()[a : a + block], own.tobytes()) for a in range(0, len(symbols), block))
            assert parser.phrases([symbols])[0, 0] == want
        finally:
            langid.BLOCK = before


def test_judgements_match_brute_force(spark):
    """Language, score and entropy of documents, from longest matches looked up in the samples."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.samples(docs, F.lit(True), sample_chars=3000)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        symbols = langid.folded(r["text"][:3000].encode())
        if len(symbols) > langid.BLOCK or len(r["text"]) > 3000:
            continue
        bits = {k: plain_phrases(symbols.tobytes(), v) * np.log2(len(v) + 2) for k, v in model.items()}
        best = min(sorted(bits), key=bits.get)
        own = got[r["doc_id"]]
        assert own["lang_pred"] == best
        assert abs(own["score"] - 1 / sum(2 ** (-min(b - bits[best], 60) / 4) for b in bits.values())) < 1e-9
        assert abs(own["entropy"] - bits[best] / len(symbols)) < 1e-9


def test_many_languages_and_scripts(spark):
    """No letter is merged and no language left out, whatever their number and the length of their texts."""
    rng = np.random.default_rng(2)
    rows = []
    for k, start in enumerate([0x61, 0x430, 0x3B1, 0x905, 0x5D0, 0x627, 0xAC00, 0x4E00, 0x31350, *range(0x5000, 0x9000, 0x100)]):
        word = lambda: "".join(chr(start + int(i)) for i in rng.integers(0, 20, 4))  # noqa: E731, B023
        lexicon = [word() for _ in range(60)]
        for _ in range(4):
            rows.append((len(rows), " ".join(rng.choice(lexicon, 6000 if k == 1 else 80)), f"l{k:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.samples(docs, F.col("doc_id") % 4 != 3)
    assert len(model) == 73
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in langid.identify(docs, model).collect())


def test_letters_decide_what_is_undetermined():
    parser = langid.Parser({"x": langid.folded(b"some words").tobytes()})
    texts = ["\u0301\u0302", "12 !?", "", "\U00031350", "a", "\u0301b"]
    assert parser.judge([t.encode() for t in texts])[0] == ["und", "und", "und", "x", "x", "x"]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op1_langid(spark, path).collect()}
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.samples(odd_docs, F.lit(True))
    rows = [tuple(r) for r in langid.identify(odd_docs, model).collect()]
    by_id = {r[0]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by_id[2][1:3] == by_id[3][1:3] == by_id[4][1:3] == by_id[10][1:3] == ("und", 0.0)
    assert by_id[1][1] == "en" and by_id[5][1] == "de"
    assert all(0 <= r[2] <= 1 for r in rows)
    kept = langid.with_languages(odd_docs, model)
    assert sorted((r["identified"]["lang_pred"] for r in kept.select("identified").collect())) == sorted(r[1] for r in rows)
    assert langid.samples(no_docs, F.lit(True)) == {}
    assert {r["lang_pred"] for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
