import numpy as np
import pytest

from gridmere.llm import chat


def plain_viterbi(model, blocks):
    score, back = model.step[-1] + blocks[0], []
    for e in blocks[1:]:
        total = score[:, None] + model.step[:-1]
        back.append(total.argmax(0))
        score = total.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def conversations(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(lengths):
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            size = {"user": 6, "assistant": 40, "system": 12}[role]
            rows.append((c, t, role, " ".join("word" for _ in range(int(rng.integers(1, size)))) + ("?" if role == "user" and rng.random() < 0.5 else ".")))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("segment", [64, 3, 2])
def test_roles_are_those_of_one_viterbi_pass(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows = conversations(spark, [1, 2, 3, 17, 40, 5])
    found = chat.blocks(rows)
    model = chat.fit(found)
    got = {}
    for r in sorted(chat.roles(found, model).collect(), key=lambda r: (r["conv_id"], r["turn"], r["block"])):
        got.setdefault(r["conv_id"], []).append(r)
    pdf = found.toPandas().sort_values(["conv_id", "turn", "block"])
    assert found.toPandas().groupby(["conv_id", "seg"]).size().max() <= segment
    assert len(got) == 6
    for c, own in pdf.groupby("conv_id"):
        path = plain_viterbi(model, model.emissions(own))
        assert [model.roles.index(r["role_pred"]) for r in got[c]] == path
        assert [r["opens"] for r in got[c]] == [i == 0 or path[i] != path[i - 1] for i in range(len(path))]


def plain_counts(rows):
    """Neighbouring roles, both labelled, and first roles, of rows (conv_id, role) in order."""
    out, before = {}, {}
    for conv, role in rows:
        key = before.get(conv, "")
        if role is not None and key is not None:
            out[key, role] = out.get((key, role), 0) + 1
        before[conv] = role
    return out


@pytest.mark.parametrize("segment", [64, 3])
def test_steps_over_borders_of_segments_count(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows = [(c, t, None if (c * 7 + t * 3) % 11 == 0 else role, text) for c, t, role, text in conversations(spark, [1, 2, 30, 17, 9]).collect()]
    model = chat.fit(chat.blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), smooth=0.5)
    want = plain_counts([(c, role) for c, t, role, _ in sorted(rows, key=lambda r: r[:2])])
    n = len(model.roles)
    counts = np.array([[want.get((a, b), 0) + 0.5 for b in model.roles] for a in (*model.roles, "")])
    assert n == 3 and np.allclose(np.exp(model.step), counts / counts.sum(1, keepdims=True))


def test_places_count_every_block_once(spark):
    """Rows without a turn, of one turn, equal rows and many blocks of one row, over ranges that cut conversations."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges stay cut
    try:
        n = 20_000
        many = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same words?").alias("text"))
        one_turn = spark.range(5000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(3).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
        one_row = spark.createDataFrame([(2, 0, None, "\n".join(f"user: line {i}" for i in range(1000)))], "conv_id long, turn long, role string, text string")
        found = chat.blocks(many.union(one_turn).union(one_row))
        got = {r["conv_id"]: (r["n"], r["d"], r["low"], r["high"]) for r in found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("low"), F.max("place").alias("high")).collect()}
        assert got == {1: (n, n, 0, n - 1), None: (5000, 5000, 0, 4999), 2: (1000, 1000, 0, 999)}
        assert found.groupBy("conv_id", "seg").count().agg(F.max("count")).first()[0] == chat.SEGMENT
        assert [r["text"] for r in found.filter("conv_id = 2").orderBy("place").collect()] == [f"line {i}" for i in range(1000)]
        model = chat.fit(found)
        parsed = chat.roles(found, model)
        assert parsed.count() == n + 6000 and parsed.filter("opens").filter("conv_id = 1").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_markers_cut_rows_and_name_roles(spark):
    text = "System: be brief\nUser: hello there\nand a second line\n### Assistant: hi\nHuman: bye?\nnot a marker: x"
    rows = spark.createDataFrame([(1, 0, None, text)], "conv_id long, turn long, role string, text string")
    model = chat.fit(chat.blocks(conversations(spark, [4, 6, 8, 5, 7])))
    parsed = chat.rendered(chat.roles(chat.blocks(rows), model)).orderBy("block").collect()
    assert [r["role_pred"] for r in parsed] == ["system", "user", "assistant", "user"]
    whole = "".join(r["rendered"] for r in parsed)
    assert whole == "<|system|>\nbe brief\n<|user|>\nhello there\nand a second line\n<|assistant|>\nhi\n<|user|>\nbye?\nnot a marker: x\n"


def test_held_out_roles(spark):
    from pyspark.sql import functions as F

    from gridmere.llm import queries

    got = queries.op2_chat(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got.count() == truth.count()
    right = got.filter("held_out").join(truth, ["conv_id", "turn"]).agg(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).first()[0]
    assert right > 0.9


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None, "b"), (None, 1, "user", "x", "b"), (1, 1, "user", "", "b"), (1, 1, "user", "", "b"), (1, None, "assistant", "y" * 100_000, None)], "conv_id long, turn long, role string, text string, block string")
    for labelled in (rows, rows.limit(0)):
        model = chat.fit(chat.blocks(labelled))
        out = chat.rendered(chat.roles(chat.blocks(rows), model)).collect()
        assert len(out) == 5 and all(r["role_pred"] in model.roles for r in out)
    assert chat.roles(chat.blocks(rows.limit(0)), model).count() == 0
