import random
import re
from fractions import Fraction

import duckdb
import pytest

from gridmere.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(queries.MIXING)
    names = [d[0] for d in con.description]
    expected = sorted(con.fetchall())
    got = sorted(tuple(r[n] for n in names) for r in queries.op13_mixing(spark, SF).collect())
    assert got == expected


def test_no_python_worker(spark):
    plan = queries.op13_mixing(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def highest(votes, seats):
    """Seat by seat to the greatest quotient, the first of equal ones."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = max(votes, key=lambda p: (Fraction(votes[p], 2 * won[p] + 1), -p))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_against_seat_by_seat(spark, seed):
    draw = random.Random(seed)
    groups = {g: ({p: draw.choice([0, 1, 5, 5, draw.randrange(1, 10 ** draw.randrange(1, 6))]) for p in range(draw.randrange(1, 40))}, draw.choice([0, 1, 3, draw.randrange(500)])) for g in range(6)}
    groups[9] = ({p: 7 for p in range(25)}, 60)  # all quotients tie
    rows = [(g, p, v, seats) for g, (votes, seats) in groups.items() for p, v in votes.items()]
    df = spark.createDataFrame(rows, "g long, p long, votes long, seats long")
    found = {(r.g, r.p): r.quota for r in mixing.apportioned(df, "votes", "seats", ["g"], ["p"]).collect()}
    for g, (votes, seats) in groups.items():
        assert {p: found[g, p] for p in votes} == highest(votes, seats)
    one = df.filter("g = 9")
    assert {r.p: r.quota for r in mixing.apportioned(one, "votes", "seats", [], ["p"]).collect()} == highest(*groups[9])


def shared(sizes):
    """Targets by source, reshared until none is above its bound."""
    places = sorted((s is None, s or "") for s in sizes)
    weight = {(None if none else s): k % 3 + 1 for k, (none, s) in enumerate(places)}
    cut, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in cut)
        weights = sum(w for s, w in weight.items() if s not in cut)
        above = {s for s in sizes if s not in cut and 3 * sizes[s] * weights < weight[s] * left}
        if not above:
            return {s: float(3 * sizes[s]) if s in cut else weight[s] * left / weights if weights else 0.0 for s in sizes}
        cut |= above


def test_targets_and_takes(spark):
    draw = random.Random(8)
    rows = [(i, "w " * draw.randrange(400), draw.choice(["hot"] * 30 + ["a", "b", "é", "z", None])) for i in range(3000)]
    rows += [(9000 + i, "tiny words here", "tiny") for i in range(3)] + [(9100, "", "empty"), (9101, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.Plan(block=16, shard_docs=100)
    out = mixing.mixed(df, plan).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    aims = shared(sizes)
    assert len(out) == len(rows) and len({r.shard for r in out if r.source == "hot"}) > 20
    took = {}
    for r in out:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source], rel=1e-12)
        took[r.source] = took.get(r.source, 0) + r.taken
    shards = {s: len({r.shard for r in out if r.source == s}) for s in sizes}
    for s, aim in aims.items():
        assert abs(took[s] - aim) <= 16 * (1 + shards[s] * (aim >= 2.9 * sizes[s]))
    by_shard = {}
    for r in out:
        by_shard.setdefault((r.source, r.shard), [0, r.quota])[0] += r.taken
    assert all(taken == quota * 16 for taken, quota in by_shard.values())
    again = mixing.mixed(df.repartition(13), plan).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    other = mixing.mixed(df, mixing.Plan(block=16, shard_docs=100, seed="else")).collect()
    assert sorted((r.doc_id, r.taken) for r in other) != sorted((r.doc_id, r.taken) for r in out)


def test_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mixed(odd_docs, mixing.Plan(block=4)).collect()
    assert len(out) == odd_docs.count()
    assert sorted((r.doc_id or 0, r.size) for r in out) == sorted((r.doc_id or 0, len(re.findall(mixing.WORD, r.text or ""))) for r in odd_docs.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.mixed(no_docs).count() == 0
    same = spark.createDataFrame([(1, "one two three", "s")] * 500 + [(2, "x", None)], "doc_id long, text string, source string")
    got = mixing.mixed(same, mixing.Plan(block=8)).collect()
    assert len(got) == 501 and sum(r.taken for r in got) in range(1496, 1505)
    none = same.withColumn("text", same.text.substr(0, 0))
    assert {(r.size, r.taken, r.target) for r in mixing.mixed(none).collect()} == {(0, 0, 0.0)}


def test_more_words_than_an_int_holds(spark):
    sizes = spark.createDataFrame([("a", 10**9, 1), ("b", 10**9, 1), ("c", 1_000_000, 7)], "source string, size long, copies long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert found["c"] == 3 * 7_000_000 and found["a"] * 2 == found["b"] and abs(sum(found.values()) - 2_007_000_000) < 1e-3
