import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmere.llm import queries, repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def moves(before, row):
    """(cost, initial, role after) of each edit of a row."""
    yield 2, "D", before
    if row != "x":
        extra = 5 * row.isupper()
        for role in "sua":
            if (before, role) in NEXT:
                if row.lower() == role:
                    yield extra, "K", role
                if role != "s":
                    yield extra + 1, "R", role


def searched(rows):
    """Every edit in order of (cost, audit), without any table."""
    agenda = [(0, "", 0, "")]
    while agenda:
        cost, audit, place, before = heappop(agenda)
        if place == len(rows) and before in ("", "a"):
            return cost, audit
        for role in "ua":
            if (before, role) in NEXT:
                heappush(agenda, (cost + 5, audit + "I", place, role))
        if place < len(rows):
            for more, done, after in moves(before, rows[place]):
                heappush(agenda, (cost + more, audit + done, place + 1, after))


def filled(rows):
    """Row by row: the least (cost, audit) of each role before."""
    best = {"": (0, "")}

    def inserted():
        for _ in range(2):
            for before, (cost, audit) in list(best.items()):
                for role in "ua":
                    if (before, role) in NEXT:
                        best[role] = min(best.get(role, (1 << 60, "")), (cost + 5, audit + "I"))

    inserted()
    for row in rows:
        new = {}
        for before, (cost, audit) in best.items():
            for more, done, after in moves(before, row):
                new[after] = min(new.get(after, (1 << 60, "")), (cost + more, audit + done))
        best.clear()
        best.update(new)
        inserted()
    return min(best[b] for b in ("", "a") if b in best)


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOx", max_size=5))
def test_parse_against_search(rows):
    found = repair.parse(rows)
    assert min(found[s] for s in ("Empty", "Answered") if s in found) == searched(rows) == filled(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaoSUAOx"), st.integers(1, 90)), max_size=12))
def test_tables_of_parts(runs):
    runs = [(r, n if r == "x" else 1 + n % 3) for r, n in runs]
    whole = "".join(r * n for r, n in runs)
    table = repair.table_of(runs)["Empty"]
    assert min(table[s] for s in ("Empty", "Answered") if s in table) == filled(whole)


def plain(rows):
    """The contract, a conversation at a time."""
    spoken = lambda v: " " if v is None else str(v)
    by_id = {}
    for conv_id, turn, role, text in rows:
        kept = by_id.setdefault(conv_id, [])
        kind = zlib.crc32(f"{spoken(conv_id)}:{spoken(turn)}".encode()) % 20
        role, text = spoken(role), spoken(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv_id, kept in by_id.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in kept if r[0] is not None]
        counts, symbols, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
        for _, role, text in kept:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = filled(symbols)
        lines, before, rest = [], "", iter(kept)
        for done in audit:
            row = None if done == "I" else next(rest)
            if done == "D":
                continue
            role = row[1] if done == "K" else "assistant" if before == "u" else "user"
            lines.append(f"{role}:{row[2] if row else ''}")
            before = role[0]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv_id] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_plain(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '/root/testdata/{sf}/conversations.parquet'").fetchall()
        expected = plain(rows)
        assert result(queries.op11_repair(spark, f"/root/testdata/{sf}")) == expected
        assert any(v[0] for v in expected.values()) and all(sum(v[i] for v in expected.values()) for i in range(1, 6))


SCHEMA = "conv_id long, turn long, role string, text string, piece string, part int, digest string, copies string, fault string, first string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef"[:1], 1, *"cdef") for r in rows], SCHEMA)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, None, "user", None), (2, 5, "", ""), (2, 5, "", "x"), (3, 1, "tool", "a b. \n"), (3, 1, "user", "c!"), (3, 2, "User", "?"), (4, 7, "system", "x" * 300_000 + "."), (4, 9, "user", "漢字。"), (4, 9, "user", "漢字。"), (4, 12, "assistant", "\x00 end. ")]
    rows += [(i, t, r, "Text.") for i in range(10, 60) for t, r in enumerate(("system", "user", "assistant", "user"))]
    assert result(repair.repaired(repair.damaged(frame(spark, rows)))) == plain(rows)
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(repair.repaired(repair.damaged(frame(spark, [(dropped, 0, "user", "gone.")])))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(repair.damaged(frame(spark, rows).limit(0))).count() == 0


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_in_many_pieces(spark, small_parts):
    """A conversation that holds nearly all rows is parsed in pieces, with a turn of thousands of equal rows."""
    draw = random.Random(5)
    rows = [(7, draw.choice([None, *range(900)]), draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["One.", "Two", "", "Three?", f"Own {i}.", f"Own {i}"])) for i in range(2500)]
    rows += [(7, 450, "user", "Again and again.")] * 1500 + [(i, 0, "user", "Hi.") for i in (5, 6, 8)]
    draw.shuffle(rows)
    df = repair.damaged(frame(spark, rows)).repartition(5)
    assert repair.pieces(df).filter("conv_id = 7").count() > 3
    assert result(repair.repaired(df)) == plain(rows)
