"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from docmill.llm import conversation_repair as cr

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows):
    """The contract, read literally, for one table of (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if x == 0:
                continue
            text = "" if x == 1 else "".join(c for c in text if c not in ".!?") if x == 2 else text
            kept += [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in kept:
            end = text.rstrip(BLANKS)
            kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @lru_cache(None)
        def best(i, last, inserted):
            """(cost, audit, repaired turns) from turn i on, after a turn of initial ``last``."""
            ways = []
            if i == len(kept):
                if last in ("", "a"):
                    return 0, "", ()
            else:
                _, role, text = kept[i]
                ways.append((2, "D", None, best(i + 1, last, 0)))
                if kinds[i] not in ("blank", "duplicate"):
                    extra = 5 if kinds[i] == "truncated" else 0
                    if role[:1] in after[last]:
                        ways.append((extra, "K", (role, text), best(i + 1, role[:1], 0)))
                    for new in ("user", "assistant"):
                        if new[0] in after[last]:
                            ways.append((1 + extra, "R", (new, text), best(i + 1, new[0], 0)))
            if inserted < 3:
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        ways.append((5, "I", (new, ""), best(i, new[0], inserted + 1)))
            ways = [(c + r[0], x + r[1], ((t,) if t else ()) + r[2]) for c, x, t, r in ways if r]
            return min(ways, key=lambda w: w[:2]) if ways else None

        cost, audit, repaired = best(0, "", 0)
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = cr.digests(df).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(n, seed=3):
    rnd, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rnd.choice([0, 1, 2, 5, 9])):
            text = rnd.choice([None, "", " \t", "Yes.", "No!", "half", "Yes. \n", "a b?", "ünd so.\x0b", "x" * 3000 + "."])
            rows.append((conv, None if rnd.random() < 0.1 else turn - rnd.randint(0, 2), rnd.choice([None, "", "system", "user", "assistant", "tool", "assistant"]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_search(spark):
    rows = made(150)
    rows += rows[:20]  # repeated rows
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(df.withColumn("seg", F.lit(1))) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}


@pytest.mark.parametrize("size", [3, 7])
def test_long_conversation_in_segments(spark, monkeypatch, size):
    """A conversation over many partitions and segments is repaired as a whole."""
    monkeypatch.setattr(cr.segments, "__defaults__", (size,))
    rnd = random.Random(size)
    rows = [(1, i // 2, rnd.choice(["system", "user", "assistant", "assistant", "user", "x"]), rnd.choice(["Yes.", "no", f"{i}.", f"{i}?", f"{i}"])) for i in range(400)]
    rows += [(2, 0, "user", "a.")] * 40 + [(3, i, "user", f"{i}.") for i in range(60)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_tables_read_by_block_as_by_turn():
    one, four, rnd = cr.BlockTables(1), cr.tables(), random.Random(2)
    for n in range(200):
        s = bytes(rnd.choices(range(cr.N_SYMBOLS), k=rnd.randint(0, 30)))
        a, b = (t.read(s, t.index[t.unit[0]]) for t in (one, four))
        assert one.vectors[a[0][-1]] == four.vectors[b[0][-1]] and a[1] == b[1]


def test_repaired_rows(spark):
    """The operator's own result: turns in order, of alternating roles."""
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "tool", "More."), (1, 2, "user", "End."), (1, 3, "user", "cut")], SCHEMA)
    _, found, turns = cr.repair(df.withColumn("copies", F.lit(1)))
    assert [tuple(r) for r in turns.collect()] == [(1, 0, "user", "More."), (1, 1, "assistant", "End.")]
    assert [r["audit"] for r in found.collect()] == ["DRRD"]  # before RRDD of the same cost
