"""Repair of damaged conversations at the least cost, by block tables.

A conversation's turns, in the order of ``turn`` (nulls first; turns that share
a number by role, then by the text's hash), are edited until their roles read
``(s?(ua)+)?``: a turn is kept, given the role user or assistant, or deleted, and
empty turns are inserted. What a prefix of the turns may cost is a vector over
the four states of that pattern (nothing yet, after system, after user, after
assistant). The vector's differences are bounded, so it is one of some hundred
*normalised* vectors (least entry 0; entries that can't be on a cheapest path
are infinite) and a number.

The Four-Russians tables hold, for every block of ``BLOCK`` turns (a turn is one
of nine symbols) and every normalised vector, the vector after the block and
what it adds. A conversation is read by look-ups, a block at a time. The trace
goes from the last block to the first: each is expanded into its turns again,
and the states that lie on any cheapest path are marked; then, from the front,
the first edit in ASCII order along marked states is taken. So of all cheapest
edit sequences the least one is found, not any.

On the cluster: turns are reduced to keys (conversation, turn, role, hash of the
text), dealt by range over all of these and the input partition, so that a
conversation of any size, or many equal turns, lies in many tasks. A task writes
segments of up to ``SEGMENT`` turns with what they do to each state's vector; a
conversation's segments (a row of about 200 bytes each) are put together in one
task; then each segment is traced on its own. Texts are moved once, to
their conversation, and the repaired turns are written in their order there.

Edge cases: null roles and texts are one space, null numbers too where they are
hashed; the null conv_id is a conversation; roles that don't begin with s, u or a
(the empty one too) can't be kept; conversations without turns give zeros and
empty results. Repeated rows are duplicates of each other. Further columns are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialize

#: What the edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 4
#: Turns of a segment.
SEGMENT = 4096
STATES = 4
#: By state: the state that an inserted or re-roled turn leads to, and its role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)
#: Symbols: 0 must go; else 1 + 2 * kind + truncated, kinds by the role's initial.
KINDS = "sua"
N_SYMBOLS = 1 + 2 * (len(KINDS) + 1)
INF = 1 << 40


def symbol(role: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return 0
    kind = KINDS.find(role[:1]) if role else -1
    return 1 + 2 * (kind if kind >= 0 else len(KINDS)) + truncated


def kept_to(kind: int, state: int) -> int:
    """The state after a turn of this kind is kept, or -1."""
    if kind == 0:
        return 1 if state == 0 else -1
    return NEXT[state] if kind in (1, 2) and NEXT[state] == kind + 1 else -1


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what may be done with a turn."""
    out = [("D", DELETE, state)]
    if sym:
        kind, truncated = divmod(sym - 1, 2)
        to = kept_to(kind, state)
        if to >= 0:
            out.append(("K", TRUNCATED * truncated, to))
        out.append(("R", REROLE + TRUNCATED * truncated, NEXT[state]))
    return out


def normalised(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """The vector after free insertions, less its least entry, and that entry.
    An entry is infinite if going on from state 3 is cheaper whatever follows."""
    c = list(costs)
    c[2] = min(c[2], min(c[0], c[1], c[3]) + INSERT)
    c[3] = min(c[3], c[2] + INSERT)
    if c[0] > c[3] + DELETE:  # all that state 0 has beyond 3 is to keep a system turn
        c[0] = INF
    if c[1] > c[3]:
        c[1] = INF
    least = min(c)
    return tuple(x - least if x < INF else INF for x in c), least


class BlockTables:
    """Transitions of normalised vectors for each symbol and each block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.unit = [normalised([0 if s == t else INF for t in range(STATES)])[0] for s in range(STATES)]
        self.vectors = list(dict.fromkeys(self.unit))
        self.index = {v: i for i, v in enumerate(self.vectors)}
        after: list[list[int]] = [[] for _ in range(N_SYMBOLS)]
        added: list[list[int]] = [[] for _ in range(N_SYMBOLS)]
        for v in self.vectors:  # grows as new vectors are met
            for sym in range(N_SYMBOLS):
                c = [INF] * STATES
                for s in range(STATES):
                    if v[s] < INF:
                        for _, cost, to in edits(sym, s):
                            c[to] = min(c[to], v[s] + cost)
                new, least = normalised(c)
                if new not in self.index:
                    self.index[new] = len(self.vectors)
                    self.vectors.append(new)
                after[sym].append(self.index[new])
                added[sym].append(least)
        self.after, self.added = after, added
        self.n = len(self.vectors)
        nxt, add = one, plus = np.array(after), np.array(added)
        for _ in range(block - 1):
            add = (add[:, None, :] + plus[np.arange(N_SYMBOLS)[None, :, None], nxt[:, None, :]]).reshape(-1, self.n)
            nxt = one[np.arange(N_SYMBOLS)[None, :, None], nxt[:, None, :]].reshape(-1, self.n)
        self.block_after, self.block_added = nxt.ravel().tolist(), add.ravel().tolist()
        self.places = N_SYMBOLS ** np.arange(block)[::-1]

    def blocks(self, symbols: bytes) -> list[int]:
        s = np.frombuffer(symbols, np.uint8).astype(np.int64)
        whole = len(s) - len(s) % self.block
        return (s[:whole].reshape(-1, self.block) @ self.places).tolist()

    def read(self, symbols: bytes, start: int) -> tuple[list[int], int]:
        """(vector at each block's begin and at the end of the blocks, cost added
        by all symbols): one look-up a block."""
        at, n, cost, v = [start], self.n, 0, start
        after, added = self.block_after, self.block_added
        for b in self.blocks(symbols):
            i = b * n + v
            cost += added[i]
            v = after[i]
            at.append(v)
        for sym in symbols[(len(at) - 1) * self.block:]:
            cost += self.added[sym][v]
            v = self.after[sym][v]
        return at + [v], cost

    @cache
    def marked(self, sym: int, v: int, mask: int) -> int:
        """The states before a turn that lie on a cheapest path, from those after."""
        old, new, add = self.vectors[v], self.vectors[self.after[sym][v]], self.added[sym][v]
        out = 0
        for s in range(STATES):
            if old[s] < INF and any(mask >> to & 1 and old[s] + cost == new[to] + add for _, cost, to in edits(sym, s)):
                out |= 1 << s
        return self.reached(v, out)

    @cache
    def reached(self, v: int, mask: int) -> int:
        """Add the states from which a cheapest insertion leads to a marked one."""
        old = self.vectors[v]
        for _ in range(2):
            for s in range(STATES):
                if old[s] < INF and mask >> NEXT[s] & 1 and old[s] + INSERT == old[NEXT[s]]:
                    mask |= 1 << s
        return mask

    @cache
    def step(self, sym: int, v: int, state: int, here: int, mask: int) -> tuple[str, int]:
        """(letters, state) of the first edits in ASCII order along marked states."""
        old, new, add = self.vectors[v], self.vectors[self.after[sym][v]], self.added[sym][v]
        found = {x: to for x, cost, to in edits(sym, state) if mask >> to & 1 and old[state] + cost == new[to] + add}
        to = NEXT[state]
        if here >> to & 1 and old[state] + INSERT == old[to]:
            found["I"] = to
        first = min(found)
        if first != "I":
            return first, found[first]
        rest, end = self.step(sym, v, to, here, mask)
        return "I" + rest, end

    def trace(self, symbols: bytes, start: int, mask: int, entries: list[int], last: bool) -> list[tuple[list[str], str, int]]:
        """For each entry state: (letters of each turn, letters behind the
        last one, exit state), given the states marked at the end."""
        at, _ = self.read(symbols, start)
        v_at, marks = [0] * len(symbols), [0] * len(symbols) + [self.reached(at[-1], mask)]
        for k in range(len(at) - 2, -1, -1):  # the last blocks first; what follows the blocks counts as one
            v, inner = at[k], symbols[k * self.block:(k + 1) * self.block]
            for i, sym in enumerate(inner, k * self.block):
                v_at[i] = v
                v = self.after[sym][v]
            for i in range(k * self.block + len(inner) - 1, k * self.block - 1, -1):
                marks[i] = self.marked(symbols[i], v_at[i], marks[i + 1])
        out = []
        for state in entries:
            letters, step = [], self.step
            for i, sym in enumerate(symbols):
                x, state = step(sym, v_at[i], state, marks[i], marks[i + 1])
                letters.append(x)
            tail = ""
            while last and state not in ACCEPTED:
                tail += "I"
                state = NEXT[state]
            out.append((letters, tail, state))
        return out


@cache
def tables() -> BlockTables:
    return BlockTables()


# ------------------------------------------------------------------ the turns
def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by the hash of the
    turn's key: dropped, emptied, without sentence marks, twice, or of role user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def keys(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, src, n, blank, cut, again): the turns without
    their text, equal ones of an input partition in one row; ``again``: role
    and text are met earlier."""
    seen = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    narrow = turns.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), F.spark_partition_id().alias("src"), "copies",
                          (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"))
    narrow = materialize(narrow.groupBy("conv_id", "turn", "role", "h", "src", "blank", "cut").agg(F.sum("copies").alias("n")), "turn-keys")
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(
        F.min(F.struct("turn", "src")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    return narrow.join(first, same).select("conv_id", "turn", "role", "h", "src", "n", "blank", "cut",
                                           (~F.struct("turn", "src").eqNullSafe(F.col("first"))).alias("again"))


def segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Segments of conversations in order (``seg`` ascends within one): symbols,
    the turns' keys, counts, and for each state the vector and cost after all."""
    ids, number = turns.schema["conv_id"], turns.schema["turn"].dataType
    row = T.StructType([T.StructField("turn", number), T.StructField("role", T.StringType()), T.StructField("h", T.BinaryType()),
                        T.StructField("n", T.IntegerType())])
    long = T.LongType()
    schema = T.StructType([ids, T.StructField("seg", long), T.StructField("symbols", T.BinaryType()), T.StructField("turns", T.ArrayType(row)),
                           T.StructField("vectors", T.ArrayType(T.IntegerType())), T.StructField("costs", T.ArrayType(long)),
                           *(T.StructField(c, long) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")),
                           *(T.StructField(c, number) for c in ("low", "high")), *(T.StructField(c, T.StringType()) for c in ("begins", "ends"))])

    def run(it):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, tab, part = to_arrow_schema(schema), tables(), TaskContext.get().partitionId()

        def closed(conv, k, held, symbols, counts):
            vectors, costs = [], []
            for s in range(STATES):
                at, cost = tab.read(bytes(symbols), tab.index[tab.unit[s]])
                vectors.append(at[-1])
                costs.append(cost)
            numbers = [r["turn"] for r in held if r["turn"] is not None]
            illegal = counts[3] + sum(a["role"][:1] + b["role"][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
            return (conv, part << 32 | k, bytes(symbols), held, vectors, costs, *counts[:3], illegal, len(set(numbers)),
                    min(numbers, default=None), max(numbers, default=None), held[0]["role"][:1], held[-1]["role"][:1])

        def rows():
            k, conv, held, symbols, counts = 0, None, [], bytearray(), [0] * 4
            for b in it:
                for r in b.to_pylist():
                    if held and (r["conv_id"] != conv or len(symbols) >= size):
                        yield closed(conv, k, held, symbols, counts)
                        k, held, symbols, counts = k + 1, [], bytearray(), [0] * 4
                    conv, n, must = r["conv_id"], r["n"], r["blank"] or r["again"]
                    symbols.append(symbol(r["role"], must, r["cut"]))
                    symbols.extend(bytes(n - 1))
                    counts[0] += n if r["blank"] else 0
                    counts[1] += 0 if r["blank"] else n if r["again"] else n - 1
                    counts[2] += r["cut"] and not must
                    counts[3] += n - 1  # copies side by side have the same role
                    held.append({c: r[c] for c in ("turn", "role", "h", "n")})
            if held:
                yield closed(conv, k, held, symbols, counts)

        yield from batches(rows(), out, 512, 1 << 20)

    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h", "src"]
    return turns.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _by_conversation(table: DataFrame, fields: list, job) -> DataFrame:
    """``job(rows)`` for the rows of each conversation, ordered by ``seg``."""
    schema = T.StructType([table.schema["conv_id"], *fields])

    def run(it):
        from itertools import groupby

        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (r for b in it for r in b.to_pylist())
        made = ((conv, *x) for conv, group in groupby(rows, lambda r: r["conv_id"]) for x in job(list(group)))
        yield from batches(made, to_arrow_schema(schema))

    return table.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, schema)


def joined(segs: DataFrame) -> DataFrame:
    """(conv_id, seg, start, mask, last, entry, and with a conversation's first
    segment its totals): the vector before each segment, the states marked at its end."""
    long = T.LongType()
    totals = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def job(rows):
        tab = tables()
        starts, prefix, base = [], tab.unit[0], 0
        for r in rows:
            starts.append((prefix, base))
            costs = [min((prefix[s] + r["costs"][s] + tab.vectors[r["vectors"][s]][t] for s in range(STATES) if prefix[s] < INF), default=INF)
                     for t in range(STATES)]
            prefix, least = normalised([min(c, INF) for c in costs])
            base += least
        ends = [*starts[1:], (prefix, base)]
        to_go = [0, 2 * INSERT, INSERT, 0]
        total = min(prefix[s] + to_go[s] for s in range(STATES)) + base
        masks = [0] * len(rows)
        for k in range(len(rows) - 1, -1, -1):
            r, (end, b) = rows[k], ends[k]
            masks[k] = sum(1 << s for s in range(STATES) if end[s] < INF and end[s] + b + to_go[s] == total)
            to_go = [min(r["costs"][s] + tab.vectors[r["vectors"][s]][t] + to_go[t] for t in range(STATES)) for s in range(STATES)]
        low, high, distinct, illegal, ends_with = None, None, 0, 0, None
        for r in rows:
            illegal += r["illegal"] + (ends_with is not None and ends_with + r["begins"] not in ("su", "ua", "au"))
            distinct += r["distinct"] - (high is not None and r["low"] == high)
            low = r["low"] if low is None else low
            high, ends_with = r["high"] if r["high"] is not None else high, r["ends"]
        sums = [0 if low is None else high - low + 1 - distinct, *(sum(r[c] for r in rows) for c in totals[1:4]), illegal, total]
        for k, r in enumerate(rows):
            yield (r["seg"], tab.index[starts[k][0]], masks[k], k == len(rows) - 1, 0 if k == 0 else None, *(sums if k == 0 else [None] * len(totals)))

    fields = [T.StructField("seg", long), T.StructField("start", T.IntegerType()), T.StructField("mask", T.IntegerType()),
              T.StructField("last", T.BooleanType()), T.StructField("entry", T.IntegerType()), *(T.StructField(c, long) for c in totals)]
    return _by_conversation(segs.drop("symbols", "turns"), fields, job)


def entries(segs: DataFrame, places: DataFrame) -> DataFrame:
    """(seg, entered): the state in which each segment of a conversation of
    several is entered."""
    many = places.filter("not (last and entry is not null)").select("seg", "start", "mask", "last")
    fields = [T.StructField("seg", T.LongType()), T.StructField("exits", T.ArrayType(T.IntegerType()))]
    own = segs.select("conv_id", "seg", "symbols").join(many, "seg")

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        tab, out = tables(), to_arrow_schema(schema)

        def rows():
            for b in it:
                for r in b.to_pylist():
                    exits = [None] * STATES
                    v, mask = tab.vectors[r["start"]], _mask_before(tab, r["symbols"], r["start"], r["mask"])
                    alive = [s for s in range(STATES) if v[s] < INF and mask >> s & 1]
                    for s, (_, _, end) in zip(alive, tab.trace(r["symbols"], r["start"], r["mask"], alive, r["last"])):
                        exits[s] = end
                    yield r["conv_id"], r["seg"], exits

        yield from batches(rows(), out)

    schema = T.StructType([segs.schema["conv_id"], *fields])
    ways = own.mapInArrow(run, schema)

    def job(rows):
        state = 0
        for r in rows:
            yield r["seg"], state
            state = r["exits"][state]

    return _by_conversation(ways, [T.StructField("seg", T.LongType()), T.StructField("entered", T.IntegerType())], job).drop("conv_id")


def _mask_before(tab: BlockTables, symbols: bytes, start: int, mask: int) -> int:
    """The states marked before the first symbol."""
    at, _ = tab.read(symbols, start)
    mask = tab.reached(at[-1], mask)
    for k in range(len(at) - 2, -1, -1):
        v, inner = [at[k]], symbols[k * tab.block:(k + 1) * tab.block]
        for sym in inner:
            v.append(tab.after[sym][v[-1]])
        for sym, w in zip(reversed(inner), reversed(v[:-1])):
            mask = tab.marked(sym, w, mask)
    return mask


def audits(segs: DataFrame, places: DataFrame) -> DataFrame:
    """(conv_id, seg, audit, plan): the edits of each segment, and its kept
    turns with their new role and the roles of turns inserted before or behind."""
    number = segs.schema["turns"].dataType.elementType["turn"].dataType
    step = T.StructType([T.StructField("turn", number), T.StructField("role", T.StringType()), T.StructField("h", T.BinaryType()),
                         T.StructField("behind", T.BooleanType()), T.StructField("inserted", T.StringType()), T.StructField("new_role", T.StringType())])
    schema = T.StructType([segs.schema["conv_id"], T.StructField("seg", T.LongType()), T.StructField("audit", T.StringType()),
                           T.StructField("plan", T.ArrayType(step))])
    entered = entries(segs, places)
    own = segs.select("conv_id", "seg", "symbols", "turns").join(places.select("seg", "start", "mask", "last"), "seg").join(entered, "seg", "left")

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        tab, out = tables(), to_arrow_schema(schema)

        def rows():
            for b in it:
                for r in b.to_pylist():
                    state = r["entered"] or 0
                    (letters, tail, _), = tab.trace(r["symbols"], r["start"], r["mask"], [state], r["last"])
                    plan, inserted, i = [], [], 0
                    for t in r["turns"]:
                        for j in range(i, i + t["n"]):
                            for x in letters[j]:
                                if x == "I":
                                    inserted.append(ROLE[state])
                                    state = NEXT[state]
                                elif x != "D":
                                    role = ROLE[state] if x == "R" else t["role"]
                                    state = 1 if x == "K" and role[:1] == "s" else NEXT[state]
                                    plan.append({"turn": t["turn"], "role": t["role"], "h": t["h"], "behind": False,
                                                 "inserted": " ".join(inserted), "new_role": role})
                                    inserted = []
                        i += t["n"]
                    for _ in tail:
                        inserted.append(ROLE[state])
                        state = NEXT[state]
                    if inserted:
                        plan.append({**{c: t[c] for c in ("turn", "role", "h")}, "behind": True, "inserted": " ".join(inserted), "new_role": None})
                    yield r["conv_id"], r["seg"], "".join(letters) + tail, plan

        yield from batches(rows(), out, 512, 1 << 20)

    return own.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the repaired conversations, each in one
    partition and in order. A task reads its turns one by one."""
    plan = found.select("conv_id", F.explode("plan").alias("p")).select(
        "conv_id", "p.turn", "p.role", "p.h", F.when(F.col("p.behind"), 2).otherwise(0).alias("kind"),
        "p.inserted", "p.new_role", F.lit(None).cast("string").alias("text"))
    own = turns.filter(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")) != "").select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("inserted"), F.lit(None).cast("string").alias("new_role"), "text")
    schema = T.StructType([turns.schema["conv_id"], T.StructField("seq", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        def rows():
            conv, seq, pending, begun = None, 0, None, False
            for b in it:
                ids, kinds, inserted, roles = (b.column(i).to_pylist() for i in range(4))
                texts = b.column(4)
                for i, kind in enumerate(kinds):
                    if not begun or ids[i] != conv:
                        conv, seq, pending, begun = ids[i], 0, None, True
                    if kind != 1:
                        for role in inserted[i].split():
                            yield conv, seq, role, ""
                            seq += 1
                        pending = roles[i] if kind == 0 else pending
                    elif pending is not None:  # of equal turns the first is kept
                        yield conv, seq, pending, texts[i].as_py()
                        seq, pending = seq + 1, None

        yield from batches(rows(), to_arrow_schema(schema))

    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "h", "kind"]
    return plan.unionByName(own).repartition("conv_id").sortWithinPartitions(*by).select(
        "conv_id", "kind", "inserted", "new_role", "text").mapInArrow(run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations: conv_id, counts of faults, cost; edits: conv_id, seg,
    audit, plan; turns: the repaired ones) of (conv_id, turn, role, text, copies)."""
    segs = materialize(segments(keys(turns)), "segments")
    places = materialize(joined(segs), "segment-places")
    found = materialize(audits(segs, places), "audits")
    totals = places.filter("entry is not null").drop("seg", "start", "mask", "last", "entry")
    return totals, found, repaired_turns(turns, found)


def _hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns as ``repaired_turns`` orders them."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        def rows():
            conv, sha = None, None
            for b in it:
                ids, seqs, roles = (b.column(i).to_pylist() for i in range(3))
                for i, seq in enumerate(seqs):
                    if seq == 0:
                        if sha is not None:
                            yield conv, sha.hexdigest()
                        conv, sha = ids[i], hashlib.sha256()
                    sha.update(f"{chr(10) if seq else ''}{roles[i]}:{b.column(3)[i].as_py()}".encode())
            if sha is not None:
                yield conv, sha.hexdigest()

        yield from batches(rows(), to_arrow_schema(schema))

    return turns.mapInArrow(run, schema)


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation, damaged and then repaired."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    totals, found, turns = repair(damage(conversations))
    audit = found.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out, numbers = conversations.select("conv_id").distinct(), ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    for part in (totals, audit, _hashed(turns)):
        out = out.join(part.withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
