"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

A legal order is one system turn or none, then pairs of user and assistant; or nothing. Wu and Manber's cost layers find the
edits: for each cost, from 0 on, a bitset a turn of the grammar states from which the rest can be repaired at that cost.
The first layer that holds the start state gives the cost, and the bits of the layers below are followed to the audit that
comes first in the alphabet. The layers of a long conversation are worked out in blocks: a block's layers for every state it
may end in give its costs from state to state, and costs of blocks add up along the conversation, in tasks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, written

# White space, and the marks that end a complete turn.
WHITE, MARKS = " \t\n\x0b\x0c\r", ".!?"
# Costs of edits; keeping is free, and an incomplete turn that stays costs one more.
REROLE, DELETE, INSERT = 2, 3, 2
ROLES = ("system", "user", "assistant")
#: Turns whose layers are worked out together.
BLOCK = 16

#: States: nothing yet, after a system turn, after a user's, after an assistant's. A bit for each, in four groups of four: the
#: group is the state that the block ends in. What must come next, and the state after it:
NEXT = (2, 2, 3, 2)
START, ACCEPTED = 0, (0, 3)
#: The cost of finishing from each state by insertions, after the last turn.
FINISH = (0, 2 * INSERT, INSERT, 0)
#: The state after keeping a turn of role s, u, a or another one in each state; None where that isn't legal.
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))


def _sources(after: tuple) -> list[int]:
    """For every bitset of 16 bits, the states that lead into it."""
    return [sum(1 << 4 * g + q for g in range(4) for q, to in enumerate(after) if to is not None and bits >> 4 * g + to & 1) for bits in range(1 << 16)]


@lru_cache(1)
def tables() -> tuple[list[int], list[list[int]]]:
    """Sources by insertion (or a new role), and by keeping a turn of each role."""
    return _sources(NEXT), [_sources(k) for k in KEPT]


def layers(turns: bytes, ends: dict[int, int], stop: Callable[[int, int], bool]) -> list[list[int]]:
    """out[k][i]: the states from which turns i.. of a block can be brought to ends at cost k. A turn is its role (0 to 3)
    plus 4 if it is incomplete, or 8 if it must go. stop sees each layer's number and its bits before the first turn."""
    free, kept = tables()
    n, out = len(turns), []
    none = [0] * (n + 1)
    at = lambda k: out[k] if k >= 0 else none
    while True:
        k, own = len(out), [0] * (n + 1)
        own[n] = ends.get(k, 0)
        less = [own, at(k - 1), at(k - INSERT), at(k - DELETE), at(k - REROLE - 1)]
        for i in range(n - 1, -1, -1):
            fault, role = turns[i] >> 2, turns[i] & 3
            bits = less[3][i + 1] | free[less[2][i]]
            if fault < 2:
                bits |= kept[role][less[fault][i + 1]] | free[less[4 if fault else 2][i + 1]]
            own[i] = bits
        out.append(own)
        if stop(k, own[0]):
            return out


def crossing(turns: bytes) -> list[list[int]]:
    """The least cost of a block from each state to each."""
    cost = [[1 << 60] * 4 for _ in range(4)]
    most = DELETE * len(turns) + 2 * INSERT

    def stop(k: int, bits: int) -> bool:
        for q in range(4):
            for x in range(4):
                if bits >> 4 * x + q & 1:
                    cost[q][x] = min(cost[q][x], k)
        return k >= most

    layers(turns, {0: sum(1 << 5 * x for x in range(4))}, stop)
    return cost


def before(cost: list[list[int]], after: Iterable[int]) -> list[int]:
    """The costs of finishing from each state before a block, by those after it."""
    after = list(after)
    return [min(c + v for c, v in zip(row, after, strict=True)) for row in cost]


def trace(turns: bytes, state: int, after: list[int]) -> tuple[str, int]:
    """The edits of a block that come first among the cheapest, and the state after it."""
    low = min(after)
    ends: dict[int, int] = {}
    for x, v in enumerate(after):
        ends[v - low] = ends.get(v - low, 0) | 1 << x
    found = layers(turns, ends, lambda _, bits: bits >> state & 1 == 1)
    holds = lambda k, i, q: k >= 0 and found[k][i] >> q & 1
    out, i, k = [], 0, len(found) - 1
    while i < len(turns):
        fault, role = turns[i] >> 2, turns[i] & 3
        if holds(k - DELETE, i + 1, state):
            out.append("D")
            k, i = k - DELETE, i + 1
        elif holds(k - INSERT, i, NEXT[state]):
            out.append("I")
            k, state = k - INSERT, NEXT[state]
        elif fault < 2 and (to := KEPT[role][state]) is not None and holds(k - fault, i + 1, to):
            out.append("K")
            k, i, state = k - fault, i + 1, to
        else:
            out.append("R")
            k, i, state = k - REROLE - fault, i + 1, NEXT[state]
    return "".join(out), state


def blocks(turns: bytes) -> list[bytes]:
    return [turns[i : i + BLOCK] for i in range(0, len(turns), BLOCK)]


def costs_along(parts: list[bytes], after: list[int]) -> list[list[int]]:
    """The costs of finishing after each block, and, first, before them all."""
    out = [after]
    for part in reversed(parts):
        out.append(before(crossing(part), out[-1]))
    return out[::-1]


def follow(parts: list[bytes], state: int, costs: list[list[int]]) -> tuple[str, int]:
    """The edits of blocks one after the other; costs: those of finishing after each."""
    out = []
    for part, after in zip(parts, costs, strict=True):
        edits, state = trace(part, state, after)
        out.append(edits)
    return "".join(out), state


def finished(edits: str, state: int) -> str:
    return edits + "I" * (FINISH[state] // INSERT)


@lru_cache(200_000)
def repaired(turns: bytes) -> tuple[int, str]:
    """The cost and the audit of a whole conversation."""
    parts = blocks(turns)
    if len(parts) > 1:
        costs = costs_along(parts, list(FINISH))
        return costs[0][START], finished(*follow(parts, START, costs[1:]))
    ends: dict[int, int] = {}
    for q, v in enumerate(FINISH):
        ends[v] = ends.get(v, 0) | 1 << q
    cost = len(layers(turns, ends, lambda _, bits: bits & 1 == 1)) - 1
    return cost, finished(*trace(turns, START, list(FINISH)))


# Rows.


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows as a checksum of their key damages them; n copies stand side by side."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    role, n = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def by_place() -> list[Column]:
    """The order of rows in a conversation; what shares a turn is ordered by role and by the digest of its text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, first, blank, cut): equal rows as one, with their number; first: whether role and text
    are seen here for the first time."""
    seen = F.rtrim("text", F.lit(WHITE))
    slim = identified(rows).select("conv_id", "turn", "role", "digest", "n", (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(*MARKS)).alias("cut"))
    key = ["conv_id", "turn", "role", "digest"]
    own = slim.groupBy(*key).agg(F.sum("n").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min(place)["turn"].alias("turn")).withColumns({"n": F.lit(0).cast("long"), "first": F.lit(True)})
    # The two meet in an aggregate, which combines before it shuffles, rather than in a join on a key that may be hot.
    both = own.unionByName(first, allowMissingColumns=True)
    return both.groupBy(*key).agg(F.sum("n").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut"), F.coalesce(F.bool_or("first"), F.lit(False)).alias("first"))


def facts(turns: DataFrame) -> DataFrame:
    """Of each conversation: numbers that are missing between its turns, and of rows with each fault."""
    count = lambda cond, n: F.sum(F.when(cond, n).otherwise(0))
    once = F.col("first").cast("long")
    by_turn = turns.groupBy("conv_id", "turn").agg(
        count(F.col("blank"), F.col("n")).alias("blank"), count(~F.col("blank"), F.col("n") - once).alias("duplicate"), count(~F.col("blank") & F.col("cut"), once).alias("truncated")
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


_ROLE = {"s": 0, "u": 1, "a": 2}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def symbols(role: str, n: int, first: bool, blank: bool, cut: bool) -> bytes:
    own = _ROLE.get(role[:1], 3)
    later = bytes([own + 8])
    return later * n if blank or not first else bytes([own + 4 * cut]) + later * (n - 1)


def illegal_in(turns: bytes) -> int:
    return sum((a & 3, b & 3) not in _LEGAL for a, b in zip(turns, turns[1:], strict=False))


def planned(turns: DataFrame) -> DataFrame:
    """(conv_id, cost, illegal, audit). Rows are ordered by range, so that a long conversation spreads over tasks: what lies
    whole within one is repaired there; of the others, two a task at most, the parts pass on their costs from state to state.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), *by_place()]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def runs(batches: Iterator[dict[str, list]]) -> Iterator[tuple]:
        held, parts, some = None, [], False
        for b in batches:
            for conv, *row in zip(*(b[c] for c in ("conv_id", "role", "n", "first", "blank", "cut")), strict=True):
                if not some or conv != held:
                    if some:
                        yield held, b"".join(parts)
                    held, parts, some = conv, [], True
                parts.append(symbols(*row))
        if some:
            yield held, b"".join(parts)

    def make(batches):
        from pyspark import TaskContext

        task, out = TaskContext.get().partitionId(), {c: [] for c in ("conv_id", "part", "turns", "cross", "cost", "illegal", "audit")}
        late: list[tuple] = []
        for number, (conv, run) in enumerate(runs(batches)):
            late.append((conv, run))
            if number > 1:
                # Neither the first nor, as another follows, the last of the task.
                conv, run = late.pop(1)
                cost, audit = repaired(run)
                for c, v in zip(out, (conv, None, None, None, cost, illegal_in(run), audit), strict=True):
                    out[c].append(v)
            if len(out["conv_id"]) >= 1024:
                yield out
                out = {c: [] for c in out}
        for conv, run in late:
            total = [[0 if q == x else 1 << 60 for x in range(4)] for q in range(4)]
            for part in blocks(run):
                step = crossing(part)
                total = [[min(min(row[y] + step[y][x] for y in range(4)), 1 << 60) for x in range(4)] for row in total]
            for c, v in zip(out, (conv, task, run, [c for row in total for c in row], None, illegal_in(run), None), strict=True):
                out[c].append(v)
        yield out

    found = written(map_columns(placed, f"conv_id {kind}, part int, turns binary, cross array<long>, cost long, illegal long, audit string", make), "repair-parts")
    whole = found.where("part IS NULL").select("conv_id", "cost", "illegal", "audit")
    return whole.unionByName(across(found.where("part IS NOT NULL").select("conv_id", "part", "turns", "cross", "illegal"), kind))


def across(parts: DataFrame, kind: str) -> DataFrame:
    """The same of conversations in parts. A conversation's parts are few, one a task, and small but for their turns, which
    stay where they are: costs go backwards over the parts, then every part is traced from each state, then states go on."""

    def chains(batches):
        for b in batches:
            out: dict[str, list] = {"conv_id": [], "part": [], "after": [], "cost": [], "illegal": []}
            for conv, found in zip(b["conv_id"], b["found"], strict=True):
                after, own = list(FINISH), []
                for p in reversed(found):
                    own.append((p["part"], after))
                    after = before([p["cross"][4 * q : 4 * q + 4] for q in range(4)], after)
                ends = [(p["first"] & 3, p["last"] & 3) for p in found]
                illegal = sum(p["illegal"] for p in found) + sum((x[1], y[0]) not in _LEGAL for x, y in zip(ends, ends[1:], strict=False))
                for part, v in own:
                    for c, x in zip(out, (conv, part, v, after[START], illegal), strict=True):
                        out[c].append(x)
            yield out

    def traced(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("conv_id", "part", "cost", "illegal", "edits", "to")}
            for conv, part, turns, after, cost, illegal in zip(*(b[c] for c in ("conv_id", "part", "turns", "after", "cost", "illegal")), strict=True):
                own = blocks(turns)
                costs = costs_along(own, after)[1:]
                ways = [follow(own, q, costs) for q in range(4)]
                for c, x in zip(out, (conv, part, cost, illegal, [e for e, _ in ways], [q for _, q in ways]), strict=True):
                    out[c].append(x)
            yield out

    def chosen(batches):
        for b in batches:
            out: dict[str, list] = {"conv_id": [], "cost": [], "illegal": [], "audit": []}
            for conv, cost, illegal, found in zip(b["conv_id"], b["cost"], b["illegal"], b["found"], strict=True):
                state, edits = START, []
                for p in found:
                    edits.append(p["edits"][state])
                    state = p["to"][state]
                for c, x in zip(out, (conv, cost, illegal, finished("".join(edits), state)), strict=True):
                    out[c].append(x)
            yield out

    ends = [F.conv(F.hex(F.substring("turns", at, 1)), 16, 10).cast("int").alias(c) for at, c in ((1, "first"), (-1, "last"))]
    slim = parts.select("conv_id", F.struct("part", "cross", "illegal", *ends).alias("p"))
    lists = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("found"))
    after = map_columns(lists, f"conv_id {kind}, part int, after array<long>, cost long, illegal long", chains)
    same = (F.col("x.part") == F.col("y.part")) & F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))
    both = parts.alias("x").join(after.alias("y"), same).select("x.conv_id", "x.part", "turns", "after", "cost", "y.illegal")
    ways = map_columns(both, f"conv_id {kind}, part int, cost long, illegal long, edits array<string>, to array<int>", traced)
    lists = ways.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"), F.array_sort(F.collect_list(F.struct("part", "edits", "to"))).alias("found"))
    return map_columns(lists, f"conv_id {kind}, cost long, illegal long, audit string", chosen)


def edited(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, kind, audit, turn, role, text, n, digest), each conversation's plan before its rows, in one task and in order."""
    heads = plans.select("conv_id", F.lit(0).alias("kind"), "audit")
    both = heads.unionByName(identified(rows).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *by_place())


def applied(batches: Iterator[dict[str, list]]) -> Iterator[tuple]:
    """(conv_id, role, text) of every repaired turn, in order; a null role begins a conversation."""
    audit, at, state, held = "", 0, START, None

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield held, ROLES[state - 1], ""

    for b in batches:
        for conv, kind, plan, role, text, n in zip(*(b[c] for c in ("conv_id", "kind", "audit", "role", "text", "n")), strict=True):
            if kind == 0:
                yield from inserted()
                audit, at, state, held = plan, 0, START, conv
                yield held, None, None
                continue
            for _ in range(n):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEPT[_ROLE[role[:1]]][state]
                    yield held, role, text
                elif edit == "R":
                    state = NEXT[state]
                    yield held, ROLES[state - 1], text
    yield from inserted()


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, turn (from 0), role, text."""
    bound_batches(conversations.sparkSession)
    rows = damaged(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def make(batches):
        out, at = {c: [] for c in ("conv_id", "turn", "role", "text")}, 0
        for conv, role, text in applied(batches):
            if role is None:
                at = 0
                continue
            for c, x in zip(out, (conv, at, role, text), strict=True):
                out[c].append(x)
            at += 1
            if len(out["turn"]) >= 256:
                yield out
                out = {c: [] for c in out}
        yield out

    return map_columns(edited(rows, planned(written(turns_of(rows), "repair-turns"))), f"conv_id {kind}, turn long, role string, text string", make)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Of every conv_id: gaps, faults, cost and audit of the repair, and the digest of the repaired conversation.

    Null roles and texts are one space (a blank text; a role that must change or go); a null conv_id is a conversation of its
    own; rows without a turn come first; rows of one turn are ordered by role and by the digest of their text; of rows alike
    in role and text all but the first are duplicates, repeated rows too; a conversation of which nothing is left has zeros
    and empty results; an empty table gives an empty one; other columns are left out. Work on a conversation spreads over
    tasks, except that its digest, a chain over all its bytes, is taken by one task as the rows stream by; memory holds the
    audit, a letter an edit.
    """
    bound_batches(conversations.sparkSession)
    rows = damaged(conversations)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = written(turns_of(rows), "repair-turns")
    plans = written(planned(turns), "repair-plans")

    def digests(batches):
        out: dict[str, list] = {"conv_id": [], "repaired_sha256": []}
        own, some = None, False
        for conv, role, text in applied(batches):
            if role is None:
                if own is not None:
                    out["repaired_sha256"].append(own.hexdigest())
                if len(out["conv_id"]) >= 1024:
                    yield out
                    out = {"conv_id": [], "repaired_sha256": []}
                out["conv_id"].append(conv)
                own, some = hashlib.sha256(), False
            else:
                own.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
        if own is not None:
            out["repaired_sha256"].append(own.hexdigest())
            yield out

    hashed = map_columns(edited(rows, plans), f"conv_id {kind}, repaired_sha256 string", digests)
    out = conversations.select("conv_id").distinct()
    for more in (facts(turns), plans, hashed):
        more = more.withColumnRenamed("conv_id", "_id")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
