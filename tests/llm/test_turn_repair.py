"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from speechloom.llm import turn_repair
from speechloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit) by plain search. turns: (role's initial, fault)."""
    wanted = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, q, inserted):
        ways = [(0, "")] if i == len(turns) and q in (0, 3) else []
        if inserted < 2:
            for r in "ua":
                if r and r in wanted[q]:
                    c, a = best(i, to[q, r], inserted + 1)
                    ways.append((c + 2, "I" + a))
        if i < len(turns):
            r, fault = turns[i]
            c, a = best(i + 1, q, 0)
            ways.append((c + 3, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if r and r in wanted[q]:
                    c, a = best(i + 1, to[q, r], 0)
                    ways.append((c + more, "K" + a))
                for n in "ua":
                    if n in wanted[q]:
                        c, a = best(i + 1, to[q, n], 0)
                        ways.append((c + 2 + more, "R" + a))
        return min(ways, default=(10**9, ""))

    for i in range(len(turns), 0, -50):
        for q in range(4):
            best(i, q, 0)
    return best(0, 0, 0)


def plain(rows):
    found, out = defaultdict(list), {}
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = found[conv]
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            kept = text.rstrip(WHITE)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:], strict=False))
        cost, audit = cheapest(tuple(turns))
        lines, rest, last = [], iter(own), ""
        for e in audit:
            role, text = (None, "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_plans_of_short_and_long_conversations():
    rng = random.Random(0)
    faults = [None, None, None, "truncated", "blank"]
    for n in [*range(9), *range(14, 20), 31, 32, 33, 50] * 12:
        turns = [(rng.choice("suuaaax"), rng.choice(faults)) for _ in range(n)]
        code = bytes("suax".index(r) + 4 * {None: 0, "truncated": 1, "blank": 2}[f] for r, f in turns)
        assert turn_repair.repaired(code) == cheapest(tuple(turns))


def odd_rows(rng):
    texts = ["Hi.", "Yes!", "no end", "", " \n", "Why? ", None, "Ünd.", "a ", "Ok.\t"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, t, "user", f"x{t}.") for t in (None, 1, 4)] + [(7, None, "system", "Go."), (7, None, "user", "Go."), (500, None, "user", "Alone.")]
    rows += rows[:25]
    return rows


def test_against_plain_search(spark):
    rows = odd_rows(random.Random(1))
    df = spark.createDataFrame([(*r, 0, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, n long, digest string, part int").repartition(4)
    assert got(turn_repair.repair_report(df)) == plain(rows)


def test_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows, so that its parts lie in several tasks."""
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(900)]
    rows += [(c, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"{c} {t}.") for c in (0, 2, 3) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = turn_repair.turns_of(turn_repair.damaged(df))
        parts = turns.repartitionByRange("conv_id", *turn_repair.by_place())
        from pyspark.sql import functions as F

        assert parts.where("conv_id = 1").select(F.spark_partition_id()).distinct().count() > 2
        assert got(turn_repair.repair_report(df)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_legal(spark):
    rows = odd_rows(random.Random(3))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = defaultdict(list)
    for r in turn_repair.repaired_turns(df).orderBy("conv_id", "turn").collect():
        found[r.conv_id].append((r.turn, r.role, r.text))
    want = plain(rows)
    for conv, own in found.items():
        assert [t for t, _, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == want[conv][-1]


def test_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair_report(df).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_whole_table(spark, kind):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    if kind == "long":
        out = QUERIES["op13_turn_repair"](spark, SF)
    else:
        out = turn_repair.repair_report(df.withColumn("conv_id", df.conv_id.cast("string")))
    rows = [(r.conv_id if kind == "long" else str(r.conv_id), r.turn, r.role, r.text) for r in df.collect()]
    assert got(out) == plain(rows)


def test_sql_against_plain_search():
    import duckdb

    from speechloom.llm.queries import ORACLES

    rows = odd_rows(random.Random(9))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op13_turn_repair"]).fetchall()}
    assert got == plain(rows)
