"""Conversation repair against a plain recursion, exhaustive search and long conversations in many segments."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from odd_rows import SMALL
from pyspark.sql import functions as F

from cytolake.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        dealt = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if dealt == 0:
            continue
        text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
        out += [(conv, turn, "user" if dealt == 4 else role, text)] * (2 if dealt == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """What the operator has to find for ``(turn, role, text)`` rows in order."""
    faults = faults_of(rows)

    @lru_cache(None)
    def best(i, state, inserted=0):
        """(cost, audit, lines) from row i on, after a role with initial ``state``."""
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 4:
            role = NEXT[state]
            c, a, t = best(i, role[0], inserted + 1)
            found.append((c + 3, "I" + a, (f"{role}:", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state)
            found.append((c + 4, "D" + a, t))
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                for edit, new, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if new[:1] and (state + new[0] in LEGAL or state == "" and new[0] in "su"):
                        c, a, t = best(i + 1, new[0])
                        found.append((c + cost + more, edit + a, (f"{new}:{text}", *t)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode() + b"\0" + r[2].encode())) for c, own in of.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_plain_version_equals_exhaustive_search():
    dice = random.Random(1)
    for _ in range(60):
        rows = [(k, dice.choice(["system", "user", "assistant", "tool"]), dice.choice(["a.", "b", "", "c!"])) for k in range(dice.randrange(4))]
        faults, found = faults_of(rows), []
        for n in range(len(rows) + 5):
            for audit in product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != len(rows) or audit.count("I") > 4:
                    continue
                i, cost, roles, right = 0, 0, "", True
                for e in audit:
                    role = rows[i][1][0] if e == "K" else NEXT.get(roles[-1:] if roles[-1:] in NEXT else "", "user")[0]
                    if e == "I":
                        cost, roles = cost + 3, roles + role
                        continue
                    right &= e == "D" or faults[i] in ("", "truncated")
                    cost += {"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and faults[i] == "truncated" else 0)
                    roles += "" if e == "D" else role
                    i += 1
                if right and re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, "".join(audit)))
        assert plain(rows)[5:7] == min(found)


def _table(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")


def test_query_equals_plain(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(500, None, "user", None), (500, 3, None, "x."), (None, 1, "user", "no conversation."), (501, None, None, None), (-5, 9, "", ".")]
    rows += [(600 + k, t, "user" if t % 2 == 0 else "assistant", dice) for k in range(40) for t, dice in enumerate(["hello.", "yes!", "well", "done?", " \n", "hello."])]
    _table(spark, rows, tmp_path)
    want = {c: plain(own) for c, own in in_order(damage(rows)).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {c: want.get(c, none) for c in {r[0] for r in rows}}
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("block_rows", [8, 25])
def test_long_conversations_in_segments(spark, block_rows):
    """Segments of any length find the audit of the whole, also where the right edits hang on rows far away."""
    dice, rows = random.Random(block_rows), []
    for conv in range(12):
        roles = ["system", "user", "assistant", "tool"]
        for t in range(dice.choice([1, 5, 60, 120])):
            role = roles[(t + conv) % 2 + 1] if dice.random() < 0.6 else dice.choice(roles)
            rows.append((conv, t, role, dice.choice(["a", "", f"{t}.", f"{t}!", f"{t}?", f"{t}"])))
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {c: plain(own) for c, own in in_order(rows).items()}
    every = table.select(F.col("conv_id").alias("conv")).distinct()
    found = repair.repair(table, block_rows=block_rows)
    got = {r.conv: tuple(r[c] for c in COLUMNS) for r in repair.digests(found, every).collect()}
    assert got == want


def test_costs_differ_by_constants_after_few_rows():
    """A wrong guess is forgotten: the costs before a segment hang on those behind it only for a short way."""
    search, dice = repair.Backward(), random.Random(2)
    for _ in range(200):
        codes = [dice.randrange(16) for _ in range(300)]
        tails = [repair.END, (0, 0, 0, 0), (9, 0, 9, 9)]
        heads = {search.head(codes, t)[0] for t in map(repair._relaxed, tails)}
        assert len(heads) == 1
        head, base = search.head(codes, repair.END)
        new = repair._relaxed((4, 1, 0, 2))
        assert search.again(codes, repair.END, new, head, base) == search.head(codes, new)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "user", "Hello.")], SCHEMA)
    for c in ("conv", "row", "block", "code", "edit", "first", "task"):
        rows = rows.withColumn(c, F.lit("x"))
    got = repair.repair(rows).orderBy("row", "number").collect()
    assert [(r.edit, r.fault, r.role, r.text) for r in got] == [("K", "", "user", "Hello."), ("D", "duplicate", "user", "Hello."), ("I", None, "assistant", "")]


def test_segments_of_long_conversations_stay_in_few_tasks(spark):
    """Rounds of mending do not add tasks: before, each had one or two for every partition of a shuffle, however few the segments."""
    rows = [(conv, t, "user" if t % 2 else "assistant", f"{t}.") for conv, n in ((1, 120), (2, 120), (3, 90), (4, 5)) for t in range(n)]
    put = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        turns = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "conv")
        whole, parts, many = repair.stitched(repair._placed(turns, 8))
        found = repair.traced(parts, many)
        assert many == parts.count() == found.count() > 30
        assert max(parts.rdd.getNumPartitions(), found.rdd.getNumPartitions()) <= max(spark.sparkContext.defaultParallelism, many // 64 + 1)
        edits = whole.unionByName(found).groupBy("conv").agg(F.sum(F.size("steps")).alias("n"))
        assert {r.conv: r.n for r in edits.collect()} == {c: len(plain(own)[6]) for c, own in in_order(rows).items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
