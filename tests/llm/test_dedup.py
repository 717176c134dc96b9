"""SimHash, exact and line dedup against brute force."""

import hashlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cytolake.llm import exact_dedup, line_dedup, simhash

from odd_rows import ODD, SMALL

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, n=3):
    words = (text or "").translate(AZ).encode().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) > n else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(want)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(want[a] ^ want[b]).count("1") <= 2]
    component = plain_components(links, ids)
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: r.fingerprint % 2**64 for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == component
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(set(component.values()))


def test_all_fingerprints_within_the_radius_meet(spark):
    base = 0x8000_0000_0000_0001
    near = [base, base ^ 1, base ^ 2, base ^ 3, base ^ (1 << 63), base ^ 0xF0, base ^ 0x70]
    signed = [v - 2**64 if v >> 63 else v for v in near]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.components(rows, 2).collect()}
    links = [(i, j) for i, a in enumerate(near) for j, b in enumerate(near[:i]) if bin(a ^ b).count("1") <= 2]
    want = plain_components(links, range(len(near)))
    assert {signed.index(v): c for v, c in got.items()} == want


def test_radius_must_have_a_middle():
    with pytest.raises(ValueError):
        simhash.half_ball(3)


def test_simhash_of_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(odd)
    got = simhash.simhash_groups(docs).collect()
    assert sorted((r.doc_id or 0, r.fingerprint % 2**64) for r in got) == sorted((i or 0, plain_fingerprint(t)) for i, t, _, _ in ODD)
    empty = {r.component_id for r in got if r.fingerprint == 0}
    assert empty == {3}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 2 and kept.where("doc_id = 2").count() == 0
    assert simhash.simhash_groups(spark.read.parquet(nothing)).count() == 0


def plain_copies(rows):
    by = defaultdict(list)
    for i, text in rows:
        by[(text or "").translate(AZ)].append(i)
    out = []
    for i, text in rows:
        same = by[(text or "").translate(AZ)]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((text or "").translate(AZ).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_copies_of_odd_rows(spark, odd, nothing):
    got = exact_dedup.exact_copies(spark, odd, files_per_batch=1).drop("keep_locator").collect()
    assert sorted(map(tuple, got), key=repr) == plain_copies([(i, t) for i, t, _, _ in ODD])
    assert exact_dedup.exact_copies(spark, nothing).count() == 0


def test_full_bytes_decide_when_digests_collide(spark, odd, monkeypatch):
    """With one digest for all texts the groups are still those of the bytes."""
    same = F.lit(b"\0" * 32)
    monkeypatch.setattr(exact_dedup, "digest_column", lambda text: same)
    got = exact_dedup.exact_copies(spark, odd).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:4] for r in plain_copies([(i, t) for i, t, _, _ in ODD])), key=repr)


def test_lines_within_one_edit():
    split = lambda s: s.encode().split()
    assert line_dedup.within_one_edit(split("a b c"), split("a x c"))
    assert line_dedup.within_one_edit(split("a b c"), split("a c"))
    assert line_dedup.within_one_edit(split("a b"), split("a b c"))
    assert not line_dedup.within_one_edit(split("a b c"), split("b c a"))
    assert not line_dedup.within_one_edit(split("a b c d"), split("a b"))


def plain_lines(rows, min_words):
    """Earliest equal or near line of every line, by comparing all with all."""
    places = [
        ((i is not None, i or 0), n, line.translate(AZ).encode().split())
        for i, text in rows for n, line in enumerate((text or "").split("\n"))
    ]
    places = sorted((p for p in places if p[2]), key=lambda p: p[:2])
    return {
        p[:2]: not any(
            w == p[2] or (min(len(w), len(p[2])) >= min_words and line_dedup.within_one_edit(w, p[2])) for *_, w in places[:k]
        )
        for k, p in enumerate(places)
    }


def test_line_decisions_equal_comparing_all_with_all(spark, tmp_path):
    import random

    dice = random.Random(5)
    base = [[dice.choice("abcdefgh") for _ in range(dice.randint(1, 9))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            words = list(dice.choice(base))
            for _ in range(dice.randint(0, 2)):
                k = dice.randrange(len(words) + 1)
                words[k : k + dice.randint(0, 1)] = [dice.choice("abcXYZ")] * dice.randint(0, 1)
            lines.append(dice.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(lines)))
    path = str(tmp_path / "lines")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = line_dedup.line_decisions(spark.read.parquet(path), min_words=4).collect()
    want = plain_lines(rows, 4)
    assert {((True, r.doc_id), r.line_no): r.kept for r in got} == want
    assert not all(want.values()) and any(want.values())


def test_lines_of_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(odd)
    got = line_dedup.line_decisions(docs).collect()
    assert len(got) == sum(bool(x.split()) for _, t, _, _ in ODD for x in (t or "").encode().split(b"\n"))
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in left.collect())
    # 2 repeats 1; 7 is within an edit of 6; equal rows are one document; null and white texts stay
    assert ids == [0, 0, 1, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11]
    assert line_dedup.drop_lines(spark.read.parquet(nothing)).count() == 0


def test_dropping_lines_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [(1, "head\n\nbody one"), (2, "HEAD\nbody two\n\n tail "), (3, "head"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = line_dedup.drop_lines(spark.read.parquet(path)).collect()
    assert {r.doc_id: r.text for r in got} == {1: "head\n\nbody one", 2: "body two\n\n tail ", 4: None}
