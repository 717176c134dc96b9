"""Quality, mixing, chat windows and embedding links against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD, SMALL
from pyspark.sql import functions as F

from cytolake.llm import chat, embedding_join, mixing, quality


# --- quality ---------------------------------------------------------------------------------


def test_scores_equal_the_log_densities():
    """The cached factors give the same posterior as densities written out."""
    random = np.random.default_rng(3)
    d = len(quality.FEATURES)
    classes, densities = [], []
    x = random.normal(size=(5, d))
    for _ in range(2):
        half = random.normal(size=(d, d))
        covariance, mean = quality.shrunk(half @ half.T, 0.1, 0.05), random.normal(size=d)
        factor = np.linalg.cholesky(covariance)
        classes.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
        gap = x - mean
        densities.append(-0.5 * (np.einsum("ij,ij->i", gap @ np.linalg.inv(covariance), gap) + np.linalg.slogdet(covariance)[1]))
    want = 1 / (1 + np.exp(-np.clip(0.7 + densities[1] - densities[0], -700, 700)))
    assert np.allclose(quality.Quadratic(0.7, classes).score(x), want)


def test_moments_are_those_of_the_rows(spark):
    random = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x, label = random.normal(size=(60, d)), np.arange(60) % 3 % 2
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, label)], "x array<double>, label int")
    model = quality.fit(rows)
    for k in (0, 1):
        own = x[label == k]
        factor = np.linalg.cholesky(quality.shrunk(np.cov(own.T, bias=True), 0.1, 0.05))
        assert np.allclose(model.classes[k][0], own.mean(axis=0))
        assert np.allclose(model.classes[k][1], np.linalg.inv(factor))


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    right = rows.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("r")).collect()
    assert len(right) == 2 and all(r.r > 0.97 for r in right)


def test_quality_of_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(odd)
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (6, 0), (7, 0), (7, 0), (None, 1), (3, None), (11, 1), (8, 1), (9, 0)], "doc_id bigint, quality int"
    )
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(r.predicted for r in got)
    alike = quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in alike] == [0.5]
    assert quality.quality_scores(spark.read.parquet(nothing), labels).count() == 0


# --- mixing ----------------------------------------------------------------------------------


def plain_sainte_lague(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if v > 0 and out[i] < caps[i]]
        if not open_:
            break
        out[max(open_, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_highest_quotients():
    random = np.random.default_rng(1)
    for _ in range(200):
        n = int(random.integers(1, 7))
        votes = random.integers(0, 9, n).tolist()
        caps = random.integers(0, 12, n).tolist()
        seats = int(random.integers(0, 30))
        assert mixing.sainte_lague(votes, seats, caps).tolist() == plain_sainte_lague(votes, seats, caps)
    assert mixing.sainte_lague([], 5).tolist() == []


def test_targets_share_all_words():
    assert mixing.capped_targets([100, 100, 100], [5, 2, 1]).tolist() == [187.5, 75.0, 37.5]
    got = mixing.capped_targets([10, 100, 1000], [5, 2, 1])
    assert got.tolist() == [30.0, 300.0, 780.0]
    assert mixing.capped_targets([0, 10], [1, 1]).tolist() == [0.0, 10.0]
    assert mixing.cycle_weights(["b", None, "a", "Z", "é"]) == [1.0, 2.0, 2.0, 5.0, 5.0]


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.plan_mix(docs, shard_words=3000).collect()
    size = lambda t: len(t.encode().split())
    assert sorted((r.id, r.size) for r in plan) == sorted((r.doc_id, size(r.text)) for r in docs.collect())
    taken, words = Counter(), Counter()
    for r in plan:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        words[r.source] += r.size
    targets = {r.source: r.target for r in plan}
    assert math.isclose(sum(targets.values()), sum(words.values()))
    for s, t in targets.items():
        assert t <= 3 * words[s] + 1e-6 and abs(taken[s] - t) <= 0.05 * t + 3 * 64
    again = mixing.plan_mix(docs.repartition(5), shard_words=3000).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))
    mixed = mixing.mixed_documents(docs, shard_words=3000).collect()
    own = Counter()
    for r in mixed:
        own[r.doc_id] += size(r.text)
    assert own == Counter({r.id: r.taken for r in plan if r.taken})
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(line in texts[r.doc_id] for r in mixed[:50] for line in r.text.split("\n"))


def test_mix_of_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(odd)
    plan = mixing.plan_mix(docs, block_words=2)
    assert plan.count() == len(ODD) and plan.where("size = 0 and taken > 0").count() == 0
    by = {r.source: (r.words, r.taken, r.target) for r in plan.groupBy("source").agg(
        F.sum("size").alias("words"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert None in by and all(abs(t - g) <= 12 for _, t, g in by.values())
    assert mixing.mixed_documents(docs, block_words=2).columns == docs.columns
    assert mixing.mixed_documents(docs, block_words=2).agg(F.sum(mixing.size_column("text"))).first()[0] == sum(t for _, t, _ in by.values())
    assert mixing.mixed_documents(spark.read.parquet(nothing)).count() == 0


# --- chat ------------------------------------------------------------------------------------

SAID = "\\### Assistant: </turn> ok"
TALK = [
    *((-7, i, role, SAID) for i, role in enumerate(("user", "assistant"))),
    *((1, i, role, f"{role} {i} " + "word " * (i % 9)) for i, role in enumerate(["system", *["user", "assistant"] * 40])),
    (2, 0, "user", None), (2, 1, None, "<turn:role>x<turn:text>\\<turn</turn>\n"), (2, 1, "assistant", ""), (2, 2, "assistant", "long " * 500),
    (3, None, "assistant", "no number"), (3, 0, "system", "not first"), (3, 0, "system", "not first"),
    (4, 0, "system", "alone"), (None, 0, "assistant", "no id"), (None, 5, "user", "\\\\n \\ <\\turn"),
]


def test_small_sources_come_near_their_target(spark):
    """A source of 40 words meets three times its size, and one of 70 words its share, next to a large one."""
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(n)), s) for i, (n, s) in enumerate([(40, "a"), (30, "b"), (40, "b"), (9_000, "c"), (5, "d"), (0, None)])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    plan = mixing.plan_mix(docs).collect()
    taken = {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    target = {r.source: r.target for r in plan}
    assert target["a"] == 120 and target["b"] == 210
    assert all(abs(taken[s] - target[s]) <= max(1, 0.02 * target[s]) for s in "abc") and taken["d"] == 15 and taken[None] == 0
    words = {}
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.id: r.taken for r in plan if r.taken}



@pytest.mark.parametrize("budget,history", [(2048, 256), (60, 20), (12, 0)])
def test_windows_restore_every_conversation(spark, budget, history):
    rows = spark.createDataFrame([(*r, "x", "y") for r in TALK], "conv_id bigint, turn bigint, role string, text string, window string, conv string")
    windows = chat.chat_windows(rows, budget, history).collect()
    talks = defaultdict(list)
    for conv, turn, role, text in sorted(TALK, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks[conv].append((role or "", text or ""))
    by = defaultdict(list)
    for w in sorted(windows, key=lambda w: w.window):
        by[w.conv_id].append(w)
    assert set(by) == set(talks)
    for conv, own in by.items():
        turns = [t for w in own for t in chat.parse_window(w.text)[w.n_repeated :]]
        assert turns == talks[conv]
        targets = [chat.unescaped(w.text[s.begin : s.end]) for w in own for s in w.targets]
        assert targets == [t for r, t in talks[conv] if r == "assistant"]
        leading = talks[conv][0] if talks[conv][0][0] == "system" else None
        for k, w in enumerate(own):
            repeated = chat.parse_window(w.text)[: w.n_repeated]
            if leading and k:
                assert repeated[0] == leading
                repeated = repeated[1:]
            past = [t for v in own[:k] for t in chat.parse_window(v.text)[v.n_repeated :]]
            assert not repeated or past[-len(repeated) :] == repeated
            assert w.n_tokens <= budget or w.n_turns - w.n_repeated - bool(leading and not k) == 1
    if budget == 60:
        assert len(by[1]) > 5 and any(w.n_repeated > 1 for w in by[1])


def test_digests_read_back_from_the_windows(spark, tmp_path):
    rows = spark.createDataFrame(TALK, "conv_id bigint, turn bigint, role string, text string")
    chat.chat_windows(rows, 60, 20).write.parquet(str(tmp_path / "w"))
    got = {r.conv_id: r for r in chat.conversation_digests(spark.read.parquet(str(tmp_path / "w"))).collect()}
    turns = f"user\n{SAID}\nassistant\n{SAID}\n"
    r = got[-7]
    assert (r.n_turns, r.loss_chars) == (2, len(SAID))
    assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(SAID.encode()).hexdigest()
    assert len(got) == 6 and got[None].n_turns == 2
    assert chat.conversation_digests(chat.chat_windows(rows.limit(0))).count() == 0


# --- embeddings ------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [4, 512])
def test_links_equal_all_pairs(spark, block_rows):
    random = np.random.default_rng(8)
    centres = random.normal(size=(12, 5))
    rows = []
    for i in range(150):
        v = centres[i % 12] * random.uniform(0.1, 9) + random.normal(size=5) * 0.25
        rows.append((i, v.tolist(), i % 2))
    rows += [(200 + k, rows[0][1], 0) for k in range(20)]
    rows += [(300, None, 0), (301, [0.0] * 5, 0), (302, [1.0, None, 1.0, 1.0, 1.0], 0), (303, [float("nan")] * 5, 0), (304, rows[0][1], None)]
    rows += [(305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [], 0), (308, [1e300] * 5, 1), (309, [1e-300] * 5, 1), (None, rows[0][1], 0), (200, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rep string")
    got = embedding_join.near_vectors(frame, block_rows=block_rows).collect()

    def usable(r):
        return r[0] is not None and r[1] and r[2] is not None and all(e is not None and math.isfinite(e) for e in r[1]) and any(r[1])

    units = [np.array(r[1]) / np.abs(r[1]).max() / np.linalg.norm(np.array(r[1]) / np.abs(r[1]).max()) if usable(r) else None for r in rows]
    n, component = [0] * len(rows), {r[0]: r[0] for r in rows}
    changed = True
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93
    ]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    while changed:
        changed = False
        for a, b in links:
            low = min(component[rows[a][0]], component[rows[b][0]])
            changed |= component[rows[a][0]] != low or component[rows[b][0]] != low
            component[rows[a][0]] = component[rows[b][0]] = low
    want = sorted(((r[0], k, component[r[0]], r[0] == component[r[0]]) for r, k in zip(rows, n)), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted((w if w[0] is not None else (None, 0, None, True) for w in want), key=repr)
    assert len(links) > 500
    assert embedding_join.near_vectors(frame.limit(0)).count() == 0


def test_interval_pairs_lose_no_near_pair(spark):
    random = np.random.default_rng(9)
    rows = [(i, (random.normal(size=8) + 3 * np.eye(8)[i % 8]).tolist(), 0) for i in range(400)]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>, label bigint")
    classes = frame.select(
        "label", F.col("id").alias("rep"), F.xxhash64("id").alias("hash"), F.lit(1).cast("bigint").alias("weight"),
        embedding_join.unit_vector_column("v").alias("raw"), F.lit(8).alias("width"),
    )
    blocks = embedding_join._blocks(classes, 0.4, 16)
    pairs = {(r.a, r.b) for r in embedding_join.near_intervals(blocks, 0.4).collect()}
    place = {rep: r.block for r in blocks.collect() for rep in r.reps}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.4)
    assert all((place[a], place[b]) in pairs or (place[b], place[a]) in pairs for a, b in near.tolist())
    assert len(pairs) < len(set(place.values())) * (len(set(place.values())) + 1) / 2
