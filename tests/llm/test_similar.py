"""The pipeline's near-dedup stage against brute-force five-word similarity."""

import random
from itertools import combinations

from odd_rows import ODD, SMALL
from test_dedup import plain_components

import corpus_pipeline
from cytolake.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_shingles(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(plain_components(links, sorted(sets)).values())), links


def test_edited_copies_go_and_unlike_texts_stay(spark):
    dice = random.Random(3)
    texts = {}
    for family in range(60):  # 20 copies of the first, 3 of the others, from no edit to clearly below the similarity
        base = [f"w{dice.randrange(5000)}" for _ in range(dice.choice([40, 150, 400]))]
        for copy in range(20 if family == 0 else 3):
            words = list(base)
            for _ in range(round(copy % 4 * len(base) / 120)):
                words[dice.randrange(len(words))] = f"x{dice.randrange(5000)}"
            texts[len(texts)] = " ".join(words)
    want, links = plain_kept(texts)
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in links) > 20  # two bits would not do
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()) == want


def test_one_leader_is_not_enough_for_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4)
    dice = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    texts = {}
    for i in range(30):  # all share most of a passage, but only those of one third are similar
        third = [f"t{i % 3}-{k}" for k in range(90)]
        words = base + third
        words[dice.randrange(300)] = "edit"
        texts[i] = " ".join(words)
    want, _ = plain_kept(texts)
    assert len(want) == 3
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == want


def test_similar_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(odd)
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    texts = [(i, t) for i, t, _, _ in ODD]
    assert kept.where("doc_id = 2").count() == 0 and kept.where("doc_id in (3, 4, 5)").count() == 1
    assert kept.where("doc_id is null").count() <= sum(i is None for i, _ in texts)
    assert simhash.drop_similar(spark.read.parquet(nothing)).count() == 0
