"""The pipeline stage by stage against the operators' plain results."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd_rows import SMALL
from test_similar import plain_kept

import corpus_pipeline
from cytolake.llm import bpe, line_dedup, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, stored in between."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(folder / str(k)))
        after = spark.read.parquet(str(folder / str(k)))
        out.append((docs, after))
        docs = after
    return out


def test_all_but_the_last_return_documents(stages):
    assert all(after.columns == COLUMNS for _, after in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mix", "bpe"]


def test_rejected_documents_go(spark, stages):
    before, after = stages[0]
    scores = quality.quality_scores(before, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scores if r.predicted)


def test_each_line_stays_where_it_stands_first(stages):
    before, after = stages[1]
    seen, want = [], {}
    for r in sorted(before.collect()):
        left = []
        for line in r.text.split("\n"):
            words = line_dedup.line_words(line.encode())
            near = any(w == words or (min(len(w), len(words)) >= 10 and line_dedup.within_one_edit(w, words)) for w in seen)
            if words:
                seen.append(words)
            if not words or not near:
                left.append(line)
        if any(x.strip() for x in left):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_document_of_each_group_stays(stages):
    """Groups are linked by five-word similarity of 0.8, found by comparing all pairs."""
    before, after = stages[2]
    want, _ = plain_kept({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == want


@pytest.mark.parametrize("k", range(5))
def test_every_stage_takes_odd_rows_and_no_rows(spark, odd, nothing, k):
    """Nulls, empty, white and very long texts, ties, repeated rows and ids, extra columns, and a table without rows."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(odd)
    result = stage(spark, docs, SMALL)
    rows = result.collect()
    assert stage(spark, spark.read.parquet(nothing), SMALL).count() == 0
    ids = Counter(r.doc_id for r in rows)
    if k < 4:
        assert result.columns == docs.columns and all(r.row == "x" for r in rows)
    if name == "line dedup":
        assert 2 not in ids and ids[3] == ids[4] == ids[5] == ids[6] == 1 and ids[8] == 2
    if name == "simhash near-dedup":
        assert 2 not in ids and ids[1] == 1 and ids[3] == 1 and 4 not in ids and ids[8] == 2  # repeated rows of an id stay together
    if name == "bpe":
        texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
        assert Counter((r.doc_id, r.decoded) for r in rows) == texts


def test_the_mix_holds_what_its_plan_takes(stages):
    before, after = stages[3]
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert words == Counter({r.id: r.taken for r in mixing.plan_mix(before).collect() if r.taken})


def test_ids_are_those_of_the_library(stages):
    before, after = stages[4]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = bpe.load_tokenizer(bpe.read_tokenizer(path))
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids), r.text) for r in before.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in after.collect()) == want


def test_run_gives_the_same_rows(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, stages[-1][1].collect()))
