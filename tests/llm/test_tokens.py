"""BPE, token files and suffix tree against the library and plain versions."""

import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cytolake.llm import blocks, bpe, suffix_tree, token_files
from cytolake.llm.text import words_of

from odd_rows import ODD, SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return bpe.load_tokenizer(bpe.read_tokenizer(PATH))


def test_pack_round_trip():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    assert blocks.unpack(blocks.pack(numbers)).tolist() == numbers.tolist()
    assert blocks.unpack(blocks.pack(np.zeros(0, np.int64))).tolist() == []


def test_words_are_those_of_the_library(library):
    split = bpe.word_splitter(bpe.read_tokenizer(PATH))
    characters = [chr(c) for c in [*range(0x260), *range(0x2000, 0x2070), 0x20AC, 0x3000, 0x65E5, 0x1F600]]
    for c in characters:
        for text in (f"a{c}b", f" {c}{c} x", f"1{c}2 {c}", f"{c}\n{c}", f"'{c}'s{c}", f"  {c}  "):
            assert split(text.encode()) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], repr(text)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_ids_and_text_of_odd_rows(spark, odd, nothing, library, block_bytes):
    encoded = bpe.encode_documents(spark.read.parquet(odd), PATH, block_bytes=block_bytes, with_decoded=True)
    got = bpe.decode_documents(encoded.withColumnRenamed("decoded", "at_once"), PATH).collect()
    assert all(r.at_once == r.decoded for r in got)
    want = [(i or 0, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _, _ in ODD]
    assert sorted((r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got) == sorted(want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode_documents(spark.read.parquet(nothing), PATH).count() == 0


def test_ids_equal_the_library_on_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == ids
        assert got[r.doc_id].decoded == library.decode(ids, skip_special_tokens=False)


def test_blocks_of_many_tasks_are_encoded_in_batches(spark, library, tmp_path):
    """Small blocks of several scan tasks; no task takes or gives a block in one piece."""
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5, "doc_id").write.parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a scan task for each file
    try:
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() == 5
        encoded = bpe.encode_documents(docs, PATH, block_bytes=50_000, with_decoded=True)
        assert "CoGroups" not in encoded._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in encoded.collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got == sorted((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())


def test_decoding_ids_that_form_no_text(spark, library):
    rows = [(1, np.array([160, 50256, 99, 4_000_000_000], "<u4").tobytes()), (2, None), (3, b"")]
    got = {r.k: r.decoded for r in bpe.decode_documents(spark.createDataFrame(rows, "k int, ids binary"), PATH).collect()}
    assert got == {1: library.decode([160, 50256, 99], skip_special_tokens=False), 2: "", 3: ""}


@pytest.mark.parametrize("planes", [4, 32])
def test_file_image_round_trip(planes):
    rows = [(5, np.arange(1000, dtype="<u4").tobytes()), (None, b""), (7, np.array([2**32 - 1, 1], "<u4").tobytes())]
    names, lengths, ids = token_files.read_image(token_files.file_image(rows, planes, 300))
    assert names == [5, None, 7] and lengths.tolist() == [1000, 0, 2] and ids.tobytes() == b"".join(d for _, d in rows)
    assert token_files.read_image(token_files.file_image([], planes))[2].tolist() == []
    with pytest.raises(ValueError):
        token_files.read_image(b"something else")


@pytest.mark.parametrize("planes", [4, 32])
def test_token_files_of_odd_rows(spark, odd, nothing, library, tmp_path, planes):
    folder = str(tmp_path / "files")
    token_files.write_token_files(spark.read.parquet(odd), folder, PATH, planes=planes, block_ids=50, file_ids=100)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(((i is not None, i or 0), t is not None, t or "") for i, t, _, _ in ODD)
    start = 0
    for r, ((known, i), _, text) in zip(got, order, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (i if known else None, start, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = str(tmp_path / "none")
    token_files.write_token_files(spark.read.parquet(nothing), empty, PATH)
    assert token_files.read_token_files(spark, empty).count() == 0


def plain_tree(texts, depth, least_share, divergence, evidence):
    """Counts of all states, by the definition."""
    counts = Counter()
    for t in texts:
        s = [32] * depth + suffix_tree.symbols_of(t).tolist()
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                counts[tuple(s[k - d : k]), s[k]] += 1
    total = Counter()
    for (c, _), n in counts.items():
        total[c] += n
    frequent = {c for c in total if total[c] >= max(1, least_share * total[()])}
    def gain(c):
        return sum(n / total[c] * math.log(n / total[c] / (counts[c[1:], a] / total[c[1:]])) for (x, a), n in counts.items() if x == c)

    following = Counter(c for c, _ in counts)
    enough = lambda c, g: g >= divergence and g * total[c] >= evidence * following[c] * math.log(total[c])
    kept = {c for c in frequent if c and enough(c, gain(c))}
    states = {()} | {c[i:j] for c in kept for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    return states, counts, total


def plain_score(text, states, counts, total, depth, smoothing):
    following = Counter(c for c, _ in counts)

    def chance(c, a):
        if not c:
            return (counts[c, a] + 0.5) / (total[c] + 0.5 * 257)
        m = smoothing * following[c]
        return (counts[c, a] + m * chance(c[1:], a)) / (total[c] + m)

    s, out = [32] * depth + suffix_tree.symbols_of(text).tolist(), 0.0
    for k in range(depth, len(s)):
        state = next(tuple(s[k - d : k]) for d in range(depth, -1, -1) if tuple(s[k - d : k]) in states)
        out += math.log10(chance(state, s[k]))
    return out


def test_suffix_tree_equals_the_definition(spark):
    texts = [b"abab abba", b"The  cab\nfab", None, b"", "üb ab".encode(), b"abcabcabc " * 20]
    depth, share, divergence, evidence, smoothing = 3, 0.01, 0.05, 0.2, 2.0
    states, counts, total = plain_tree(texts, depth, share, divergence, evidence)
    assert 1 < len(states) < len(total)
    frame = spark.createDataFrame([(t,) for t in texts], "text binary")
    tree = suffix_tree.train_tree(frame, depth, share, divergence, evidence, smoothing)
    assert len(tree.log10) == len(states)
    odd_texts = [*texts, b"zzz unseen", bytes(range(97, 123)) * 30]
    want = [plain_score(t, states, counts, total, depth, smoothing) for t in odd_texts]
    for lane in (7, 256):
        assert np.allclose(tree.score(odd_texts, lane), want, rtol=1e-5)


def test_states_are_distributions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tree = suffix_tree.train_tree(docs.select(F.col("text").cast("binary")), 4, 1e-4)
    chance = 10.0 ** tree.log10.astype(float)
    unseen = 257 - (chance.shape[1] - 1)
    assert np.allclose(chance[:, :-1].sum(axis=1) + unseen * chance[:, -1], 1, atol=1e-5)


def test_base_scores_equal_the_formula(spark, odd, nothing):
    got = suffix_tree.model_scores(spark.read.parquet(odd), block_bytes=300).collect()
    words = lambda t: [*(w.lower() if w.isascii() else w for w in (t or "").encode().split()), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t, _, _ in ODD if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _, _ in ODD:
        own = words(t)
        score = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((i or 0, held(i), len(own), sum(c[w] > 0 for w in own), n, round(score, 6)))
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert suffix_tree.model_scores(spark.read.parquet(nothing)).count() == 0


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    r = suffix_tree.model_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    row = r.agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert row.m > row.b


def test_words_are_encoded_together():
    """Words of a space and letters reach the library some hundreds at a time, each with the ids it has alone; before, one by one."""
    text = bpe.read_tokenizer(PATH)
    encoder, library = bpe.WordEncoder(text), bpe.load_tokenizer(text)
    dice, sent = random.Random(5), []
    words = list({" " + "".join(dice.choices("abcdefghijklmnopqrstuvwxyzABCXYZ", k=dice.randrange(1, 14))) for _ in range(3000)})
    others = ["", " ", "a", "Plain", " é", " naïve", " x1", "'s", "\n", "<|endoftext|>", " 12", " ²", "ſ"]
    dice.shuffle(words := words + others)

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    for kind in ("<u4", "<u2"):
        got = encoder(words, kind)
        assert got.keys() == set(words)
        assert {w: np.frombuffer(b, kind).tolist() for w, b in got.items()} == {w: library.encode(w, add_special_tokens=False).ids for w in words}
    assert len(sent) < 2 * (len(others) + len(words) // 500 + 1) + 1
    assert encoder([]) == {}


def test_words_that_could_meet_in_an_added_token_go_alone():
    spec = json.loads(bpe.read_tokenizer(PATH))
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 1 + max(t["id"] for t in spec["added_tokens"]) + len(spec["model"]["vocab"]), "content": "o b"})
    encoder = bpe.WordEncoder(json.dumps(spec))
    library = bpe.load_tokenizer(json.dumps(spec))
    words = [" foo", " bar", " two"]
    assert {w: np.frombuffer(b, "<u4").tolist() for w, b in encoder(words).items()} == {w: library.encode(w, add_special_tokens=False).ids for w in words}


def test_packing_takes_as_many_bytes_as_needed():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, (1 << 62) + 5], np.int64)
    for most in range(1, len(numbers) + 1):
        packed = blocks.pack(numbers[:most])
        assert blocks.unpack(packed).tolist() == numbers[:most].tolist()
        assert len(packed) == sum(max(1, -(-int(n).bit_length() // 7)) for n in numbers[:most])


def test_a_step_of_the_tree_looks_up_once(spark):
    """The scoring table holds the next place and the probability side by side and gives what the two tables gave, to the last bit."""
    dice = random.Random(8)
    texts = [" ".join("".join(dice.choices("abcé", k=dice.randrange(1, 5))) for _ in range(dice.randrange(0, 90))).encode() for _ in range(60)] + [None, b""]
    tree = suffix_tree.train_tree(spark.createDataFrame([(t,) for t in texts[:40]], "text binary"), 3, 1e-3)
    steps = suffix_tree.Steps.of(tree)
    want = []
    for t in texts:
        state, total = 0, 0.0
        for symbol in [32] * 3:
            state = int(tree.following[state, tree.column[symbol]])
        for symbol in suffix_tree.symbols_of(t).tolist():
            total += float(tree.log10[state, tree.column[symbol]])
            state = int(tree.following[state, tree.column[symbol]])
        want.append(total)
    assert steps.score(texts, lane=10**6).tolist() == want
    assert np.allclose(steps.score(texts, lane=16), want, rtol=1e-12)


def test_words_are_counted_by_block_in_training_texts(spark, tmp_path):
    spark.createDataFrame([(b"A b\xc3\xa9 a",), (None,), (b" a\tc ",)], "text binary").write.parquet(f"{tmp_path}/t")
    found = blocks.word_counts(spark.read.parquet(f"{tmp_path}/t"), words_of, 1).groupBy("word").agg(F.sum("n").alias("n")).collect()
    assert {bytes(r.word): r.n for r in found} == {b"a": 3, "bé".encode(): 1, b"c": 1}


@pytest.mark.parametrize("most", [3, 1000])
def test_each_word_of_a_text_is_looked_up_once(library, most):
    """A word that is known is found in one look-up, a new one is encoded once a call; words that were put aside come back."""
    encoder, dice, asked = bpe.CachedEncoder(bpe.read_tokenizer(PATH), most), random.Random(4), []
    encode = encoder.encode
    encoder.encode = lambda words: asked.append(list(words)) or encode(words)
    for _ in range(30):
        texts = [" ".join(dice.choices(["the", "cat", "naïve", "x1", "日本", "'s", "<|endoftext|>", "\n\n"], k=dice.randrange(6))).encode() for _ in range(4)] + [None, b""]
        looks, known = [], encoder.known
        encoder.known = type("Watched", (bpe._Known,), {"__getitem__": lambda self, w: looks.append(w) or bpe._Known.__getitem__(self, w)})(known.older)
        encoder.known.update(known)
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder(texts)]
        assert got == [library.encode((t or b"").decode(), add_special_tokens=False).ids for t in texts]
        assert looks == [w for t in texts for w in encoder.split(t or b"")]
    assert all(len(own) == len(set(own)) for own in asked)
    assert most == 3 or sum(map(len, asked)) == len(set(sum(asked, [])))
