"""Byte-level BPE by a table of distinct words, and decoding by a join with the pieces of the ids.

Words are split in Spark by the tokenizer's own rule. Each distinct word meets all its blocks in one shuffle, is
encoded once by the tokenizer library and goes back to every block that holds it; there the ids take the places of
the words in each document. BPE merges never cross a word, so this equals encoding whole texts.

The tokenizer file is read by the driver and travels to the tasks; workers need no copy of it.
"""

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm.blocks import block_documents, block_words, numbers_of
from cytolake.llm.text import as_bytes
from cytolake.llm.workers import tidy

BLOCK_BYTES = 32 << 20

# Up to here, and in the few blocks after it, character classes are old and settled; texts with any other character
# are split by the library itself.
_SETTLED_END = 0x24F
_UNSETTLED = re.compile("[^\x00-ɏ‐-‧€]")
_SPACE = "\t-\r \x85\xa0"


def _class(kind: str) -> str:
    """Settled characters whose general category begins with ``kind``, for a character set."""
    return "".join(re.escape(chr(c)) for c in range(_SETTLED_END + 1) if unicodedata.category(chr(c))[0] == kind)


def _word_pattern() -> re.Pattern:
    letter, digit = _class("L"), _class("N")
    return re.compile(
        # fixed values: the word rule of byte-level BPE
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{_SPACE}{letter}{digit}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def load_tokenizer(text: str):
    """The library's tokenizer from the text of its file; one thread, as Spark runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def word_splitter(tokenizer_text: str) -> Callable[[bytes], list[str]]:
    """Function of a text's bytes that lists its words and, as they stand, the added tokens in it."""
    spec = json.loads(tokenizer_text)
    rule = spec["pre_tokenizer"] or {}
    if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("expected byte-level BPE without normaliser and prefix space")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take white space or whole words only are not supported")
    added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    around = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    find = _word_pattern().findall
    library = None

    def words(text: str) -> list[str]:
        nonlocal library
        if text.isascii() or not _UNSETTLED.search(text):
            return find(text)
        if library is None:
            library = load_tokenizer(tokenizer_text).pre_tokenizer
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] if text else []

    def split(data: bytes) -> list[str]:
        text = data.decode("utf-8", "replace")
        if around is None or not around.search(text):
            return words(text)
        out: list[str] = []
        for i, part in enumerate(around.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return split


class LazySplitter:
    """Builds the splitter in the task that first uses it; only the broadcast text travels."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.split = broadcast, None

    def __call__(self, data: bytes) -> list[str]:
        if self.split is None:
            self.split = _kept_in_worker(word_splitter, self.broadcast.value)
        return self.split(data)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "split": None}


class WordEncoder:
    """Ids of words as the splitter lists them.

    Words of a space and letters a-z go to the library joined, some hundreds at a time, as it splits them again where they meet; the bytes
    that ids stand for tell where a word ends. Other words go one by one.
    """

    JOINED = 500

    def __init__(self, tokenizer_text: str) -> None:
        self.tokenizer = load_tokenizer(tokenizer_text)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.joins = not any(re.fullmatch("[A-Za-z ]*", t) for t in added)  # none arises where words meet
        self.size = np.array([len(p) for p in pieces_of(tokenizer_text)], np.int64)

    def __call__(self, words: list[str], kind: str = "<u4") -> dict[str, bytes]:
        """Ids of distinct words as little-endian unsigned integers."""
        plain = [w for w in words if w[:1] == " " and w.isascii() and w[1:].isalpha()] if self.joins else []
        found = self._joined(plain, kind) if plain else {}
        if len(found) < len(words):
            alone = [w for w in words if w not in found]
            for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
                found[w] = array("I", e.ids).tobytes() if kind == "<u4" else np.array(e.ids, kind).tobytes()
        return found

    def _joined(self, words: list[str], kind: str) -> dict[str, bytes]:
        texts = ["".join(words[i : i + self.JOINED]) for i in range(0, len(words), self.JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        want = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        reached = np.cumsum(self.size[ids])
        last = np.searchsorted(reached, want)
        if last[-1] >= len(ids) or (reached[last] != want).any():  # a piece without its bytes
            return {}
        raw = ids.astype(kind)
        ends = ((last + 1) * raw.itemsize).tolist()
        raw = raw.tobytes()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends)}


class _Known(dict):
    """Ids of the words seen lately. A word among the ``older`` ones moves here; one that is in neither stands for itself and waits in ``new``."""

    def __init__(self, older: dict) -> None:
        super().__init__()
        self.older, self.new = older, []

    def __missing__(self, word: str) -> bytes | str:
        found = self.older.get(word)
        if found is None:
            self.new.append(word)
            found = word
        self[word] = found
        return found


class CachedEncoder:
    """Encodes whole texts, giving a word to the library only when it is not among those seen lately.

    Words of the last ``most`` and up to ``2 most`` distinct ones are remembered, so memory is bounded and common
    words stay.
    """

    def __init__(self, tokenizer_text: str, most: int = 600_000) -> None:
        self.encode, self.split, self.most = WordEncoder(tokenizer_text), word_splitter(tokenizer_text), most
        self.known = _Known({})

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; null is empty."""
        look = self.known.__getitem__
        found = [list(map(look, self.split(t or b""))) for t in texts]  # each word is looked up once
        new, self.known.new = self.known.new, []
        if new:
            try:
                encoded = self.encode(new)
            except BaseException:  # no word may stay that stands for itself
                self.known = _Known({})
                raise
            self.known.update(encoded)
            found = [[encoded[x] if x.__class__ is str else x for x in own] for own in found]
        if len(self.known) > self.most:
            self.known.older = {}
            self.known = _Known(self.known)
        return [b"".join(own) for own in found]


def _kept_in_worker(make: Callable, tokenizer_text: str):
    """What ``make`` gives for the tokenizer, kept by this Python worker from task to task.

    Functions travel by value and bring new globals with every task, so what should outlive a task is kept with the
    library, which a worker imports once.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_of_worker", {})
    key = make.__name__, hash(tokenizer_text)
    if key not in kept:
        kept[key] = make(tokenizer_text)
    return kept[key]


def worker_encoder(tokenizer_text: str) -> CachedEncoder:
    """The encoder of this Python worker."""
    return _kept_in_worker(CachedEncoder, tokenizer_text)


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
    with_decoded: bool = False,
) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, one row per row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers.

    With ``with_decoded`` the ids are decoded again in the same task, as :func:`decode_documents` does, to column ``decoded``.
    No special tokens are added; added tokens that stand in a text become their id. Null and empty texts have no ids;
    repeated rows stay repeated; an empty table gives an empty result; other columns are not read. ``docs`` is a scan
    of files or a checkpoint.
    """
    spark = docs.sparkSession
    tokenizer_text = read_tokenizer(tokenizer_path)
    small = "<u2" if load_tokenizer(tokenizer_text).get_vocab_size() <= 1 << 16 else "<u4"  # ids on their way
    shipped = spark.sparkContext.broadcast(tokenizer_text)
    known = spark.sparkContext.broadcast(pieces_of(tokenizer_text)) if with_decoded else None
    split = LazySplitter(shipped)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), as_bytes(text_column).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word: each distinct word is encoded once, also where its rows span batches."""
        encoder = None
        last: tuple[bytes | None, bytes] = (None, b"")
        for batch in batches:
            words = batch.column("word").to_pylist()
            encoder = encoder or _kept_in_worker(WordEncoder, shipped.value)
            new = [w for a, w in zip([last[0], *words], words) if w != a]
            named = [w.decode("utf-8") for w in new]
            found = dict(zip(new, map(encoder(named, small).__getitem__, named))) | {last[0]: last[1]}
            last = (words[-1], found[words[-1]]) if words else last
            yield pa.RecordBatch.from_pydict({
                "block": batch.column("block"), "number": batch.column("number"), "piece": pa.array([found[w] for w in words], pa.binary()),
            })

    pieces = (
        block_words(rows, split, block_bytes).select("word", "block", "number").repartition("word").sortWithinPartitions("word")
        .mapInArrow(tidy(encode), "block bigint, number int, piece binary")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its words before its documents: ids of the words put in their places, a batch of documents at a time."""
        block, numbers, found = None, [], []
        begin = length = flat = None
        for batch in batches:
            at = batch.column("at").to_numpy()
            for start, end in _runs(at):
                rows = batch.slice(start, end - start)
                if at[start] >> 1 != block:
                    block, numbers, found, flat = at[start] >> 1, [], [], None
                if not at[start] & 1:
                    numbers.append(rows.column("number").to_numpy())
                    found += rows.column("data").to_pylist()
                    continue
                if flat is None:
                    begin, length, flat = _laid_out(np.concatenate([*numbers, np.zeros(0, np.int64)]), found, small)
                    numbers, found = [], []
                ids = []
                for packed in rows.column("data").to_pylist():
                    own = numbers_of(packed)
                    many = length[own]
                    ends = np.cumsum(many)
                    total = int(ends[-1]) if len(ends) else 0
                    ids.append(flat[np.repeat(begin[own] - (ends - many), many) + np.arange(total)].astype("<u4").tobytes())
                out = {"doc_id": rows.column("number"), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if with_decoded:
                    out["decoded"] = pa.array([decoded(i, known.value) for i in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    # one column tells block and kind, so rows sort by a single number; a word's number and a document's id share a column
    words = pieces.select((F.col("block") * 2).alias("at"), F.col("number").cast("bigint").alias("number"), F.col("piece").alias("data"))
    documents = block_documents(rows, split, block_bytes).select((F.col("block") * 2 + 1).alias("at"), F.col("id").alias("number"), F.col("numbers").alias("data"))
    schema = "doc_id bigint, n_tokens bigint, ids binary" + (", decoded string" if with_decoded else "")
    # documents come first: blocks are named after the numbers of the scan's tasks, which a union shifts for those that follow
    return documents.union(words).repartition(F.shiftright("at", 1)).sortWithinPartitions("at").mapInArrow(tidy(place), schema)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    starts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist()] if len(values) else []
    return list(zip(starts, [*starts[1:], len(values)]))


def _laid_out(number: np.ndarray, pieces: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By number of a word where its ids begin and how many they are, and the ids of all words."""
    flat = np.frombuffer(b"".join(pieces), kind)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // flat.itemsize
    begin, length = np.zeros(len(number) + 1, np.int64), np.zeros(len(number) + 1, np.int64)
    begin[number], length[number] = np.cumsum(size) - size, size
    return begin, length, flat


def byte_alphabet() -> dict[str, int]:
    """Character of byte-level BPE -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(tokenizer_text: str) -> list[bytes]:
    """Bytes of every id; an id without a token has none."""
    spec, alphabet = json.loads(tokenizer_text), byte_alphabet()
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    as_raw = lambda t: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
    return [as_raw(tokens[i]) if i in tokens else b"" for i in range(max(tokens, default=-1) + 1)]


def decoded(raw: bytes | None, pieces: list[bytes]) -> str:
    """Text of ids, each joined with its piece."""
    ids = np.frombuffer(raw or b"", "<u4")
    ids = ids[ids < len(pieces)] if len(ids) and ids.max() >= len(pieces) else ids
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with column ``decoded``: the pieces of the ids, joined in order, as text.

    The id-to-piece table has one row per id of the vocabulary, so its size is bounded by the tokenizer's file; it is
    the broadcast side of the join. Ids outside of it have no piece; null ids give an empty text; bytes that
    form no character are replaced as the library replaces them.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(pieces_of(read_tokenizer(tokenizer_path)))

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return pd.Series([decoded(raw, shipped.value) for raw in column], dtype=object)

    return encoded.withColumn("decoded", decode(ids_column))
