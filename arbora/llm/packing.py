"""Packing documents into token windows by best-fit decreasing.

A document is its tokens and an end id. Those longer than a window are first cut into full windows; what is left is a piece.
Best-fit decreasing only ever looks at lengths, so it runs on their histogram, `window` numbers whatever the corpus: lengths go
in descending order, all pieces of one length at a time, each into the tightest open window. A segment tree indexed by
remaining capacity finds it. Windows that are alike are one run of sequence numbers, so the result is a list of spans,
(length, ranks from - to) -> (sequences from - to, offset), the same as piece by piece; its size depends on the window alone.

Pieces are numbered within their length where they are made (a counter for each length in each task, then shifted by the
counts of the tasks before), and read their place from the span of their rank. No task holds more than its own pieces.

Tokens come from a file of the `tokenizers` library, read where the task runs. White space parts pre-tokens there, so each
distinct run of other characters is encoded once and remembered (at most KEPT in a worker).

A null text is an empty one: the end id alone. A text of any length is encoded in one go by its task. Repeated rows and ties
are documents of their own; which of equally long pieces meets which place is arbitrary. Extra columns don't matter; no rows,
no result.
"""

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.bytework import string_chunks
from arbora.llm.common import table
from arbora.staging import stage

TOKENIZER, WINDOW, END = "word_bpe_49k.json", 2048, 1
KEPT, SLICE, BATCH = 400_000, 8 << 20, 512
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, _part int, _nth long"

_LETTER, _DIGIT, _SPACE, _OTHER, _HIGH = range(5)
KIND = np.full(256, _OTHER, np.uint8)
KIND[128:] = _HIGH
KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
KIND[48:58] = _DIGIT
KIND[65:91] = KIND[97:123] = _LETTER


def parted(data: np.ndarray, offsets: np.ndarray, special: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space more wherever a letter, a digit and another ASCII character meet.

    Pre-tokens end there anyway, but for an apostrophe before a letter and the names of special tokens; fewer distinct words
    are left.
    """
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (a != b) & (a != _SPACE) & (b != _SPACE) & (a != _HIGH) & (b != _HIGH) & (data[:-1] != 39)
    for m in special.finditer(data.tobytes()):
        cut[m.start() + 1 : m.end()] = False
    cut[offsets] = False
    added = np.cumsum(cut)
    out = np.full(len(data) + int(added[-1]), 32, np.uint8)
    out[np.arange(len(data)) + added[:-1]] = data
    return out, offsets + added[offsets]


class Encoder:
    """Ids of words, remembered."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(name)
        # for words of ASCII letters, lower-cased: each is one pre-token, and its last token alone ends a word
        self.plain = Tokenizer.from_file(name)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.whole.get_added_tokens_decoder().values()) or b"(?!)")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.length = array("I"), array("I")

    def _learn(self, words: list[str]) -> None:
        easy = [w for w in words if w.isascii() and w.isalpha()]
        for i in range(0, len(easy), BATCH):
            some = easy[i : i + BATCH]
            got = np.array(self.plain.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            assert len(stops) == len(some)
            self._keep(some, got, np.diff(stops, prepend=0))
        hard = [w for w in words if not (w.isascii() and w.isalpha())]
        for i in range(0, len(hard), BATCH):
            some = hard[i : i + BATCH]
            got = [e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
            self._keep(some, np.array([t for x in got for t in x], np.uint32), np.array([len(x) for x in got]))

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words))))
        self.ids.frombytes(ids.tobytes())
        self.length.frombytes(lengths.astype(np.uint32).tobytes())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        data, offsets = parted(data, offsets, self.special)
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > KEPT:
            self.forget()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        if not distinct:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        length = np.frombuffer(self.length, np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        run = length[number]
        end = np.cumsum(run)
        at = np.repeat(first[number] - end + run, run) + np.arange(int(end[-1]))
        ids = np.frombuffer(self.ids, np.uint32)[at]
        return ids, np.concatenate([[0], end])[words.offsets.to_numpy() - words.offsets[0].as_py()]


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    """The worker's own, kept from task to task."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _cut(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the pieces of texts of so many tokens: full windows, then the rest."""
    n = -(-tokens // window)
    text = np.repeat(np.arange(len(tokens)), n)
    start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * window
    return text, start, np.minimum(window, tokens[text] - start)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end: int = END) -> DataFrame:
    """PIECE rows: `ids` are little-endian unsigned 32-bit numbers, `_nth` counts pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in batches:
            for first, data, offsets in string_chunks(b.column("text"), SLICE):
                ids, at = encoder.encode(data, offsets)
                tokens = np.diff(at) + 1
                whole = np.full(len(ids) + len(tokens), end, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(tokens)), tokens - 1)] = ids
                text, start, length = _cut(tokens, window)
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=window + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
                seen += counts
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(whole.astype("<u4"))])
                doc = b.column("doc_id").take(pa.array(text + first))
                columns = [doc, start, length, packed.cast(pa.binary()), tokens[text], np.full(len(text), part, np.int32), nth]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [f.split()[0] for f in PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes say if a leaf below holds any."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _set(self, room: int, some: bool) -> None:
        k = room + self.size
        self.any[k] = some
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs.setdefault(room, []).append((first, n))
            self._set(room, True)

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        """Takes out (room, first window, windows), of the least room that is at least `length`."""
        k = length + self.size
        while not self.any[k]:
            while k & 1:  # a right child: what comes next is right of its parent
                k //= 2
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.size
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            self._set(room, False)
        return room, first, n


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where best-fit decreasing puts pieces of these lengths."""
    spans, open_, made = [], OpenWindows(window), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = open_.tightest(length)
            if found is None:
                n = -(-left // (window // length))
                found = (window, made, n)
                made += n
            room, first, n = found
            each = room // length  # the window just used is the tightest again, until it is too full
            for windows, copies in ((min(n, left // each), each), (1, left % each)):
                if not windows or not copies or not n or not left:
                    continue
                spans += [(length, rank + i * windows, windows, first, window - room + i * length) for i in range(copies)]
                open_.put(room - copies * length, first, windows)
                rank, left, first, n = rank + copies * windows, left - copies * windows, first + windows, n - windows
            open_.put(room, first, n)
    return spans


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of `pieces` (with any columns more, or without ids) with `sequence_id` and `offset`."""
    spark = cut.sparkSession
    cut = stage(cut, "pieces")
    made = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    shift = made.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_shift"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # `window` rows at most
    schema = "length long, _first long, _ranks long, _sequence long, offset long"
    spans = F.broadcast(spark.createDataFrame(best_fit(counts, window), schema))  # their number depends on the window alone
    ranked = cut.join(shift, ["length", "_part"]).withColumn("_rank", F.col("_nth") + F.col("_shift"))
    placed = ranked.join(spans, "length").filter("_rank >= _first and _rank < _first + _ranks")
    kept = [c for c in cut.columns if not c.startswith("_")]
    return placed.select(*kept, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece."""
    return place(pieces(docs, tokenizer, window, end), window)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the sequence's ids in order; at most a window of pieces meet in a row."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    whole: Column = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", "n_tokens", whole.alias("ids"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in windows of 2048."""
    cut = pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
