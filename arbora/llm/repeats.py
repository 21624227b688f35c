"""Suffix-array deduplication of passages by longest-previous-factor arrays.

A byte is removed if a LENGTH-byte string that covers it also starts somewhere else, in any document or in its own.

Sharding the suffixes. Every LENGTH-byte window names one anchor, the ANCHOR-gram of least hash in it (leftmost of equal
ones). That depends on the window's bytes alone, so equal windows have equal anchors. Consecutive windows with one
anchor form a segment, the unit that is shuffled: its anchor's hash, 128 bits of BLAKE2 of its bytes, and its place. Anchors
that occur once are dropped. Segments of equal bytes are one kind; of each kind the bytes of the first occurrence, and
of a second one if there is any, go to the block of their anchor.

In a block the suffix array of all pieces, truncated at LENGTH, is built by prefix doubling, exactly and without hashes;
suffixes that agree in LENGTH bytes lie in the order of their places. So a window's previous smaller place in suffix
order with a common prefix of LENGTH is its neighbour, if any: its longest previous factor reaches LENGTH there and
nowhere else. The next one shows the same for later copies. These arrays alone decide what goes; what they say of a
kind holds for all its occurrences.

Anchors with more than CROWD kinds are split by content, so that no group meets in one task. Equal windows lie equally
far before their anchor, and all windows of a band of BAND such distances share a core of LENGTH - BAND + 1 bytes; so a
crowded segment is cut into its bands, and bands of equal cores form the next blocks. Should more than CROWD kinds of
bands share a core, their single windows are the pieces, and blocks those of equal windows.

keep_first: of each repeated string the occurrence in the row of least key (hash of id and text) stays, and of those within
a row the first; else all go. A null text is empty, a text of any length is cut in one pass. Rows equal in id and text are
two documents, so that their texts of LENGTH bytes or more are repeats; they get equal results. Extra columns don't
matter; no rows, no result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.bytework import prefix_sums, range_hash, spread, string_chunks
from arbora.llm.common import row_key, table
from arbora.staging import discard, stage

LENGTH, ANCHOR, CROWD, BAND, BLOCK_BYTES = 200, 64, 512, 16, 1 << 20
REACH = LENGTH - ANCHOR + 1
_ITEM = "h long, own binary, c long, m long, key binary, at int, piece binary"
_RANGE = "h long, own binary, second boolean, a int, b int"


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _content(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in row, windows, anchor hash, begin and end in data) of every segment of the texts."""
    lengths = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not lengths.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none, none
    sums = prefix_sums(data)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = range_hash(sums, at, at + ANCHOR)
    least = _window_minimum((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), REACH)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    start = offsets[:-1][row] + place
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[new, len(row)])
    begin = start[new]
    return row[new], place[new], n, grams[anchor[new]], begin, begin + n - 1 + LENGTH


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, data, offsets in string_chunks(b.column("text")):
            row, place, n, h, begin, end = segments(data, offsets)
            keys = b.column("key").take(pa.array(first + row))
            cols = [pa.array(h.view(np.int64)), pa.array(_content(data, begin, end), pa.binary()), keys, pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "own", "key", "at", "n"])


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, segs) rows -> one row for each segment with its bytes."""
    for b in batches:
        rows = []
        for key, text, segs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("segs").to_pylist()):
            raw = (text or "").encode()
            rows += [(s["h"], s["own"], s["c"], s["m"], key, s["at"], raw[s["at"] : s["at"] + s["n"] - 1 + LENGTH]) for s in segs]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["h", "own", "c", "m", "key", "at", "piece"])


def _ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def _three(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Numbers in the order of three ranks; places that lie past the end count as 0."""
    n = len(first)
    bits = np.uint64(int(max(x.max(initial=0) for x in (first, second, third))).bit_length())
    pad = lambda x: np.r_[x, np.zeros(n - len(x), np.uint64)] if len(x) < n else x
    if 3 * int(bits) <= 64:
        return (((first << bits) | pad(second)) << bits) | pad(third)
    return (_ranked((first << bits) | pad(second)) << bits) | pad(third)


def suffix_array(data: np.ndarray, n: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into place in the order of the LENGTH bytes from there, ties by place; whether each agrees with the one
    before in all of them). data: n bytes and 256 zeros."""
    packed = np.lib.stride_tricks.sliding_window_view(data, 8)[: n + 248].copy().view(">u8").ravel()
    rank = _ranked(packed)
    for width in (8, 24):  # ranks by the first 24 bytes, then 72
        rank = _ranked(_three(rank, rank[width:], rank[2 * width :]))
    key = _three(*(rank[place + (LENGTH - 72) // 2 * i] for i in range(3)))
    order = np.argsort(key, kind="stable")
    return order, np.r_[False, key[order][1:] == key[order][:-1]]


def factors(pieces: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each window of each piece its longest previous factor and longest next factor, LENGTH or 0 for less, places
    being in the given order."""
    sizes = np.array([len(p) for p in pieces])
    counts = sizes - LENGTH + 1
    begins = np.cumsum(sizes) - sizes
    place = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order, agrees = suffix_array(np.frombuffer(b"".join(pieces) + bytes(256), np.uint8), int(sizes.sum()), place)
    previous, following = np.zeros(len(place), np.int16), np.zeros(len(place), np.int16)
    previous[order[agrees]] = LENGTH  # the previous smaller place is the neighbour
    following[order[np.r_[agrees[1:], False]]] = LENGTH
    cuts = np.cumsum(counts)[:-1]
    return np.split(previous, cuts), np.split(following, cuts)


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return [(int(a), int(b) - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2])]


def _compare(keep_first: bool):
    """Kinds of whole groups (h), sorted by h, key, at -> removed ranges of each kind's first occurrence and of all further
    ones. Groups may span batches, blocks hold whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group, size = [], [], 0

        def close() -> None:
            block.extend((r, False) for r in group)
            block.extend((r, True) for r in group if r[2] > 1)  # second occurrences lie behind all first ones
            group.clear()

        def solve() -> pa.RecordBatch:
            previous, following = factors([r[3] for r, _ in block])
            out = []
            for (r, second), before, after in zip(block, previous, following):
                if keep_first:
                    out += [(r[0], r[1], second, a, b) for a, b in _ranges(before == LENGTH)]
                elif not second:
                    found = _ranges((before == LENGTH) | (after == LENGTH))
                    out += [(r[0], r[1], s, a, b) for s in (False, True)[: 1 + (r[2] > 1)] for a, b in found]
            block.clear()
            kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["h", "own", "second", "a", "b"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "own", "c", "piece"))):
                if group and group[0][0] != r[0]:
                    close()
                    if size >= BLOCK_BYTES:
                        yield solve()
                        size = 0
                group.append(r)
                size += len(r[3]) * (1 + (r[2] > 1))
        close()
        if block:
            yield solve()

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of crowded anchors (their first and second occurrences), cut where the distance to the anchor passes a
    multiple of BAND; g is the hash of anchor, band and core."""
    for b in batches:
        out = []
        for h, own, c, key, at, piece in zip(*(b.column(x).to_pylist() for x in ("h", "own", "c", "key", "at", "piece"))):
            data = np.frombuffer(piece, np.uint8)
            sums = prefix_sums(data)
            begin = np.arange(REACH)
            grams = range_hash(sums, begin, begin + ANCHOR)
            anchor = int(np.argmin(grams >> np.uint64(32)))
            band = (anchor - np.arange(len(data) - LENGTH + 1)) // BAND
            first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            n = np.diff(np.r_[first, len(band)])
            core = anchor - band[first] * BAND
            cores = range_hash(sums, core, core + LENGTH - BAND + 1)
            group = spread(cores + spread(np.uint64(h & (1 << 64) - 1) + band[first].astype(np.uint64)))
            owns = _content(data, first, first + n - 1 + LENGTH)
            for second in (False, True)[: 1 + (c > 1)]:
                for g, o, f, k in zip(group.view(np.int64).tolist(), owns, first.tolist(), n.tolist()):
                    out.append((g, o, h, own, second, key, at + f, f, piece[f : f + k - 1 + LENGTH]))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _PART_NAMES)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of kinds of crowded cores, g being the hash of its bytes."""
    for b in batches:
        out = []
        for h, own, c, key, at, piece in zip(*(b.column(x).to_pylist() for x in ("h", "own", "c", "key", "at", "piece"))):
            begin = np.arange(len(piece) - LENGTH + 1)
            for i, o in enumerate(_content(np.frombuffer(piece, np.uint8), begin, begin + LENGTH)):
                g = int.from_bytes(o[:8], "little", signed=True)
                out += [(g, o, h, own, second, key, at + i, i, piece[i : i + LENGTH]) for second in (False, True)[: 1 + (c > 1)]]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _PART_NAMES)


_PART_NAMES = ["g", "part", "h", "own", "second", "key", "at", "off", "piece"]
_PART = "g long, part binary, h long, own binary, second boolean, key binary, at int, off int, piece binary"


def _decided(items: DataFrame, keep_first: bool, cuts=(_bands, _windows)) -> DataFrame:
    """Ranges (h, own, second, a, b) within the kinds of _ITEM rows. Groups of more than CROWD kinds are cut by cuts[0] and
    decided part by part; the parts of the last cut have groups of one kind."""
    few = items.filter(F.col("m") <= CROWD) if cuts else items
    few = few.select("h", "own", "c", "key", "at", "piece").repartition("h").sortWithinPartitions("h", "key", "at")
    ranges = few.mapInArrow(_compare(keep_first), _RANGE)
    if not cuts:
        return ranges
    parts = stage(items.filter(F.col("m") > CROWD).mapInArrow(cuts[0], _PART), "parts")
    place = F.struct("second", "key", "at")
    kinds = parts.groupBy("g", "part").agg(F.count("*").alias("c"), F.min(F.struct("second", "key", "at", "piece")).alias("one"))
    kinds = stage(kinds.select(F.col("g").alias("h"), F.col("part").alias("own"), "c", "one.second", "one.key", "one.at", "one.piece"), "part-kinds")
    within = stage(_decided(_shared(kinds), keep_first, cuts[1:]), "part-ranges")
    firsts = kinds.select("h", "own", place.alias("first"))
    told = within.join(firsts, ["h", "own"]).select(F.col("h").alias("g"), F.col("own").alias("part"), F.col("second").alias("later"), "a", "b", "first")
    up = parts.drop("piece").join(told, ["g", "part"]).filter(F.col("later") == (place != F.col("first")))
    return ranges.unionByName(up.select("h", "own", "second", (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b")))


def _shared(kinds: DataFrame) -> DataFrame:
    """Kinds of groups in which something can repeat, with m, the group's number of kinds."""
    groups = kinds.groupBy("h").agg(F.count("*").alias("m"), F.max("c").alias("most")).filter("m > 1 or most > 1")
    return kinds.join(groups.select("h", "m"), "h")


def removed_ranges(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """(key, s, e) byte ranges, possibly overlapping, for rows with (key, text)."""
    segs = stage(docs.mapInArrow(_cut, "h long, own binary, key binary, at int, n int"), "segments")
    # staged, so that the join's sides are plain shuffles, which adaptive execution can split
    twice = stage(segs.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "anchors")
    shared = stage(segs.join(twice, "h"), "shared")
    discard(segs)
    place = F.struct("key", "at")
    kinds = shared.groupBy("h", "own").agg(F.count("*").alias("c"), F.min(F.struct("key", "at", "n")).alias("first"))
    kinds = stage(kinds.select("h", "own", "c", "first.*"), "kinds")
    wanted = _shared(kinds).groupBy("key").agg(F.collect_list(F.struct("h", "own", "c", "m", "at", "n")).alias("segs"))
    cut = docs.join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "segs")
    pieces = stage(cut.mapInArrow(_slice, _ITEM), "pieces")
    told = stage(_decided(pieces, keep_first), "ranges")
    told = told.join(kinds.select("h", "own", place.alias("first")), ["h", "own"])
    hit = shared.join(stage(told, "told"), ["h", "own"]).filter(F.col("second") == (place != F.col("first")))
    return hit.select("key", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("b")).alias("e"))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _rest(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in cut)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in cut), len(raw)]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            raw, cut = (text or "").encode(), _merge(spans)
            rows.append((len(raw), sum(e - s for s, e in cut), len(cut), hashlib.sha256(_rest(raw, cut)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = [b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [_rest((t or "").encode(), _merge(s)).decode("utf-8", "replace") for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "text"])


def _with_spans(docs: DataFrame, keep_first: bool) -> DataFrame:
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    cut = removed_ranges(keyed.select("key", "text"), keep_first)
    spans = cut.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return keyed.join(spans, "key", "left").select("doc_id", "text", "spans")


def strip_repeats(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """(doc_id, text) with the repeats cut out; bytes of a cut character are replaced."""
    return _with_spans(docs, keep_first).mapInArrow(_texts, "doc_id long, text string")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False)
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5(b[i:i + {LENGTH - 1}]) AS h FROM (SELECT rid, b, unnest(range(1, n - {LENGTH - 2})) AS i FROM d WHERE n >= {LENGTH})),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
starts AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {LENGTH}, false) AS apart FROM w SEMI JOIN twice USING (h)),
runs AS (SELECT rid, min(i) AS s, max(i) + {LENGTH} AS e
  FROM (SELECT rid, i, count_if(apart) OVER (PARTITION BY rid ORDER BY i) AS k FROM starts) GROUP BY rid, k),
gaps AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 1) AS a, s - 1 AS z FROM runs
  UNION ALL SELECT rid, coalesce(max(e), 1), any_value(n) FROM d LEFT JOIN runs USING (rid) GROUP BY rid),
kept AS (SELECT rid, sha256(unhex(string_agg(CASE WHEN a <= z THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a))) AS kept_sha256 FROM gaps JOIN d USING (rid) GROUP BY rid),
gone AS (SELECT rid, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN gone USING (rid)
"""
