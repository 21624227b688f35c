"""Packing against whole-text encoding and piece-by-piece best fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from arbora.llm import packing

ODD = [None, "", " ", "it's we'll 'S x's''s ''s .'s a.'t don't's", "Éa≠b.é ÀÉ ΑΣ Σ", "a1b22 c,d\tx\x0by\x1cz\x85w v\n\nend", "<|endoftext|>x <|startoftext|> <|END|>", "\x01 \x01", "Word " * 5000, "x" * 9000, "İI ß ﬁ", "😀a b😀.", "١٢٣ a١b"]


def want(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check(rows, texts, window):
    """rows: of pack. Every id once and in place, sequences without gaps or overflow."""
    ids = want([t for _, t in texts])
    cut = sorted((r.doc_id, r.doc_tokens, r.start, bytes(r.ids)) for r in rows)
    assert cut == sorted((d, len(x), s, np.array(x[s : s + window], "<u4").tobytes()) for (d, _), x in zip(texts, ids) for s in range(0, len(x), window))
    seqs = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return seqs


def test_every_id_lies_in_one_piece(spark):
    texts = list(enumerate(ODD)) + [(3, ODD[3]), (9, ODD[9])]
    docs = spark.createDataFrame([(d, t, 7) for d, t in texts], "doc_id long, text string, length long").repartition(3)
    for window in (7, 64, 2048):
        packed = packing.pack(docs, window=window)
        rows = packed.collect()
        seqs = check(rows, texts, window)
        whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
        assert {k: r.n_tokens for k, r in whole.items()} == {k: sum(n for _, n in v) for k, v in seqs.items()}
        assert all(bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_the_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    seqs = check(rows, docs, 2048)
    got = packing.digest(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.collect()) == Counter((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in rows)
    # as many sequences as one piece after another, and hardly any padding
    assert len(seqs) == max(s for s, _ in one_by_one([r.length for r in rows], 2048)) + 1
    assert len(seqs) * 2048 <= 1.02 * sum(r.length for r in rows) + 2048


def one_by_one(lengths, window):
    """(sequence, offset) of each length in descending order, into the tightest window that it fits."""
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fit = min((r, i) for i, r in enumerate([*rooms, window]) if r >= n)[1] if any(r >= n for r in rooms) else len(rooms)
        if fit == len(rooms):
            rooms.append(window)
        out.append((fit, window - rooms[fit]))
        rooms[fit] -= n
    return out


def test_runs_of_equal_lengths_go_where_single_pieces_would():
    rng = random.Random(5)
    for window in (1, 2, 10, 50, 333):
        for _ in range(40):
            lengths = [rng.choice([rng.randint(1, window), max(1, window // rng.randint(1, 5))]) for _ in range(rng.randint(0, 150))]
            counts = Counter(lengths)
            spans = packing.best_fit(counts, window)
            got = defaultdict(list)
            for n, first, ranks, sequence, offset in spans:
                got[n] += [(first + i, sequence + i, offset) for i in range(ranks)]
            assert {n: sorted(r for r, *_ in v) for n, v in got.items()} == {n: list(range(c)) for n, c in counts.items()}
            # which of two windows of equal room is taken is free: the rooms found must be the same, and so the loads
            plain = one_by_one(lengths, window)
            assert Counter((n, o) for n, v in got.items() for _, _, o in v) == Counter((n, o) for n, (_, o) in zip(sorted(lengths, reverse=True), plain))
            load = Counter()
            for n, v in got.items():
                for _, s, o in v:
                    load[s] += n
            used = Counter()
            for n, (s, _) in zip(sorted(lengths, reverse=True), plain):
                used[s] += n
            assert Counter(load.values()) == Counter(used.values())


def test_spans_do_not_grow_with_the_corpus():
    rng = random.Random(1)
    shape = {n: rng.randint(1, 50) for n in range(1, 2049)}
    few, many = (len(packing.best_fit({n: k * c for n, c in shape.items()})) for k in (20, 20_000_000))
    assert many < 1.2 * few < 60_000
