import random

import pytest

from arbora.llm import repeats
from brute import repeats as by_hand


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [noise(rng.choice((150, 199, 200, 201, 260, 700))) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [noise(rng.randint(0, 300)), rng.choice(passages)] if rng.random() < 0.6 else [noise(rng.randint(0, 500))]
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "Ha " * 400), (203, "Ha " * 60), (204, rows[3][1]), (204, rows[3][1]), (205, "x" * 250)]
    return rows


@pytest.mark.parametrize("crowd", (512, 3))
def test_every_repeated_byte_goes(spark, corpus, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    rows = repeats._with_spans(docs, False).mapInArrow(repeats._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert sorted(map(tuple, rows.collect())) == sorted(by_hand(corpus))


def test_the_first_copy_stays(spark, corpus):
    corpus = [r for r in corpus if r[0] != 204]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    keys = [r.k for r in docs.select(repeats.row_key().alias("k")).collect()]
    order = sorted(range(len(corpus)), key=lambda i: keys[i])
    rows = repeats._with_spans(docs, True).mapInArrow(repeats._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert sorted(map(tuple, rows.collect())) == sorted(by_hand(corpus, keep_first=order))


def test_no_rows(spark):
    assert repeats.strip_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("crowd", (0, 2))
def test_crowded_cores_are_decided_window_by_window(spark, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = noise(230)
    rows = [(i, noise(rng.randint(0, 30)) + core + noise(rng.randint(0, 30))) for i in range(30)]
    rows += [(50, "ab" * 300), (51, "ab" * 200), (52, noise(400)), (52, rows[0][1])]
    digest = lambda first: repeats._with_spans(spark.createDataFrame(rows, "doc_id long, text string"), first).mapInArrow(
        repeats._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    assert sorted(map(tuple, digest(False).collect())) == sorted(by_hand(rows))
    keys = [r.k for r in spark.createDataFrame(rows, "doc_id long, text string").select(repeats.row_key().alias("k")).collect()]
    order = sorted(range(len(rows)), key=lambda i: keys[i])
    assert sorted(map(tuple, digest(True).collect())) == sorted(by_hand(rows, keep_first=order))


def test_previous_and_next_factors_by_enumeration():
    rng = random.Random(6)
    core = bytes(rng.choices(b"xyz", k=260))
    pieces = [core[:230], core, core[20:], bytes(rng.choices(b"xyz", k=250)), core[5:240], b"q" * 300]
    windows = [[p[i : i + 200] for i in range(len(p) - 199)] for p in pieces]
    flat = [w for ws in windows for w in ws]
    before, after = repeats.factors(pieces)
    at = 0
    for ws, x, y in zip(windows, before, after):
        for w, got, other in zip(ws, x, y):
            assert (got == 200) == (w in flat[:at]) and (other == 200) == (w in flat[at + 1 :])
            at += 1


def test_suffix_arrays_of_many_suffixes():
    """Ranks need more bits than there are windows; sorted windows must lie in byte order."""
    import numpy as np

    rng = random.Random(9)
    data = bytes(rng.choices(b"ab", k=40_000))
    place = np.arange(0, len(data) - 200, 37)
    order, agrees = repeats.suffix_array(np.frombuffer(data + bytes(256), np.uint8), len(data), place)
    want = sorted(range(len(place)), key=lambda i: (data[place[i] : place[i] + 200], i))
    assert order.tolist() == want and not agrees.any()


def test_the_arrays_decide_everything(spark, corpus, monkeypatch):
    """Without what the suffix array says nothing goes, whole copies included."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    import numpy as np

    blind = lambda pieces: tuple([np.zeros(len(p) - 199, np.int16) for p in pieces] for _ in range(2))
    monkeypatch.setattr(repeats, "_compare", lambda first, real=repeats._compare: _with_factors(real(first), blind))
    assert repeats._with_spans(docs, False).filter("spans is not null").count() == 0


def _with_factors(run, factors):
    """run with its module's factors replaced, also in worker processes."""

    def other(batches):
        run.__globals__["factors"] = factors
        yield from run(batches)

    return other


def test_long_texts_clashing_columns_and_cut_characters(spark):
    rng = random.Random(5)
    long_ = "".join(rng.choices("abcdefghij é", k=1_000_000))
    rows = [(1, long_, "h", 1), (2, "start " + long_[400_000:400_300] + " end", "own", 2), (3, "é" * 150, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, at int")
    got = {r.doc_id: r.n_removed for r in repeats._with_spans(docs, False).mapInArrow(repeats._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()}
    size = len(long_[400_000:400_300].encode())
    assert got == {1: size, 2: size, 3: 300}
    kept = {r.doc_id: r.text for r in repeats.strip_repeats(docs).collect()}
    assert sum("start  end" == t for t in kept.values()) + (len(kept[1]) < len(long_)) == 1
