import random

import pytest
from pyspark.sql import functions as F

from arbora.llm import neardup
from brute import near_duplicates


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice((1, 1, 2, 4, 90))):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w).title()))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "one two"), (n + 5, "one two")]
    return rows


@pytest.mark.parametrize("leaf", (64, 4))
def test_components_equal_those_of_all_pairs(spark, corpus, leaf, monkeypatch):
    """A small leaf makes classes roam through the blocks of crowded nodes."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(docs)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in got.collect())
    assert rows == sorted(near_duplicates(corpus))


def test_one_document_of_each_component_stays_with_its_columns(spark, corpus):
    docs = spark.createDataFrame([(*r, "x", 1) for r in corpus], "doc_id long, text string, fp string, n int")
    kept = neardup.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp", "n"]
    want = {r[2] for r in near_duplicates(corpus)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_no_rows(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def close():
    """Pairs with a similarity from 0.80 to 0.849, such as 96 common shingles of 120, and some on either side."""
    rng = random.Random(8)
    rows = []
    for i, k in enumerate((7, 8, 9, 10, 11, 12, 13) * 6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-k] + [f"x{j}" for j in range(k)]))]
    return rows


@pytest.mark.parametrize("threshold,leaf", ((80, 64), (80, 4), (85, 64)))
def test_the_threshold_is_the_callers(spark, close, threshold, leaf, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    got = neardup.near_duplicates(spark.createDataFrame(close, "doc_id long, text string"), threshold).collect()
    want = near_duplicates(close, threshold)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in got) == sorted(want)
    assert len({r[2] for r in near_duplicates(close, 80)}) < len({r[2] for r in near_duplicates(close, 85)})


def test_the_pipeline_links_from_080_on(spark, close):
    import corpus_pipeline

    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(close, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in near_duplicates(close, 80)})


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_of_like_structure_are_told_apart(spark):
    """A Thue-Morse word and its complement collide under polynomial hashes modulo a power of two."""
    rows = [(2 * k + flip, thue_morse(n, flip)) for k, n in enumerate((1024, 4096)) for flip in (0, 1)]
    rows += [(10 + flip, "one two three four five six " + thue_morse(2048, flip)) for flip in (0, 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d for d, _ in rows}


def test_exact_sets_and_hashed_ones_agree(corpus):
    texts = [t or "" for _, t in corpus][:300] + ["", "a", "a b", "a  b", "a b c d e", "a b c d e f a b c d e", "é\u3000x y z w"]
    import pyarrow as pa

    hashed, exact = list(neardup.shingle_sets(pa.array(texts))), neardup.exact_sets(texts)
    assert list(map(len, hashed)) == list(map(len, exact))
    for i in range(0, len(texts) - 1, 7):
        for j in range(i, len(texts), 11):
            assert neardup.common(hashed[i], hashed[j]) == neardup.common(exact[i], exact[j])


def template_texts(n, words=100, own=18):
    rng = random.Random(n)
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(base + [f"x{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_visits_of_a_crowded_node_without_links(spark, monkeypatch):
    """Texts of one template in several blocks, none linked but for some planted pairs: what blocks read, and the pairs that they
    compare, don't outgrow the texts. Blocks are small here, so that the least size already fills many."""
    monkeypatch.setattr(neardup, "WIDE", 4)
    seats, work = [], []
    real = neardup._run_blocks

    def counting(df, kind, limits):
        df = df.cache()
        each = df.groupBy("grp").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
        if kind is neardup._Candidates:
            seats.append(df.count())
            work.append(each.agg(F.coalesce(F.sum(F.expr("h * (h + g)")), F.lit(0))).first()[0])
        return real(df, kind, limits)

    monkeypatch.setattr(neardup, "_run_blocks", counting)
    for n in (4000, 8000, 16_000):
        texts = template_texts(n)
        texts += [(n + i, texts[i][1] + " end") for i in range(0, n, 400)]
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert got == {d: d - n if d >= n else d for d, _ in texts}
    assert seats[1] < 2.3 * seats[0] + 100 and seats[2] < 2.3 * seats[1] + 100, seats
    assert work[1] < 2.3 * work[0] + 1000 and work[2] < 2.3 * work[1] + 1000, work


@pytest.mark.parametrize("threshold", (60, 80, 85, 100))
def test_what_is_hopeless_has_no_link(spark, threshold):
    """Families of every closeness: no set that has a partner is left out, and unlike ones mostly are."""
    rng = random.Random(threshold)
    texts = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(rng.choice([6, 30, 90]))]
        for _ in range(25):
            words = [w if rng.random() > rng.choice([0, 0.002, 0.01, 0.03]) else f"x{rng.randrange(10**6)}" for w in base]
            texts.append(" ".join(words[rng.choice([0, 0, 1, 2]) :] + ["end"] * rng.choice([0, 0, 1, 9])))
    texts = list(dict.fromkeys(texts)) + [" ".join(f"y{rng.randrange(10**9)}" for _ in range(50)) for _ in range(50)]
    import pyarrow as pa

    sets = list(neardup.shingle_sets(pa.array(texts)))
    linked = {i for i in range(len(texts)) for j in range(len(texts)) if i != j and neardup._reaches(sets[i], sets[j], threshold)}
    rows = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "fp binary, text string")
    alive = {int(bytes(r.fp)): bytes(r.part) for r in neardup._reachable(rows, threshold).collect()}
    assert linked <= set(alive) and (linked or threshold == 100)
    assert all(alive[i] == alive[j] for i in linked for j in linked if i < j and neardup._reaches(sets[i], sets[j], threshold))
    assert not [i for i in alive if i >= len(texts) - 50]


@pytest.mark.parametrize("wide", (1, 16))
def test_visitors_meet_every_block(spark, corpus, wide, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "WIDE", wide)
    got = neardup.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in got.collect()) == sorted(near_duplicates(corpus))


def test_long_texts_and_rows_that_differ_elsewhere(spark):
    long_ = " ".join(f"w{i % 50_000}" for i in range(200_000))
    rows = [(1, long_, "a"), (2, long_ + " end", "b"), (3, "x y z", "a"), (3, "x y z", "b"), (3, "x y z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    first, again = (sorted((r.doc_id, r["_key"]) for r in neardup.keep_one(docs.repartition(n)).collect()) for n in (1, 4))
    assert first == again and [d for d, _ in first] == [1, 3]
