"""The queries of trained models and the pipeline as a whole: every row, columns and types, held-out folds, odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from arbora.llm import crf, toxicity
from brute import near_duplicates

SF = "/root/testdata/sf0.001"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def save(df, folder, name):
    """One Parquet file, as the tables are."""
    df.coalesce(1).write.parquet(f"{folder}/{name}-made")
    (part,) = (folder / f"{name}-made").glob("*.parquet")
    part.rename(folder / f"{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with nulls, empty, long and repeated texts, repeated and null ids, and columns of clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    ids = [r[0] for r in rows]
    rows += [(10**6, None, "en", "src0", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, " \t\n", "en", "src0", 3), (10**6 + 3, "long words here " * 50_000, "en", "src0", 1), (None, "a text without an id of its own", "en", "src1", 4)]
    rows += rows[:3] + [(ids[0], "another text of the first id, which is there twice", "en", "src2", 5)]
    wide = spark.createDataFrame([(*r, 0.5, "t", 1, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, shard int, _y int")
    save(wide, folder, "documents")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    save(labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(ids[0], None, None), (-5, 1, 1), (None, 1, 1)], labels.schema)), folder, "labels")
    save(spark.read.parquet(f"{SF}/benchmark.parquet"), folder, "benchmark")
    return folder


@pytest.mark.parametrize("module,n,out,label", [(toxicity, 5, 0, "toxic"), (crf, 3, 1, "quality")])
def test_scores_of_every_row(spark, odd, module, n, out, label):
    for sf in (SF, str(odd)):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        got = module.digest(spark, sf)
        assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        rows = got.collect()
        model = module.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
        want = model.scores([t or "" for _, t in docs])
        assert sorted(map(repr, ((r.doc_id, round(r.score, 5)) for r in rows))) == sorted(map(repr, ((d, round(float(s), 5)) for (d, _), s in zip(docs, want))))
        for r in rows:
            assert r.held_out == (r.doc_id is not None and fold(r.doc_id, n) == out)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert [r.score for r in rows if r.doc_id in (10**6, 10**6 + 1, 10**6 + 2)] == [0, 0, 0]


@pytest.mark.parametrize("module,n,out,label", [(toxicity, 5, 0, "toxic"), (crf, 3, 1, "quality")])
def test_held_out_labels_change_nothing(spark, module, n, out, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = module.train(docs, labels)
    told = [tuple(r) for r in labels.collect()]
    flipped = spark.createDataFrame([(d, 1 - q, 1 - t) if fold(d, n) == out else (d, q, t) for d, q, t in told], labels.schema)
    texts = [r.text for r in docs.select("text").limit(40).collect()]
    assert np.array_equal(one.scores(texts), module.train(docs, flipped).scores(texts))


@pytest.mark.parametrize("module", (toxicity, crf))
def test_without_rows_or_labels(spark, odd, tmp_path, module):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    save(docs.limit(0), tmp_path, "documents")
    save(spark.read.parquet(f"{odd}/labels.parquet").limit(0), tmp_path, "labels")
    assert module.digest(spark, str(tmp_path)).count() == 0
    (tmp_path / "some").mkdir()
    save(docs.filter("doc_id >= 1000000").select("doc_id", "text"), tmp_path / "some", "documents")
    save(spark.read.parquet(f"{odd}/labels.parquet").limit(0), tmp_path / "some", "labels")
    got = {r.doc_id - 10**6: r.score for r in module.digest(spark, str(tmp_path / "some")).collect()}
    assert got == ({0: 0, 1: 0, 2: 0, 3: 0} if module is toxicity else {0: 0, 1: 0, 2: 0, 3: 1})


def test_cross_validation_tells_settings_apart(spark):
    from arbora.llm.samples import fold as column
    from arbora.llm.samples import labelled
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled(docs, labels, "toxic", column(F.col("doc_id"), 5) != 0, 60)
    loss = toxicity.choose(sample, (toxicity.WORDS,), (toxicity.RARE, 0.3), 0.1)
    assert all(np.isfinite(v) and v > 0 for v in loss.values()) and len(loss) == 2


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_the_pipeline_as_a_whole(spark, odd):
    """Each stage against a plain version of it over what its predecessor kept, then all of them in a row."""
    import corpus_pipeline as pipeline

    sf = str(odd)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = lambda df: Counter(map(repr, df.collect()))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    before = docs.collect()
    scores = model.scores([r.text or "" for r in before])
    clean = pipeline.drop_toxic(spark, docs, sf)
    assert clean.schema == docs.schema and plain(clean) == Counter(repr(r) for r, s in zip(before, scores) if s < 0.5)

    rows = clean.collect()
    found = near_duplicates([(-1 if r.doc_id is None else r.doc_id, r.text) for r in rows], pipeline.NEAR)
    few = pipeline.drop_near_duplicates(spark, clean, sf)
    kept = few.collect()
    assert few.schema == docs.schema and not Counter(map(repr, kept)) - Counter(map(repr, rows))
    with_id = lambda ids: sorted({i for i in ids if i is not None and i != -1})
    assert with_id(r.doc_id for r in kept) == with_id(f[2] for f in found)

    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    unseen = pipeline.drop_contaminated(spark, few, sf)
    assert unseen.schema == docs.schema and plain(unseen) == Counter(repr(r) for r in kept if not hit(r.text))

    mixed = pipeline.mix_sources(spark, unseen, sf)
    assert mixed.schema == docs.schema and set(map(repr, mixed.collect())) <= set(map(repr, unseen.collect()))
    out = pipeline.run(spark, sf)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    left = lambda r: repr([r[c] for c in docs.columns if c != "shard"])
    assert Counter(map(left, got)) == Counter(map(left, mixed.collect()))
    shards = Counter(r["shard"] for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert sorted((r["shard"], r.slot) for r in got) == [(s, i) for s in sorted(shards) for i in range(shards[s])]


def test_the_pipeline_over_no_rows(spark, odd, tmp_path):
    import corpus_pipeline as pipeline

    save(spark.read.parquet(f"{odd}/documents.parquet").limit(0), tmp_path, "documents")
    for name in ("labels", "benchmark"):
        save(spark.read.parquet(f"{odd}/{name}.parquet"), tmp_path, name)
    assert pipeline.run(spark, str(tmp_path)).count() == 0
