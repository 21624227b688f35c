"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from arbora.llm import search

DOCS, ITEMS = "doc_id long, text string, score int", "item_id string, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def want(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for d, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            found += [(-score, d is not None, d or 0, d)] if score > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def check(spark, docs, items, k, **sizes):
    found = search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k, **sizes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in found.collect()) == want(docs, items, k)


def test_the_best_of_random_documents(spark):
    rng = random.Random(3)
    words = ["Äb", "c9", *"defghijklmnop", "ÜX", "x'y"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.choice([1, 2, 5, 40, 400])), 0) for i in range(300)]
    docs += [(i, docs[i][1], 0) for i in range(40)] + [(1000 + i, docs[0][1], 0) for i in range(60)]
    docs += [(2000, None, 0), (2001, "", 0), (2002, " .,-", 0), (None, docs[0][1], 0), (2003, "c9 " * 60_000, 0)]
    items = [(f"i{i}", text(rng.choice([1, 3, 30]))) for i in range(25)] + [("none", None), ("empty", ""), ("other", "zzz"), (None, "c9"), ("twice", "c9 c9 D"), ("twice", "c9 c9 D")]
    for k, shard in ((1, 7), (5, 64), (1000, 4096)):
        check(spark, docs, items, k, shard=shard)
    check(spark, docs, items, 5, block=300)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", 0)], DOCS), spark.createDataFrame([("i", "a")], ITEMS)
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, spark.createDataFrame([("i", "...")], ITEMS)).count() == 0


def test_a_node_bounds_what_lies_below_it_and_most_stay_shut():
    rng = np.random.default_rng(1)
    n_docs, n_terms = 1000, 20
    pairs = np.unique(rng.integers(0, n_docs * n_terms, 6000))
    doc, term = pairs % n_docs, pairs // n_docs
    impact = (rng.pareto(1.0, len(pairs)) * 100).astype(np.int64) + 1
    tree = search.DualSorted(term, doc, impact, n_docs)
    queries = [(np.sort(rng.choice(n_terms, 3, replace=False)), rng.integers(1, 9, 3)) for _ in range(10)]
    score = np.zeros((len(queries), n_docs), np.int64)
    for q, (t, w) in enumerate(queries):
        for a, b in zip(t, w):
            np.add.at(score[q], doc[term == a], b * impact[term == a])
    nodes = search.roots(tree, queries)
    while len(nodes.query):
        for q, level, prefix, bound in zip(nodes.query, nodes.level, nodes.prefix, nodes.bound):
            width = tree.levels - level
            below = score[q, prefix << width : (prefix + 1) << width]
            assert bound == below.max() if level == tree.levels else bound >= below.max()
        nodes = search.expand(tree, nodes.take(nodes.level < tree.levels)) if (nodes.level < tree.levels).any() else nodes.take(nodes.level < 0)
    best = search.Best(len(queries), 5)
    opened = search.best_first(tree, np.arange(n_docs), queries, best, beam=1, growth=1)
    assert opened < 0.1 * len(queries) * n_docs
    for q in range(len(queries)):
        assert best.score[best.query == q].tolist() == sorted(score[q][score[q] > 0], reverse=True)[:5]
