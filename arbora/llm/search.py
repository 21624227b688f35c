"""Exact ranked search with dual-sorted wavelet trees.

The inverted lists of a shard of documents, each in falling order of impact, stand one after another as one sequence of
document numbers, and a wavelet tree over the numbers holds that sequence: a node stands for a range of documents, and
what a list has there is a run of the node's sequence that is still in falling order of impact. The first posting of
each run thus bounds what any document below the node can score. The search expands nodes in falling order of bound, up to BEAM of
a query at once, and drops those whose bound is below the k-th best score so far; a leaf's bound is its score. Shards of
one task share that k-th score, tasks return their k best of each item, and Spark ranks those.

One pass over the texts counts terms and keeps the postings of the items' terms; the counts of documents and occurrences come
from what it has written. Items are taken in blocks of about BLOCK bytes, so what tasks get with their code is bounded.

Terms are `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of the whole text, A-Z lower-cased. A null or empty text has no terms; it is
never found and not counted. Repeated items are answered once, those without terms have no rows; repeated documents are found as
often as they are there. Equal scores go by doc_id, null first (as which the least long counts, too); a text of any length is
one document; extra columns don't matter; no documents or items, no result.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.bytework import string_chunks
from arbora.llm.common import table
from arbora.staging import stage

TOP, SHARD, BEAM, BLOCK, SLICE = 20, 4096, 16, 8 << 20, 8 << 20
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
NONE = np.iinfo(np.int64).min

#: What a byte of a text is in its terms: itself in lower case, or a space between terms.
TERM = np.full(256, 32, np.uint8)
for _kept in (range(48, 58), range(97, 123), range(128, 256)):
    TERM[_kept] = _kept
TERM[65:91] = np.arange(97, 123)


def split_terms(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, terms of each row, row of each word, words) of slices of a column; words may be empty."""
    for first, data, offsets in string_chunks(column, limit):
        said = TERM[data]
        begins = np.zeros(len(said) + 1, np.int64)
        begins[:-1] = said != 32
        begins[1:-1] &= said[:-1] == 32
        begins[offsets[:-1]] = np.append(said, 32)[offsets[:-1]] != 32
        n = np.diff(np.concatenate([[0], np.cumsum(begins[:-1])])[offsets])
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(said))
        words = pc.split_pattern(texts, " ")
        row = np.repeat(np.arange(len(n)), np.diff(words.offsets.to_numpy()))
        yield first, n, row, words.flatten()


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """POSTINGS rows: the number of a document's terms, and how often it has which of `terms` (by place in the list)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.large_string())
        size = len(sent.value)
        for b in batches:
            for first, n, row, words in split_terms(b.column("text")):
                which = pc.index_in(words, known)
                at = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
                pair, tf = np.unique(row[at] * size + which.drop_null().to_numpy(), return_counts=True)
                bounds = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * size), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (pair % max(size, 1), tf)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(n)), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


class DualSorted:
    """Inverted lists, each in falling order of impact, as one wavelet tree over documents 0 .. n_docs - 1.

    At a level the sequence is grouped by the leading bits of the document, lists in order within; zeros[level, i] counts next
    bits 0 before i, impact[level] is what each place has. A document occurs once in a list.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order].astype(np.uint16 if n_docs <= 1 << 16 else np.uint32), impact[order]
        self.terms, first = np.unique(term, return_index=True)
        self.bounds = np.append(first, len(term))
        self.levels = max(1, (n_docs - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=1 << self.levels))])
        self.zeros = np.zeros((self.levels, len(term) + 1), np.int32)
        self.impact = np.empty((self.levels + 1, len(term)), np.int64)
        for level in range(self.levels):
            self.impact[level] = impact
            prefix = doc >> (self.levels - 1 - level)
            np.cumsum(prefix & 1 == 0, out=self.zeros[level, 1:])
            order = np.argsort(prefix, kind="stable")
            doc, impact = doc[order], impact[order]
        self.impact[self.levels] = impact


def _ragged(counts: np.ndarray) -> np.ndarray:
    """Index of the owner of each element."""
    return np.repeat(np.arange(len(counts)), counts)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of the values of owners 0 .. n - 1, which are in order."""
    upto = np.concatenate([[0], np.cumsum(values)])
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return upto[bounds[1:]] - upto[bounds[:-1]]


class Frontier:
    """Nodes to expand: query, level, prefix, bound, and the runs of the query's lists there (weight, from, to)."""

    NODE, RUN = ("query", "level", "prefix", "bound"), ("weight", "first", "last")

    def __init__(self, **columns: np.ndarray):
        self.__dict__ |= columns  # `runs` counts the runs of a node

    def take(self, mask: np.ndarray) -> "Frontier":
        inner = np.repeat(mask, self.runs)
        return Frontier(**{c: getattr(self, c)[mask] for c in (*self.NODE, "runs")}, **{c: getattr(self, c)[inner] for c in self.RUN})

    def and_(self, other: "Frontier") -> "Frontier":
        return Frontier(**{c: np.concatenate([getattr(self, c), getattr(other, c)]) for c in (*self.NODE, "runs", *self.RUN)})


def roots(tree: DualSorted, queries: list[tuple[np.ndarray, np.ndarray]]) -> Frontier:
    """The whole tree for each query, given as its terms and their weights."""
    sizes = np.array([len(t) for t, _ in queries])
    term = np.concatenate([t for t, _ in queries])
    weight = np.concatenate([w for _, w in queries])
    at = np.minimum(np.searchsorted(tree.terms, term), len(tree.terms) - 1)
    there = tree.terms[at] == term
    query, weight, at = _ragged(sizes)[there], weight[there], at[there]
    runs = np.bincount(query, minlength=len(queries))
    bound = _sums(query, weight * tree.impact[0][tree.bounds[at]], len(queries))
    ids, zero = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    return Frontier(query=ids, level=zero, prefix=zero, bound=bound, runs=runs, weight=weight, first=tree.bounds[at], last=tree.bounds[at + 1]).take(runs > 0)


def expand(tree: DualSorted, nodes: Frontier) -> Frontier:
    """The children of nodes in which some list has a posting, with their bounds."""
    below = tree.levels - nodes.level
    start = np.repeat(tree.before[nodes.prefix << below], nodes.runs)
    middle = np.repeat(tree.before[(2 * nodes.prefix + 1) << (below - 1)], nodes.runs)
    level = np.repeat(nodes.level, nodes.runs)
    left = [tree.zeros[level, x] - tree.zeros[level, start] for x in (nodes.first, nodes.last)]
    owner = _ragged(nodes.runs)
    parts = []
    for bit, (a, b) in enumerate(((start + left[0], start + left[1]), (middle + nodes.first - start - left[0], middle + nodes.last - start - left[1]))):
        some = a < b
        who, first, weight = owner[some], a[some], nodes.weight[some]
        runs = np.bincount(who, minlength=len(nodes.runs))
        bound = _sums(who, weight * tree.impact[level[some] + 1, first], len(nodes.runs))
        child = Frontier(query=nodes.query, level=nodes.level + 1, prefix=2 * nodes.prefix + bit, bound=bound, runs=runs, weight=weight, first=first, last=b[some])
        parts.append(child.take(runs > 0))
    return parts[0].and_(parts[1])


class Best:
    """The k best (score, doc) of each query: higher scores first, then lower docs."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.ones(n, np.int64)  # what a document must score to count

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        query, score, doc = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = nth < self.k
        self.query, self.score, self.doc = query[kept], score[kept], doc[kept]
        last = nth == self.k - 1
        self.least[query[last]] = np.maximum(score[last], 1)


def best_first(tree: DualSorted, ids: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], best: Best, beam: int = BEAM, growth: int = 2) -> int:
    """Puts what this shard has of the best documents into `best`; returns how many nodes were expanded.

    Once the first leaves can have been reached, the beam grows with every round: fewer rounds for some nodes more.
    """
    todo, expanded, rounds = roots(tree, queries), 0, 0
    while len(todo.query):
        order = np.lexsort((-todo.bound, todo.query))
        query = todo.query[order]
        chosen = np.zeros(len(order), bool)
        chosen[order[np.arange(len(order)) - np.searchsorted(query, query) < beam]] = True
        expanded += int(chosen.sum())
        found = expand(tree, todo.take(chosen))
        found = found.take(found.bound >= best.least[found.query])
        leaf = found.level == tree.levels
        best.add(found.query[leaf], found.bound[leaf], ids[found.prefix[leaf]])
        todo = todo.take(~chosen).and_(found.take(~leaf))
        todo = todo.take(todo.bound >= best.least[todo.query])
        rounds += 1
        beam *= growth if rounds >= tree.levels else 1
    return expanded


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, among `docs` documents of `length` terms in all."""
    m = 75 + 25 * n * docs // length
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _rank_shards(spark: SparkSession, held: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], docs: int, length: int, k: int, shard: int) -> DataFrame:
    """(_item, doc_id, score): the k best documents of each query in each task."""
    sent = spark.sparkContext.broadcast(queries)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(len(asked), k)
        for whole in batches:
            for b in (whole.slice(i, shard) for i in range(0, whole.num_rows, shard)):
                lists = b.column("terms")
                doc = _ragged(np.diff(lists.offsets.to_numpy()))
                tf = b.column("tfs").flatten().to_numpy().astype(np.int64)
                if not len(tf):
                    continue
                n = b.column("n").to_numpy()[doc]
                tree = DualSorted(lists.flatten().to_numpy(), doc, impacts(tf, n, docs, length), b.num_rows)
                best_first(tree, b.column("doc_id").fill_null(int(NONE)).to_numpy(), asked, best)
        ids = pa.array(best.doc, mask=best.doc == NONE)
        yield pa.RecordBatch.from_arrays([pa.array(best.query.astype(np.int32)), ids, pa.array(best.score)], ["_item", "doc_id", "score"])

    return held.mapInArrow(run, "_item int, doc_id long, score long")


def _search_block(docs: DataFrame, items: list[tuple], kind, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    said = pa.array([t for _, t in items], pa.large_string())
    asked = [Counter() for _ in items]
    for first, _, row, words in split_terms(said):
        for r, w in zip(row.tolist(), words.to_pylist()):
            if w:
                asked[first + r][w] += 1
    terms = sorted({w for q in asked for w in q})
    held = stage(postings(docs, terms), "postings")
    total = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    found = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # at most the block's terms
    weight = {terms[r["t"]]: math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1))) for r in found}
    number = {w: i for i, w in enumerate(terms)}
    queries = []
    for q in asked:
        own = sorted((number[w], c * weight[w]) for w, c in q.items() if w in weight)
        queries.append((np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    best = _rank_shards(spark, held, queries, total["docs"], max(total["length"], 1), k, shard)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(items)], f"_item int, item_id {kind}")
    return best.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long) of the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").filter("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    kind, blocks, out = items.schema["item_id"].dataType.simpleString(), -(-size // block), None
    for i in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()  # about `block` bytes
        if some:
            found = _search_block(docs, [(r["item_id"], r["text"]) for r in some], kind, k, shard)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format('text')} AS w FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
q AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text, unnest({_TERMS.format('text')}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
i AS (SELECT rid, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.w) * docs) // length))) AS x FROM p JOIN w USING (term) JOIN d USING (rid), s),
f AS (SELECT item_id, text, rid, CAST(sum(c * x) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(c * x) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM f JOIN d USING (rid))
WHERE rank <= {TOP}
"""
