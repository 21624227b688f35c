"""Near-duplicate detection by a chosen-path set similarity join on 5-word shingles.

Equal sets become one class. A number of independent trees branch the classes by minwise tokens: at each level a class goes
to the child named by the token that the level's hash selects from its set, so two sets stay together with a
probability equal to their similarity. A node of at most LEAF classes, or one at the last level, is compared
exhaustively on sketches of one byte from each of SKETCH minwise hashes; pairs whose estimate lies within four deviations of the threshold
or above are confirmed on the full sets: first of hashes, then, if those reach it, of the words themselves.

Two passes keep the pairs few and lose no link: first the maximum spanning forest of each node of FIRST trees, which is
confirmed and turned into components; then, over the nodes of all trees that still hold two components, every pair
that crosses components. Those are confirmed where the two classes meet: classes that have a candidate in a block get their
texts sent there, and only confirmed links leave it, so that rows grow with the seats of classes, not with pairs. A
last-level node above LEAF is dealt into blocks; classes outside its largest component visit all of its blocks, so none is
compared with less than all others. A block's own classes, WIDE * LEAF of them or WEIGHT
shingles, are held, visitors stream past them.
Before that, classes of nodes that would need several blocks are held against each other by their rarest shingles
(`_reachable`): linked sets share one early in both, so a class none of whose early shingles another of fitting size has early
can have no link there and leaves the node, and those that such shingles connect are a node of their own. Texts around one template that aren't near-duplicates share the template's
shingles only, which are none of their rarest, so nothing is left of such a node, whatever its size; branching it further would leave
most of it together at each level.

The threshold is the caller's, in hundredths; the number of trees and the least estimate follow from it. Two sets of
similarity s meet in a leaf of level d of some of n trees with probability 1 - (1 - s^d)^n. n is the least that leaves at
most MISS to the last level (crowded nodes only) at the threshold: 12 trees at 0.85, 17 at 0.80.

A null or wordless text has an empty set and is linked with nothing. A text of any length is hashed in pieces, its set held
whole. Rows that repeat an id are judged by their own texts; rows equal in both are kept once, the one of least hash over
all columns. A null id is never the smallest. Extra columns don't matter; no rows, no result.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import row_key, small_batches, table
from arbora.llm.components import components
from arbora.llm.shingles import Minwise, common, exact_sets, shingle_sets
from arbora.staging import stage

THRESHOLD, LEVELS, LEAF, WIDE, WEIGHT, SKETCH, FIRST, MISS, PER_OCTAVE = 85, 4, 64, 64, 1 << 21, 384, 3, 2e-4, 32


class _Limits:
    """What follows from a threshold in hundredths."""

    def __init__(self, threshold: int):
        if not 0 < threshold <= 100:
            raise ValueError(f"threshold {threshold} is not in 1 to 100")
        share = threshold / 100
        self.threshold = threshold
        self.loose = share - 4 * (share * (1 - share) / SKETCH) ** 0.5
        self.trees = max(math.ceil(math.log(MISS) / math.log1p(-(share**LEVELS))), FIRST) if share < 1 else FIRST


def _describe(limits: _Limits):
    """A mapInArrow function: (doc_id, key, text) -> the row's set size, fingerprint, tokens of all trees and sketch."""
    steps = limits.trees * LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minwise = Minwise(max(SKETCH, steps))
        for b in batches:
            n, fp, tokens, sketch = [], [], [], []
            for s in shingle_sets(b.column("text")):
                n.append(len(s))
                if not len(s):
                    fp.append(None), tokens.append(None), sketch.append(None)
                    continue
                m = minwise(s)
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                tokens.append(m[:steps].view(np.int64))
                sketch.append((m[:SKETCH] >> np.uint64(32)).astype(np.uint8).tobytes())
            cols = [b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "fp", "tokens", "sketch"])

    return run


def _leaves(classes: DataFrame, trees: int) -> DataFrame:
    """(tree, path, size, weight, fp) of every node that is compared: its number of classes and shingles in all."""
    named = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.slice("tokens", t * LEVELS + 1, LEVELS).alias("steps")),
    )
    rows = classes.select("fp", "n", F.inline(named)).withColumn("path", F.lit(0).cast("long"))
    out = None
    for level in range(LEVELS):
        rows = rows.withColumn("path", F.xxhash64("path", F.col("steps")[level]))
        # staged, so that the join's sides are plain shuffles, which adaptive execution can split
        sizes = stage(rows.groupBy("tree", "path").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1"), "sizes")
        rows = rows.join(sizes, ["tree", "path"])
        last = level == LEVELS - 1
        done = rows if last else rows.filter(F.col("size") <= LEAF)
        done = done.select("tree", "path", "size", "weight", "fp", "n")
        out = done if out is None else out.unionByName(done)
        if not last:
            rows = stage(rows.filter(F.col("size") > LEAF).drop("size", "weight"), "branch")
    return out


def _similar(sketch: np.ndarray) -> np.ndarray:
    """Estimated similarity of each two rows, a row of the matrix at a time to bound memory."""
    return np.stack([(sketch == row).mean(axis=1, dtype=np.float32) for row in sketch])


def _forest(group: dict, loose: float) -> list[tuple[bytes, bytes]]:
    """Maximum spanning forest of the estimates."""
    fp, sim = group["fp"], _similar(group["sketch"])
    up, over = np.triu_indices(len(fp), 1)
    good = sim[up, over] >= loose
    up, over = up[good], over[good]
    root, out = list(range(len(fp))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.argsort(-sim[up, over], kind="stable"):
        a, b = find(up[k]), find(over[k])
        if a != b:
            root[a] = b
            out.append((fp[up[k]], fp[over[k]]))
            if len(out) == len(fp) - 1:
                break
    return out


def _meetings(left: list[dict], right: list[dict] | None, limits: _Limits) -> list[tuple[int, int]]:
    """(i, j) of candidates, the most similar first: different components, a high estimate, and no earlier tree or block
    in which the two meet. right: visitors of the block; None: pairs within left.

    A class's seat in a tree is its leaf and block; block -1 meets all blocks of the leaf.
    """
    within = right is None
    right = left if within else right
    (sk, leaf, block), (sk2, leaf2, block2) = _arrays(left, limits.trees), _arrays(right, limits.trees)
    comps = {c: i for i, c in enumerate({r["comp"] for r in (*left, *right)})}
    comp, comp2 = (np.array([comps[r["comp"]] for r in rows]) for rows in (left, right))
    own, roams = np.array([r["own"] for r in left]), np.array([r["roams"] for r in left])
    # of two different components at least one is not the largest; visitors are of none that is
    few = np.flatnonzero(comp != np.bincount(comp).argmax()) if within else np.arange(len(right))
    out = []
    for j in few:
        sim = np.count_nonzero(sk == sk2[j], axis=1) / sk.shape[1]
        ok = (sim >= limits.loose) & (comp != comp2[j])
        if within:
            ok[few[few <= j]] = False
        else:  # two that roam meet at home of the one with the lower block
            ok &= ~roams | (own < right[j]["own"])
        at = np.flatnonzero(ok)
        if len(at):
            meet = (leaf[at] == leaf2[j]) & (leaf2[j] != 0) & ((block[at] == block2[j]) | (block[at] < 0) | (block2[j] < 0))
            out += [(-sim[i], int(i), int(j)) for i in at[meet.argmax(axis=1) == right[j]["tree"]]]
    return [(i, j) for _, i, j in sorted(out)]


def _arrays(rows: list[dict], trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    leaf, block = np.zeros((len(rows), trees), np.int64), np.zeros((len(rows), trees), np.int64)
    for i, r in enumerate(rows):
        for s in r["seats"]:
            leaf[i, s["tree"]], block[i, s["tree"]] = s["leaf"], s["block"]
    return np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1), leaf, block


class _Candidates:
    """Keeps the seats of a block that have a candidate."""

    names = ["grp", "fp", "sketch", "comp", "tree", "seats", "home", "roams", "own"]
    ddl = "grp long, fp binary, sketch binary, comp binary, tree int, seats array<struct<tree:int,leaf:long,block:long>>, home boolean, roams boolean, own long"
    seat = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int64()), ("block", pa.int64())]))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), seat, pa.bool_(), pa.bool_(), pa.int64()]

    def __init__(self, limits: _Limits):
        self.limits = limits

    def open(self, home: list[dict]) -> list[tuple]:
        self.home, self.told = home, set()
        return self._rows(home, None)

    def visit(self, guests: list[dict]) -> list[tuple]:
        return self._rows(self.home, guests)

    def _rows(self, left: list[dict], right: list[dict] | None) -> list[tuple]:
        met = _meetings(left, right, self.limits)
        new = sorted(({i for i, _ in met} | ({j for _, j in met} if right is None else set())) - self.told)
        self.told |= set(new)
        rows = [left[i] for i in new] + ([right[j] for j in sorted({j for _, j in met})] if right else [])
        return [tuple(r[c] for c in self.names) for r in rows]


class _Links:
    """Confirms candidates of a block on the full sets; those already joined by confirmed links need no other."""

    names, ddl, kinds = ["u", "v"], "u binary, v binary", [pa.binary(), pa.binary()]

    def __init__(self, limits: _Limits):
        self.limits = limits

    def open(self, home: list[dict]) -> list[tuple]:
        self.home, self.root = home, {}
        self.sets = list(shingle_sets(pa.array([r["text"] for r in home], pa.large_string())))
        return self._rows(home, self.sets, None)

    def visit(self, guests: list[dict]) -> list[tuple]:
        return self._rows(guests, list(shingle_sets(pa.array([r["text"] for r in guests], pa.large_string()))), guests)

    def _find(self, x: bytes) -> bytes:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def _rows(self, right: list[dict], sets: list[np.ndarray], guests: list[dict] | None) -> list[tuple]:
        out = []
        for i, j in _meetings(self.home, guests, self.limits):
            a, b = self._find(self.home[i]["comp"]), self._find(right[j]["comp"])
            if a != b and _linked(self.sets[i], sets[j], self.home[i]["text"], right[j]["text"], self.limits.threshold):
                self.root[a] = b
                u, v = self.home[i]["fp"], right[j]["fp"]
                out.append((max(u, v), min(u, v)))
        return out


def _by_block(kind: type, limits: _Limits, guests_at_once: int = 256):
    """A mapInArrow function over rows sorted by grp, those at home first. Memory holds a block's home and some guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, last, home, guests, opened, out = kind(limits), None, [], [], False, []

        def flush() -> None:
            nonlocal opened, guests
            if home and not opened:
                out.extend(work.open(home))
                opened = True
            if home and guests:
                out.extend(work.visit(guests))
            guests = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kind.kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, kind.names)

        for b in batches:
            for i in range(0, len(b), guests_at_once):
                for r in b.slice(i, guests_at_once).to_pylist():
                    if r["grp"] != last:
                        flush()
                        last, home, opened = r["grp"], [], False
                    if r["home"]:
                        home.append(r)
                    else:
                        guests.append(r)
                        if len(guests) == guests_at_once:
                            flush()
            if out:
                yield batch()
        flush()
        if out:
            yield batch()

    return run


def _run_blocks(rows: DataFrame, kind: type, limits: _Limits) -> DataFrame:
    dealt = rows.repartition("grp").sortWithinPartitions("grp", F.desc("home"))
    return dealt.mapInArrow(_by_block(kind, limits), kind.ddl)


def _by_group(pick, loose: float):
    """A mapInArrow function over rows sorted by group: pick(group, loose) -> pairs. Groups may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, pairs = [], None, []

        def close() -> None:
            if len(held) > 1:
                rows = list({r[1]: r for r in held}.values())
                if len(rows) > 1:
                    sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
                    pairs.extend(pick({"fp": [r[1] for r in rows], "sketch": sketch}, loose))

        def flush() -> pa.RecordBatch:
            u, v = [max(p) for p in pairs], [min(p) for p in pairs]
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("grp", "fp", "sketch"))):
                if r[0] != last:
                    close()
                    held, last = [], r[0]
                held.append(r)
            if pairs:
                yield flush()
        close()
        if pairs:
            yield flush()

    return run


def _pairs(rows: DataFrame, classes: DataFrame, pick, loose: float) -> DataFrame:
    """Distinct pairs (u > v) that pick finds in the groups of (grp, fp) rows."""
    full = rows.join(classes.select("fp", "sketch"), "fp").select("grp", "fp", "sketch")
    dealt = full.repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(_by_group(pick, loose), "u binary, v binary").distinct()


def _blocks():
    """Blocks of a crowded node in the second pass."""
    return F.greatest(F.ceil(F.col("size") / (WIDE * LEAF)), F.ceil(F.col("weight") / WEIGHT)).cast("long")


def _block(blocks):
    """The block of a class in its node, one if the node isn't crowded."""
    return F.when(F.col("size") <= LEAF, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("fp"), blocks))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, n, text) -> a row (fp, n, s) for each shingle."""
    for whole in batches:
        for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
            sets = list(shingle_sets(b.column("text")))
            n = np.array([len(x) for x in sets])
            fp = b.column("fp").take(pa.array(np.repeat(np.arange(len(sets)), n)))
            yield pa.RecordBatch.from_arrays([fp, pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["fp", "n", "s"])


def _reachable(texts: DataFrame, threshold: int) -> DataFrame:
    """(fp, part) of texts (fp, text) that may be linked with another of them, linked ones with the same part; the rest surely isn't.

    Shingles are put in one order, the rarest among these texts first. Say two sets of a and b shingles have the similarity
    t / 100 of a link, so at least t (a + b) / (100 + t) in common, and their first common shingle is the i-th of the first set. All
    common ones come from there on, so that is at most a - i + 1, which bounds b from above; and likewise for the other. A text stays
    if one of its shingles is had by a text of a size that both bounds allow; texts that such shingles connect are a part. Sizes are looked up by the bucket, PER_OCTAVE for each
    doubling, with the least size and the highest bound in each, so one row stands for all that share a shingle.
    """
    bucket = lambda n: F.floor(F.log2(n) * PER_OCTAVE)
    sets = stage(texts.select("fp", "text").mapInArrow(_shingles, "fp binary, n long, s long"), "shingles")
    often = stage(sets.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    lists = sets.join(often, "s").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("t"))
    # those that no other text has come before all others
    alone = F.col("n") - F.size("t")
    least = F.ceil(threshold * F.col("n") / 100)  # of a set in common with any partner, and of a partner's size
    early = F.slice("t", F.lit(1), F.greatest(F.col("n") - least + 1 - alone, F.lit(0)).cast("int"))
    rows = lists.select("fp", "n", least.alias("low"), alone.alias("alone"), F.posexplode(early).alias("p", "e"))
    after = F.col("n") - F.col("alone") - F.col("p")  # from this shingle on
    high = F.floor((after * (100 + threshold) - threshold * F.col("n")) / threshold)
    rows = rows.select("fp", "n", "e.s", "low", F.least(high, F.floor(100 * F.col("n") / threshold)).alias("high")).filter("high >= low")
    rows = stage(rows.withColumn("own", bucket(F.col("n"))), "early")
    met = stage(rows.groupBy("s", F.col("own").alias("b")).agg(F.min("n").alias("least"), F.max("high").alias("most"), F.count("*").alias("k")), "met")
    asked = rows.withColumn("b", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    found = asked.join(met, ["s", "b"]).filter("least <= high and most >= n and (b <> own or k > 1)")
    found = stage(found.select("fp", "s").distinct(), "found")
    firsts = stage(found.groupBy("s").agg(F.min("fp").alias("v")), "firsts")
    edges = found.join(firsts, "s").filter("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    parts = components(stage(edges, "edges"))
    heads = parts.select(F.col("root").alias("fp"), F.col("root").alias("part")).distinct()
    return parts.select(F.col("node").alias("fp"), F.col("root").alias("part")).unionByName(heads)


def _mixed(nodes: DataFrame) -> DataFrame:
    """(tree, path, major) of nodes with several components, and the one of most classes."""
    each = nodes.groupBy("tree", "path", "comp").agg(F.count("*").alias("k"))
    found = each.groupBy("tree", "path").agg(F.count("*").alias("n_comp"), F.max_by("comp", F.struct("k", "comp")).alias("major"))
    return found.filter("n_comp > 1").drop("n_comp")


def _without_hopeless(nodes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """nodes (tree, path, size, weight, fp, n, comp): those of several blocks fall into the parts of `_reachable`, others stay."""
    several = _blocks() > 1
    crowd = stage(nodes.filter(several).select("fp").distinct(), "crowd")
    if crowd.isEmpty():
        return nodes
    alive = stage(_reachable(texts.join(crowd, "fp", "left_semi"), threshold), "alive")
    left = nodes.filter(several).join(alive, "fp").withColumn("path", F.xxhash64("path", "part")).drop("size", "weight", "part")
    left = stage(left, "left")
    sizes = stage(left.groupBy("tree", "path").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "sizes")
    return nodes.filter(~several).unionByName(left.join(sizes, ["tree", "path"]))


def _reaches(left: np.ndarray, right: np.ndarray, threshold: int) -> bool:
    """Whether two full sets have the similarity of a link. Sizes alone rule out the hopeless ones."""
    if 100 * min(len(left), len(right)) < threshold * max(len(left), len(right)):
        return False
    both = common(left, right)
    return both > 0 and 100 * both >= threshold * (len(left) + len(right) - both)


def _linked(left: np.ndarray, right: np.ndarray, text: str, other: str, threshold: int) -> bool:
    """Whether two texts are linked: by the hashes of their sets and, if those agree, by the words."""
    return _reaches(left, right, threshold) and _reaches(*exact_sets([text, other]), threshold)


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, texts = [], zip(b.column("text_u").to_pylist(), b.column("text_v").to_pylist())
            for left, right, both in zip(shingle_sets(b.column("text_u")), shingle_sets(b.column("text_v")), texts):
                good.append(_linked(left, right, *both, threshold))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Sizes alone rule out the hopeless ones."""
    u = texts.select(F.col("fp").alias("u"), F.col("n").alias("n_u"), F.col("text").alias("text_u"))
    v = texts.select(F.col("fp").alias("v"), F.col("n").alias("n_v"), F.col("text").alias("text_v"))
    sized = pairs.join(u.select("u", "n_u"), "u").join(v.select("v", "n_v"), "v")
    sized = sized.filter(100 * F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v")).select("u", "v")
    return sized.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v").mapInArrow(_confirmed(threshold), "u binary, v binary")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (row key), n_shingles, component_id for each row with (doc_id, text). threshold: in hundredths."""
    limits = _Limits(threshold)
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    schema = "doc_id long, key binary, n long, fp binary, tokens array<long>, sketch binary"
    members = stage(rows.mapInArrow(_describe(limits), schema), "sets")
    grouped = members.filter("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("min_id"), F.min("n").alias("n"), F.min("key").alias("key"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")
    )
    classes = stage(grouped, "classes")
    leaves = stage(_leaves(classes, limits.trees), "leaves")
    wanted = leaves.select("fp").distinct().join(classes.select("fp", "key", "n"), "fp")
    found = rows.select("key", "text").join(wanted, "key").dropDuplicates(["key", "fp"])
    texts = stage(found.select("fp", "n", "text"), "texts")

    # first pass: spanning forests of a few trees; a crowded node's smallest class joins each of its blocks
    few = leaves.drop("n").filter(F.col("tree") < FIRST).withColumn("block", _block(F.ceil(F.col("size") / LEAF).cast("long")))
    heads = few.filter(F.col("size") > LEAF).groupBy("tree", "path", "size").agg(F.min("fp").alias("fp"))
    heads = heads.withColumn("weight", F.lit(0).cast("long"))
    seats = few.filter(F.col("size") > LEAF).select("tree", "path", "block").distinct()
    guests = heads.join(seats, ["tree", "path"]).select("tree", "path", "size", "weight", "fp", "block")
    first = _pairs(few.unionByName(guests).select(_group_key(), "fp"), classes, _forest, limits.loose)
    first = stage(first, "pairs")
    links = stage(_confirm(first, texts, threshold), "links")
    roots = components(links)

    # second pass: links across components in every node of every tree, confirmed in the block where two classes meet
    own = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")
    roams = (F.col("size") > LEAF) & (F.col("comp") != F.col("major"))
    nodes = stage(own.join(_mixed(own).select("tree", "path"), ["tree", "path"]), "nodes")
    nodes = _without_hopeless(nodes, texts, threshold)
    open_ = nodes.join(_mixed(nodes), ["tree", "path"]).withColumn("own", _block(_blocks())).withColumn("roams", roams)
    open_ = stage(open_.drop("major", "n"), "open")
    seat = F.struct("tree", F.xxhash64("tree", "path").alias("leaf"), F.when(F.col("roams"), F.lit(-1).cast("long")).otherwise(F.col("own")).alias("block"))
    seats = open_.groupBy("fp").agg(F.collect_list(seat).alias("seats"))  # one a tree at most
    visits = open_.filter("roams").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _blocks() - 1))).filter("block <> own").withColumn("home", F.lit(False))
    cross = open_.withColumn("block", F.col("own")).withColumn("home", F.lit(True)).unionByName(visits)
    cross = cross.join(seats.join(classes.select("fp", "sketch"), "fp"), "fp").withColumn("grp", _group_key())
    near = stage(_run_blocks(cross.select(*_Candidates.names), _Candidates, limits), "near")
    more = stage(_run_blocks(near.join(texts.select("fp", "text"), "fp"), _Links, limits).distinct(), "links")
    roots = components(links.unionByName(more))

    named = classes.select("fp", "min_id").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    labelled = named.join(ids, "root").select("fp", "component_id")
    out = members.select("doc_id", "key", "n", "fp").join(labelled, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _group_key():
    return F.xxhash64("tree", "path", "block").alias("grp")


def _kept():
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with its columns; a row that is there twice stays once."""
    keys = near_duplicates(docs.select("doc_id", "text"), threshold).filter(_kept()).select(F.col("key").alias("_key")).distinct()
    rows = docs.select(row_key().alias("_key"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.xxhash64(*docs.columns).alias("_nth"))
    kept = rows.join(keys, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", "_nth").alias("_row"))
    return kept.select("_row.*")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", _kept().alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
met AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT rid, rid FROM d UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
c AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c ON x = rid LEFT JOIN n USING (rid)
"""
