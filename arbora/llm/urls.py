"""URL filters by a path-template tree, in DataFrame functions alone.

Rules (`host/path-prefix` with allow or block) decide the URLs they fit and label them for the rest. Per host, a tree of
path segments is grown level by level until no path has a further segment: a segment that carries too few of its node's
URLs is variable and becomes `*`. A node of fewer than MIN_ROWS URLs, whose further segments are all variable, and one
whose URLs have all the same path, whose segments are all fixed, are not grown: what is left of the path is one token.
Then branches are merged into `*` from the deepest level up: those whose labels don't differ by a z-test from the pool of
all branches under the same parent, template by template below them. So /en/* without labels joins /de/* as /*/*. Variable
segments that do differ are named `+`, apart from the merged ones.

A URL that no rule fits gets its template's purity, the share of blocked labels smoothed towards the host's and that
towards all hosts'. A template without labels takes the nearest branch above it that has some, or else the host's rate. The
URL is blocked if the purity has come `threshold` of the way from the share of blocked labels of all hosts to 1.

Segments that all paths of a node share are taken at once, past the ends of shorter ones, and branches are merged only at the levels where
some node has several, so the number of jobs follows the forks of the deepest path, not its segments. A prefix of a node is known by
128 bits of a hash of its tokens.

Hosts of any size: every step is an aggregate with a map-side combine or an equi-join whose other side has one row a
node, so one host with a third of all rows is split by adaptive execution.

A null URL or one without `://` has an empty host and path. Repeated URLs count as often as they occur. A URL of any length
and number of segments is grown only as far as its node needs; thousands of segments shared by many URLs are one step. Segments `*` and `+` are escaped as %2A and %2B, so they
are no wildcards. Extra columns don't matter. No rows, no result.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import LOWER, UPPER, table
from arbora.staging import stage

# Fixed values: (host and path prefix, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
MIN_ROWS, MIN_SHARE, Z, PRIOR, THRESHOLD = 5, 0.02, 1.96, 10.0, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, null if none. The rules are a list of the operator, compiled into the expression."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """rows of nodes with one segment only: moves as many from `rest` to `tokens` as growing them one at a time would.

    That goes on along the longest path while all that haven't ended agree with it, are MIN_ROWS or more, and differ further on.
    """
    key, size, left = ["host", "tokens"], F.size("rest"), F.array_join("rest", "/")
    rows = rows.withColumn("left", left)
    longest = stage(rows.groupBy(*key).agg(F.max_by("rest", F.struct(size, "left")).alias("way")), "ways")
    rows = rows.join(longest, key)
    differs = F.array_position(F.transform("rest", lambda s, i: s.eqNullSafe(F.get("way", i))), False)
    other = F.col("left") != F.array_join("way", "/")
    ends = rows.groupBy(*key).agg(F.min(F.when(differs > 0, differs - 1)).alias("agree"), F.max(F.when(other, size)).alias("second"))
    sizes = rows.groupBy(*key, size.alias("size")).agg(F.sum("n").alias("k"))
    reach = F.sum("k").over(Window.partitionBy(*key).orderBy(F.desc("size")))
    enough = sizes.withColumn("reach", reach).filter(F.col("reach") >= MIN_ROWS).groupBy(*key).agg(F.max("size").alias("enough"))
    steps = stage(ends.join(enough, key).select(*key, F.least("agree", "second", "enough").cast("int").alias("step")), "steps")
    moved = rows.drop("left", "way").join(steps, key)
    rest = F.slice("rest", F.col("step") + 1, size)
    return moved.withColumns({"tokens": F.concat("tokens", F.slice("rest", F.lit(1), F.col("step"))), "rest": rest}).drop("step")


def _variables(rows: DataFrame) -> DataFrame:
    """Moves the first segment of `rest` to `tokens`, as * where the segment carries too few of the node's URLs.

    `rest` is not empty. A node that needs no growing gets all of it as one token; one with a single segment is left to `_shared`.
    """
    columns = rows.columns
    rows = rows.withColumn("seg", F.col("rest")[0])
    left = F.array_join("rest", "/")
    each = rows.groupBy("host", "tokens", "seg").agg(F.sum("n").alias("k"), F.min(left).alias("low"), F.max(left).alias("high"))
    each = stage(each, "segments")
    whole = each.groupBy("host", "tokens").agg(F.sum("k").alias("total"), (F.min("low") == F.max("high")).alias("same"), (F.count("*") == 1).alias("one"))
    whole = stage(whole, "totals")  # so that the join's sides are plain shuffles, which adaptive execution can split
    single = whole.filter((F.col("total") >= MIN_ROWS) & ~F.col("same") & F.col("one")).select("host", "tokens")
    shared = None
    if not single.isEmpty():
        shared = _shared(rows.drop("seg").join(single, ["host", "tokens"], "left_semi")).select(columns)
        rows = rows.join(single, ["host", "tokens"], "left_anti")
    fixed = (F.col("k") >= MIN_ROWS) & (F.col("k") >= F.col("total") * MIN_SHARE)
    few = F.col("total") < MIN_ROWS
    known = each.join(whole, ["host", "tokens"]).filter(few | fixed)
    known = known.select("host", "tokens", "seg", fixed.alias("fixed"), (few | F.col("same")).alias("ends"))
    found = rows.join(known, ["host", "tokens", "seg"], "left")
    ends, fixed = F.coalesce("ends", F.lit(False)), F.coalesce("fixed", F.lit(False))
    variable = F.array_join(F.transform("rest", lambda _: F.lit("*")), "/")
    token = F.when(ends, F.when(fixed, left).otherwise(variable)).otherwise(F.when(fixed, F.col("seg")).otherwise("*"))
    rest = F.when(ends, F.array().cast("array<string>")).otherwise(F.slice("rest", F.lit(2), F.size("rest")))
    out = found.withColumns({"tokens": F.array_append("tokens", token), "rest": rest}).select(columns)
    return out if shared is None else out.unionByName(shared)


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, label, n) -> the same with `tokens`, the node of the whole path."""
    # a segment that is a wildcard's sign is escaped as in a URL
    literal = lambda s: F.when(s == "*", "%2A").when(s == "+", "%2B").otherwise(s)
    rows = urls.withColumn("rest", F.transform(F.array_remove(F.split("path", "/"), ""), literal)).withColumn("tokens", F.array().cast("array<string>"))
    ended = F.size("rest") == 0
    done, rows = rows.filter(ended), rows.filter(~ended)
    while not rows.isEmpty():
        grown = stage(_variables(rows), "urls")  # a level reads its rows twice: keep the plans apart
        done, rows = done.unionByName(grown.filter(ended)), grown.filter(~ended)
    return done.drop("rest")


def _counts() -> list[Column]:
    return [F.sum("lab").alias("lab"), F.sum("bad").alias("bad")]


def _prefixes(tokens: str) -> Column:
    """A hash of each prefix of a node's tokens, the empty one first; hosts apart."""
    return F.aggregate(tokens, F.array(F.md5("host")), lambda a, t: F.array_append(a, F.md5(F.concat(F.element_at(a, -1), t))))


def merged(nodes: DataFrame) -> DataFrame:
    """(host, tokens, lab, bad) -> the same with `form`, the node's tokens after its branches were merged bottom-up."""
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    steps = nodes.withColumn("up", _prefixes("tokens"))
    steps = steps.select("id", F.inline(F.transform("tokens", lambda t, i: F.struct((i + 1).alias("d"), F.get("up", i).alias("up"), t.alias("token")))))
    steps = stage(steps, "steps")
    several = stage(steps.groupBy("up").agg((F.min("token") != F.max("token")).alias("several")).filter("several").select("up"), "forks")
    forks = stage(steps.join(several, "up").groupBy("id").agg(F.collect_set("d").alias("forks")), "forks")
    depths = sorted((r[0] for r in forks.select(F.explode("forks")).distinct().collect()), reverse=True)  # levels with a fork
    # a branch that has no other beside it doesn't differ from their pool
    alone = F.transform("tokens", lambda t, i: F.when(F.array_contains("forks", i + 1), t).otherwise("*"))
    nodes = nodes.join(forks, "id", "left").withColumn("forks", F.coalesce("forks", F.array().cast("array<int>"))).withColumn("form", alone)
    nodes = stage(nodes.drop("id"), "merged")
    for d in depths:
        # the branch at this level: its parent, its token there, and what its templates below have become
        inside = F.array_contains("forks", d)
        cut = nodes.withColumn("up", F.when(inside, F.slice("tokens", 1, d - 1))).withColumn("token", F.get("tokens", F.lit(d - 1)))
        cut = cut.withColumn("below", F.when(inside, F.slice("form", F.lit(d + 1), F.size("form"))))
        each = cut.filter(inside).groupBy("host", "up", "token", "below").agg(*_counts())
        pool = each.groupBy("host", "up", "below").agg(F.sum("lab").alias("p_lab"), F.sum("bad").alias("p_bad"))
        rate = F.try_divide("p_bad", "p_lab")
        gap = F.abs(F.try_divide("bad", "lab") - rate)
        apart = gap > Z * F.sqrt(F.try_divide(rate * (1 - rate), F.col("lab")))
        odd = each.filter("lab > 0").join(pool, ["host", "up", "below"]).filter(apart).select("host", "up", "token", F.lit(True).alias("apart")).distinct()
        own = F.when(F.col("apart"), F.when(F.col("token") == "*", "+").otherwise(F.col("token"))).otherwise("*")
        form = F.concat(F.slice("form", 1, d - 1), F.array(own), F.col("below"))
        nodes = cut.join(odd, ["host", "up", "token"], "left").withColumn("form", F.when(inside, form).otherwise(F.col("form")))
        nodes = stage(nodes.select("host", "tokens", "lab", "bad", "forks", "form"), "merged")
    return nodes.drop("forks")


def purity(rows: DataFrame) -> DataFrame:
    """(host, tokens, template, purity, base) for each node; base is the share of blocked labels over all hosts."""
    n = F.col("n")
    labels = F.sum(F.when(F.col("label").isNotNull(), n).otherwise(0)), F.sum(F.when(F.col("label") == "block", n).otherwise(0))
    nodes = merged(rows.groupBy("host", "tokens").agg(labels[0].alias("lab"), labels[1].alias("bad")))
    forms = stage(nodes.groupBy("host", "form").agg(*_counts()).withColumn("id", F.monotonically_increasing_id()), "forms")
    ups = forms.select("id", "lab", "bad", F.posexplode(_prefixes("form")).alias("d", "up"))
    ups = stage(ups, "branches")
    known = ups.groupBy("up", "d").agg(*_counts()).filter((F.col("lab") > 0) | (F.col("d") == 0))
    nearest = ups.select("id", "up").join(known, "up").groupBy("id").agg(F.max_by(F.struct("d", "lab", "bad"), "d").alias("near"))
    nearest = forms.select("id", "host", "form").join(nearest, "id").drop("id")
    hosts = nodes.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    base = F.coalesce(hosts.agg((F.sum("h_bad") + 1) / (F.sum("h_lab") + 2)).scalar(), F.lit(0.5))
    scored = nearest.join(hosts, "host").withColumn("base", base)
    host_rate = (F.col("h_bad") + PRIOR * F.col("base")) / (F.col("h_lab") + PRIOR)
    own = F.when(F.col("near.d") == 0, host_rate).otherwise((F.col("near.bad") + PRIOR * host_rate) / (F.col("near.lab") + PRIOR))
    template = F.when(F.size("form") == 0, "").otherwise(F.concat(F.lit("/"), F.array_join("form", "/")))
    scored = scored.select("host", "form", template.alias("template"), own.alias("purity"), "base")
    return stage(nodes.select("host", "tokens", "form").join(scored, ["host", "form"]).drop("form"), "purity")


def _placed(pages: DataFrame, rules) -> DataFrame:
    """page_id, host, path, rule, label, n and tokens of each row with (page_id, url)."""
    host, path = F.col("host"), F.col("path")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_for(host, path, rules)).withColumn("label", verdict_of(F.col("rule"), rules))
    return templates(stage(rows.withColumn("n", F.lit(1)), "parsed"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row with (page_id, url)."""
    placed = _placed(pages, rules)
    judged = placed.join(purity(placed), ["host", "tokens"])
    own = F.when(F.col("purity") >= F.col("base") + threshold * (1 - F.col("base")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "template", "purity")


def cross_validated(pages: DataFrame, rules=RULES, folds: int = 2) -> DataFrame:
    """(blocked, way) of every labelled URL: how far its template's purity comes when the labels of the URL's fold are hidden. Equal URLs
    share a fold; hosts don't, so that a template is judged by others of its host."""
    placed, out = stage(_placed(pages, rules), "placed"), None
    for f in range(folds):
        hidden = F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == f
        seen = purity(placed.withColumn("label", F.when(~hidden, F.col("label"))))
        rows = placed.filter(hidden & F.col("label").isNotNull()).join(seen, ["host", "tokens"])
        rows = rows.select((F.col("label") == "block").alias("blocked"), ((F.col("purity") - F.col("base")) / (1 - F.col("base"))).alias("way"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fit_threshold(pages: DataFrame, rules=RULES, folds: int = 2, steps: int = 20) -> tuple[float, list[int]]:
    """The threshold of fewest errors on labelled URLs whose own labels were hidden, the middle of equally good ones; and the errors at 0, 1 / steps .. 1."""
    wrong = [F.count_if((F.col("way") >= i / steps) != F.col("blocked")).alias(f"e{i}") for i in range(steps + 1)]
    errors = list(cross_validated(pages, rules, folds).agg(*wrong).first())
    good = [i for i, e in enumerate(errors) if e == min(errors)]
    return good[len(good) // 2] / steps, errors


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
