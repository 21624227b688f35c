"""The URL query against a plain tree over the same tables, and on paths of every depth."""

import random
import time

import pytest

from arbora.llm import urls
from brute_urls import judge

COLUMNS = ("page_id", "host", "path", "rule", "verdict", "template")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ("sf0.01", "sf0.1"))
def test_query_equals_the_plain_tree(spark, sf):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url").collect()]
    got = rows_of(urls.digest(spark, f"/root/testdata/{sf}"))
    assert got == sorted(judge(pages), key=repr)
    if sf == "sf0.1":
        assert 0 < sum(r[3] is None and r[4] == "block" for r in got) < sum(r[3] is None for r in got) / 2


def test_deep_and_odd_paths_equal_the_plain_tree(spark):
    rng = random.Random(3)
    word = lambda n: rng.choice("abcdefgh") * rng.randint(1, n)
    pages = [(i, rng.choice(("x.com", "y.org", "example.org", "z.net")) + "".join("/" + rng.choice((word(2), "de", "fr", "es", "*", "+", "")) for _ in range(rng.randint(0, 6)))) for i in range(3000)]
    pages = [(i, f"http://{u}") for i, u in pages] + [(9001, None), (9002, "no scheme"), (9003, "a://x.com/" + "q/" * 400 + "?z"), (9003, "a://x.com/" + "q/" * 400 + "?z")]
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, host string, n int")
    assert rows_of(urls.judge(df)) == sorted(judge(pages), key=repr)


def test_chains_and_traps_equal_the_plain_tree(spark):
    """Long shared ways, ends along them, forks after them, and a path that repeats itself to every length."""
    rng = random.Random(5)
    way = "/".join(rng.choice("abc") for _ in range(30))
    pages = ["http://one.com/" + way + f"/{i}" for i in range(20)] + ["http://ends.com/" + "/".join(way.split("/")[: rng.randint(1, 30)]) for _ in range(60)]
    pages += ["http://trap.net" + "/calendar/next" * i for i in range(1, 40)] + ["http://trap.net" + "/de/x" * i for i in range(1, 25)] * 2
    pages += [f"http://fork.com/{way}/{rng.choice(('de', 'fr', 'xx'))}/{way}/{rng.choice('pq')}" for _ in range(80)]
    pages += [f"http://{h}/{lang}/{way}/{k}" for h in ("w.org", "w.com") for lang in ("de", "fr", "it") for k in range(9)] + ["http://few.com/" + way] * 4 + ["http://same.com/" + way] * 9
    pages = list(enumerate(pages))
    assert rows_of(urls.judge(spark.createDataFrame(pages, "page_id long, url string"))) == sorted(judge(pages), key=repr)


def test_jobs_follow_forks_and_not_segments(spark):
    """20 URLs that share 1,000 segments, and a trap of 300 lengths."""
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    jobs = []
    for n in (10, 1000):
        way = "/".join(f"s{i % 7}" for i in range(n))
        pages = [(i, f"http://x.com/{way}/{i}") for i in range(20)] + [(100 + i, "http://y.com" + "/a" * i) for i in range(1, max(10, 3 * n // 10))]
        first, began = scheduler.nextJobId(), time.time()
        assert len({r.template for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect() if r.host == "x.com"}) == 1
        jobs.append(scheduler.nextJobId() - first)
    assert jobs[1] <= jobs[0] + 10 and time.time() - began < 60


def test_labels_are_matched_better_than_by_host_alone(spark):
    """On sf0.1, templates without the URL's own label against the host's share of blocked labels."""
    rows = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")).filter("rule is not null")
    got = [(r.host, r.template, r.verdict == "block") for r in rows.collect()]
    count = lambda pick: {k: [sum(1 for g in got if pick(g) == k), sum(g[2] for g in got if pick(g) == k)] for k in {pick(g) for g in got}}
    right = {}
    for name, pick in (("host", lambda g: g[0]), ("template", lambda g: g[:2])):
        sums = count(pick)
        right[name] = sum(((sums[pick(g)][1] - g[2]) / max(sums[pick(g)][0] - 1, 1) >= 0.5) == g[2] for g in got)
    assert right["template"] > right["host"]


def test_thresholds_are_fitted_without_a_url_s_own_label(spark):
    pages = [(i, f"http://x.com/{'de' if i % 2 else 'fr'}/p{i}") for i in range(200)] + [(900 + i, f"http://y.net/z/{i}") for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = urls.cross_validated(df).collect()
    assert sorted(r.blocked for r in rows) == [False] * 100 + [True] * 100
    assert min(r.way for r in rows if r.blocked) > max(r.way for r in rows if not r.blocked)
    best, errors = urls.fit_threshold(df)
    assert errors[round(best * 20)] == 0 and urls.fit_threshold(df.filter("page_id >= 900"))[1] == [0] * 21
