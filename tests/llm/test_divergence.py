"""The audit against sums over every term and pair."""

import random
import re
from collections import Counter, defaultdict

import pytest

from arbora.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, item int"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def want(docs, least, top):
    df, n = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in docs:
        df[lang or ""].update(set(terms(text)))
        n[lang or "", source or ""].update(terms(text))
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, d in df[lang].items() if d >= least]
        groups = {s: {t: n[lang, s][t] for t in kept} for x, s in n if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (v + 2) // (sum(c.values()) + 2 * len(kept)) for t, v in c.items()}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        ps, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, p in ps.items():
            pairs = sorted((-sum(f(p[t], o[t]) for t in kept), x.encode(), x) for x, o in ps.items() if x != s)
            far = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, part, x, -v, i + 1) for part, rows in (("pair", pairs), ("term", far)) for i, (v, _, x) in enumerate(rows)]
    return Counter(out)


@pytest.mark.parametrize("small", [True, False])
def test_random_documents(spark, monkeypatch, small):
    if not small:  # the plans of many groups, and tasks that pass on what they hold more than once
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rng = random.Random(7)
    words = ["Äb", "ab", "AB", "z", "ñ", *(f"w{c}" for c in "abcdefghijkl"), "x1y", "é́"]
    docs = []
    for i in range(400):
        lang, source = rng.choice([None, "", "en", "de"]), rng.choice([None, "s1", "s2", "ß", "s10"])
        bias = words if source != "s1" else words[:6]
        docs.append((i, " ".join(rng.choices(bias, k=rng.choice([0, 1, 9, 80]))), lang, source, 1))
    docs += [(i, "same same", "en", "hot", 1) for i in range(200)] * 2
    docs += [(1, None, "en", "empty", 0), (2, None, "none", "a", 0), (3, "once", "none", "b", 0), (4, "Ab " * 50_000, "de", "s1", 1)]
    found = divergence.audit(spark.createDataFrame(docs, DOCS).repartition(3), 4, 3)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == want(docs, 4, 3)


def test_empty_and_without_terms(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(1, "a", "en", "x", 0), (2, None, "en", "y", 0)]
    assert Counter(map(tuple, divergence.audit(spark.createDataFrame(docs, DOCS)).collect())) == want(docs, 10, 10)
