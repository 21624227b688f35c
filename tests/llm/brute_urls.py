"""The template tree of URLs in plain Python: nested dictionaries, one host at a time."""

import re
from collections import Counter, defaultdict

MIN_ROWS, MIN_SHARE, Z, PRIOR, THRESHOLD = 5, 0.02, 1.96, 10.0, 0.5
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def split_url(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def grow(paths):
    """{path: tokens} of one host; paths: Counter of segment tuples."""
    out = {}

    def node(members, prefix):
        here = {p: n for p, n in members.items() if len(p) > len(prefix[1])}
        out.update({p: prefix[0] for p in members if p not in here})
        if not here:
            return
        k = len(prefix[1])
        total, each = sum(here.values()), Counter()
        for p, n in here.items():
            each[p[k]] += n
        same = len({p[k:] for p in here}) == 1
        groups = defaultdict(dict)
        for p, n in here.items():
            fixed = each[p[k]] >= MIN_ROWS and each[p[k]] >= total * MIN_SHARE
            if total < MIN_ROWS or (same and fixed):
                out[p] = (*prefix[0], "/".join(p[k:]) if fixed else "/".join("*" for _ in p[k:]))
            else:
                groups[p[k] if fixed else "*"][p] = n
        for token, inside in groups.items():
            node(inside, ((*prefix[0], token), (*prefix[1], token)))

    node(paths, ((), ()))
    return out


def merge(nodes):
    """{tokens: form}; nodes: {tokens: (lab, bad)} of one host."""
    form = {t: t for t in nodes}
    for d in range(max(map(len, nodes), default=0), 0, -1):
        each = defaultdict(lambda: [0, 0])
        for t, (lab, bad) in nodes.items():
            if len(t) >= d:
                cell = each[t[: d - 1], t[d - 1], form[t][d:]]
                cell[0] += lab
                cell[1] += bad
        pool = defaultdict(lambda: [0, 0])
        for (up, _, below), (lab, bad) in each.items():
            pool[up, below][0] += lab
            pool[up, below][1] += bad
        odd = set()
        for (up, token, below), (lab, bad) in each.items():
            all_lab, all_bad = pool[up, below]
            if lab and all_lab:
                rate = all_bad / all_lab
                if abs(bad / lab - rate) > Z * (rate * (1 - rate) / lab) ** 0.5:
                    odd.add((up, token))
        for t in nodes:
            if len(t) >= d:
                own = ("+" if t[d - 1] == "*" else t[d - 1]) if (t[: d - 1], t[d - 1]) in odd else "*"
                form[t] = (*form[t][: d - 1], own, *form[t][d:])
    return form


def judge(rows):
    """[(page_id, host, path, rule, verdict, template)] of [(page_id, url)]."""
    parsed = [(i, *split_url(u)) for i, u in rows]
    label = {(h, p): RULES.get(rule_of(h, p)) for _, h, p in parsed}
    cut = lambda p: tuple({"*": "%2A", "+": "%2B"}.get(s, s) for s in p.split("/") if s)
    hosts = defaultdict(Counter)
    labelled = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for _, h, p in parsed:
        hosts[h][cut(p)] += 1
    tokens = {h: grow(paths) for h, paths in hosts.items()}
    for _, h, p in parsed:
        cell = labelled[h][tokens[h][cut(p)]]
        cell[0] += label[h, p] is not None
        cell[1] += label[h, p] == "block"
    total = [sum(c[i] for cells in labelled.values() for c in cells.values()) for i in (0, 1)]
    base = (total[1] + 1) / (total[0] + 2)
    purity = {}
    forms = {h: merge({t: tuple(c) for t, c in cells.items()}) for h, cells in labelled.items()}
    for h, cells in labelled.items():
        sums = [sum(c[i] for c in cells.values()) for i in (0, 1)]
        rate = (sums[1] + PRIOR * base) / (sums[0] + PRIOR)
        for f in set(forms[h].values()):
            for d in range(len(f), -1, -1):
                inside = [c for t, c in cells.items() if forms[h][t][:d] == f[:d]]
                lab, bad = sum(c[0] for c in inside), sum(c[1] for c in inside)
                if lab or not d:
                    purity[h, f] = rate if not d else (bad + PRIOR * rate) / (lab + PRIOR)
                    break
    out = []
    for i, h, p in parsed:
        f = forms[h][tokens[h][cut(p)]]
        own = "block" if purity[h, f] >= base + THRESHOLD * (1 - base) else "allow"
        out.append((i, h, p, rule_of(h, p), label[h, p] or own, "".join("/" + t for t in f)))
    return out
