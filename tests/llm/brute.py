"""Plain-Python versions of operators that SQL can't express, for small tables."""

import re


def near_duplicates(rows, threshold=85):
    """[(doc_id, n_shingles, component_id, kept)] of [(doc_id, text)]."""
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return [(d, len(sets[i]), best[find(i)], d == best[find(i)]) for i, (d, _) in enumerate(rows)]


def repeats(rows, length=200, keep_first=None):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]; keep_first: the order of rows in which the first stays."""
    from collections import defaultdict
    from hashlib import sha256

    places = defaultdict(list)
    raw = [(t or "").encode() for _, t in rows]
    for r in keep_first or range(len(rows)):
        for i in range(len(raw[r]) - length + 1):
            places[raw[r][i : i + length]].append((r, i))
    gone = [bytearray(len(x)) for x in raw]
    for found in places.values():
        for r, i in found[1 if keep_first else 0 :] if len(found) > 1 else ():
            gone[r][i : i + length] = b"\1" * length
    out = []
    for (d, _), x, g in zip(rows, raw, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and not (i and g[i - 1]))
        out.append((d, len(x), sum(g), spans, sha256(bytes(b for b, z in zip(x, g) if not z)).hexdigest()))
    return out
