"""Plain Python versions of the operators, for comparison on small tables."""

import re

import numpy as np


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    order = sorted(i for i in sets if sets[i])
    links = [(a, b) for n, a in enumerate(order) for b in order[:n] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(sets, links)


def cosine_links(rows, least):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for n, (a, x) in enumerate(good) for b, y in good[:n] if x @ y / np.sqrt((x @ x) * (y @ y)) >= least]
    degree = {i: 0 for i, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, components([i for i, _ in rows], links)


def boilerplate(rows, ratio, least=1):
    """Kept texts of (id, text, host) rows."""
    pages, seen = {}, {}
    for _, text, host in rows:
        host = host or ""
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            seen[host, line] = seen.get((host, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n / pages[k[0]] > ratio}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(" ")) not in bad) for i, t, h in rows}
