"""Plain-Python models the Spark results are compared with."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict


def integer_pagerank(edges, steps):
    out = Counter(u for u, _ in edges)
    ranks = {x: 6000 for e in edges for x in e}
    for _ in range(steps):
        flow = {u: (ranks[u] * 5) // (n * 6) for u, n in out.items()}
        nxt = {x: 1000 for x in ranks}
        for u, v in edges:
            nxt[v] += flow[u]
        ranks = nxt
    return ranks


def list_pagerank(edges, steps):
    links = defaultdict(set)
    for u, v in edges:
        links[u].add(v)
    ranks = {u: 6000 for u in links}
    for _ in range(steps):
        sums = {u: 0 for u in links}
        for u, targets in links.items():
            for v in targets:
                sums[v] = sums.get(v, 0) + ranks[u] // len(targets)
        ranks = {x: (s * 5) // 6 + 1000 for x, s in sums.items()}
    return ranks


def float_pagerank(edges, steps, reset=1 / 6):
    out = Counter(u for u, _ in edges)
    ranks = {x: 1.0 for e in edges for x in e}
    for _ in range(steps):
        nxt = {x: reset for x in ranks}
        for u, v in edges:
            nxt[v] += (1 - reset) * ranks[u] / out[u]
        ranks = nxt
    scale = len(ranks) / sum(ranks.values()) if ranks else 1
    return {x: r * scale for x, r in ranks.items()}


def match(inputs, outputs, drop_first=False):
    """inputs (t, word, offset), outputs (t, word, count, engine) -> {(word, offset): (t_out, engine) or None}"""
    lists = defaultdict(list)
    seen = set()
    for t, word, count, engine in sorted(outputs, key=lambda o: (o[0], o[1], o[2], o[3] is not None, o[3] or 0)):
        if drop_first and word not in seen:
            seen.add(word)
            continue
        lists[word].append((count, t, engine is not None, engine or 0, engine))
    for rows in lists.values():
        rows.sort(key=lambda r: r[:4])
    counts, result = Counter(), {}
    for t, word, offset in sorted(inputs, key=lambda i: (i[0], i[1], i[2])):
        counts[word] += 1
        rows = lists[word]
        at = bisect.bisect_left([r[:3] for r in rows], (counts[word], t, False))
        result[word, offset] = (rows[at][1], rows[at][4]) if at < len(rows) else None
    return result
