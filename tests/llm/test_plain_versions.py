"""Trees of the quality classifier, urls of the filter and items found in texts, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cohortlens.llm import quality, urls


def walk(trees: quality.Trees, row) -> float:
    """One row through one tree after another, node by node."""
    total, inner = trees.base, trees.feature.shape[1]
    for f, t, v in zip(trees.feature, trees.threshold, trees.value):
        k = 0
        while k < inner:
            k = 2 * k + 1 + int(row[f[k]] > t[k])
        total += v[k - inner]
    return total


def plain_round(x, y, margin, depth, rate, penalty, least):
    """Level-wise growth over all thresholds between quantile bins, with sums taken row by row."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    nodes, value = [np.arange(len(y))], np.zeros(len(y))
    for _ in range(depth):
        new = []
        for rows in nodes:
            best, cut = 1e-9, None
            G, H = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                for t in e:
                    low = x[rows, j] <= t
                    a, b = g[rows][low].sum(), h[rows][low].sum()
                    if b < least or H - b < least:
                        continue
                    gain = a * a / (b + penalty) + (G - a) ** 2 / (H - b + penalty) - G * G / (H + penalty)
                    if gain > best + 1e-12:
                        best, cut = gain, (j, t)
            low = x[rows, cut[0]] <= cut[1] if cut else np.ones(len(rows), bool)
            new += [rows[low], rows[~low]]
        nodes = new
    for rows in nodes:
        value[rows] = -rate * g[rows].sum() / (h[rows].sum() + penalty)
    return margin + value


@pytest.mark.parametrize("seed", range(3))
def test_trees_are_grown_and_walked_as_in_a_plain_version(seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(150, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=150) > 0).astype(float)
    trees = quality.grow(x, y, rounds=3, depth=3)
    got = trees.margin(x)
    assert np.allclose(got, [walk(trees, row) for row in x], atol=1e-12)
    share = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(3):
        margin = plain_round(x, y, margin, 3, 0.15, 1.0, 1.0)
    assert np.allclose(got, margin, atol=1e-9)
    again = quality.Trees.from_json(trees.to_json())
    assert (again.margin(x) == got).all()


def plain_url(url):
    """(host, path, rule, verdict of the rule) by the words of the contract."""
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))]
    fits = [x for x in rules if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(*(x.split("/", 1)[0], "/" + x.split("/", 1)[1]))]
    rule = max(fits, key=len, default=None)
    return host, path, rule, rules.get(rule)


def test_hosts_paths_and_rules_of_many_urls(spark):
    r = np.random.default_rng(1)
    hosts = ["example.org", "www.example.org", "EXAMPLE.org", "org", "myorg", "a.com", "com", "x.net", "notexample.org", "", "é.org", "a.b.c.com:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a", "/de/#/fr/", "/FR/", "?q=/de/", "#/es/", "/" + "long/" * 4000]
    rows = [(k, f"{r.choice(['http', 'https', ''])}{r.choice(['://', '://', '://', ':/'])}{r.choice(hosts)}{r.choice(paths)}") for k in range(400)]
    rows += [(400, None), (401, ""), (402, "no scheme/es/"), (403, "http://a://b.org/c"), (403, "http://a://b.org/c")]
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert len(got) == len(rows)
    want = {k: plain_url(u) for k, u in rows}
    for k, host, path, rule, verdict in got:
        assert (host, path, rule) == want[k][:3]
        assert verdict == want[k][3] if rule else verdict in ("allow", "block")


def _least_edits(item: bytes, text: bytes) -> int:
    """Fewest edits between the whole item and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_items_found_are_those_of_full_tables():
    from cohortlens.llm.decontaminate import EDIT_SHARE, Index, Q, budget, segments
    r = random.Random(5)

    def letters(n):
        return bytes(r.choice(b"abcdefgh ") for _ in range(n)).replace(b"  ", b"x ").strip() or b"a"

    def edit(x, n):
        for _ in range(n):
            k = r.randrange(len(x))
            x = r.choice([x[:k] + x[k + 1:], x[:k] + b"z" + x[k:], x[:k] + b"y" + x[k + 1:]])
        return x

    items = [(k, letters(n)) for k, n in enumerate([10, 14, 25, 40, 60, 90, 120, 200, 201, 240, 330])]
    index = Index.build(items, EDIT_SHARE, Q)
    hits = misses = 0
    for trial in range(40):
        k, item = r.choice(items)
        cut = item[r.randrange(0, 60):] if len(item) > 200 and trial % 2 else item
        text = letters(r.randrange(1, 80)) + edit(cut, r.randrange(0, max(1, 2 * budget(len(item), EDIT_SHARE, Q)) + 1)) + letters(r.randrange(1, 80))
        got = {f[0]: f for f in index.find(text)}
        for i, t in items:
            whole = _least_edits(t, text)
            near = [e for e in (_least_edits(x, text) for x in segments(t)) if e <= budget(200, EDIT_SHARE, Q)]
            want = whole if whole <= budget(len(t), EDIT_SHARE, Q) else min(near, default=None)
            assert (got[i][3] if i in got else None) == want, (trial, i, len(t))
        hits, misses = hits + (k in got), misses + (k not in got)
    assert hits >= 10 and misses >= 5


def test_short_items_are_whole_words_and_long_quotes_are_found_wherever_cut():
    from cohortlens.llm.decontaminate import EDIT_SHARE, Index, Q, SEGMENT, SEGMENT_STEP, normal
    r = random.Random(6)
    long = normal(" ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(120)))
    index = Index.build([(1, long), (2, b"ab c"), (3, b"x"), (4, b""), (5, b"ab c")], EDIT_SHARE, Q)
    for text, want in [(b"ab c", [2, 5]), (b"dab c", []), (b"ab cd x", [3]), (b"q ab c r x", [2, 5, 3]), (b"", []), (b"xx x", [3])]:
        assert sorted(f[0] for f in index.find(text)) == sorted(want), text
        assert all(text[f[1]:f[2]] in (b"ab c", b"x") for f in index.find(text))
    n = SEGMENT + SEGMENT_STEP
    for k in range(0, len(long) - n, 37):
        found = index.find(b"before " + long[k:k + n] + b" after")
        assert [f[0] for f in found] == [1] and found[0][3] == 0
    assert not index.find(long[:SEGMENT // 2])
