"""Spelling variants against plain comparison of all words, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, length int, unit string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, 1, "u") for i, t in rows], SCHEMA)


def is_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows, least=6, often=5, ratio=5, modulus=199):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= often}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def got(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def corpus(seed: int, words: int, size: int):
    """Frequent words, rarer ones an edit away, and rare ones an edit away from those; letters as in no language."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghijklmé×Ü") for _ in range(r.randint(7, 9))) for _ in range(words)]
    first, second = [], []
    for k, w in enumerate(base):
        for source, out in ((w, first), (first[-1] if first else w, second)):
            i = r.randrange(len(source))
            out.append(r.choice([source[:i] + source[i + 1:], source[:i] + r.choice("abcÀ") + source[i:], source[:i] + r.choice("abcÀ") + source[i + 1:]]))
    pool = base * 60 + first * 9 + second
    return [(i, " ".join(w.title() if r.random() < 0.2 else w for w in r.choices(pool, k=size))) for i in range(30)]


@pytest.mark.parametrize("seed, units", [(0, spelling.UNIT_WORDS), (1, 40), (2, 7)])
def test_equals_comparison_of_all_words(spark, seed, units):
    rows = corpus(seed, 120, 1200)
    found = got(spelling.variants(table(spark, rows), modulus=13, unit_words=units))
    want = plain(rows, modulus=13)
    assert len(found) == len(set(found)) and set(found) == want
    assert sum(f is not None for _, f, *_ in want) > 30 and any(r != f for _, f, r, *_ in want if f)


def test_trees_lose_no_near_word():
    r = np.random.default_rng(5)
    words = list({"".join(r.choice(list("abcdefgé"), 7)) for _ in range(1500)})
    code = spelling.unary(spelling.letters(words, 7))
    for regions in (False, True):
        tree = spelling.grow(code, 9, regions)
        leaf = spelling.leaf_of(tree, code)
        q, reached = spelling.reach(tree, code, 1, 1)
        pairs = set(zip(q.tolist(), reached.tolist()))
        for a in range(0, len(words), 37):
            for b, w in enumerate(words):
                if is_near(words[a], w):
                    assert (a, int(leaf[b])) in pairs
        assert len(reached) < len(words) * (tree.left < 0).sum()


def test_awkward_rows(spark):
    long_word = "ab" * 40_000
    rows = [(1, None), (2, ""), (None, "walking " * 5), (3, "walking " * 30), (3, "walking " * 30), (4, "Walkings " * 6), (5, f"{long_word} {long_word}x " * 5), (6, "ĀwalkinĀ 123walker9 " * 5),
            (7, "short " * 9), (8, "aaaaaa" * 3000 + " ")]
    found = got(spelling.variants(table(spark, rows)))
    assert set(found) == plain(rows) and len(found) == len(plain(rows))
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None)])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_words_that_share_their_letters(spark):
    """Anagrams: no split tells them apart, so a cell is dealt into slices."""
    r = random.Random(3)
    words = {"".join(r.sample("abcdefgh", 8)) for _ in range(600)}
    rows = [(k, " ".join(words)) for k in range(6)] + [(9, ("abcdefgh " + "abcdefg " + "abcdefgx ") * 50)]
    assert set(got(spelling.variants(table(spark, rows), modulus=0, unit_words=50))) == {x for x in plain(rows, modulus=1 << 40)}


def test_long_chains_reach_their_end(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(27)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(links).collect()} == {(f"w{k}", "w27") for k in range(27)}
