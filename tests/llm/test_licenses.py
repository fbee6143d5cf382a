"""License scan against plain edit distance at every place, and on awkward rows."""

from __future__ import annotations

import random
import re

import pytest

from cohortlens.llm import licenses
from cohortlens.llm.licenses import NOTICES, PHRASES, Notice, Scanner

SCHEMA = "doc_id long, text string, matches string, n_words string, label string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def fewest_edits(pattern: str, text: str) -> int:
    """Smallest distance between the pattern and any part of the text: the full table, one row at a time."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != x))
    return min(row)


def places(words, phrase):
    p = phrase.split()
    return [k for k in range(len(words)) if words[k:k + len(p)] == p]


def plain(text):
    words = words_of(text)
    base = [(n.label, k) for n in PHRASES for k in places(words, n.text)]
    joined = " " + " ".join(words) + " "
    more = {n.label for n in NOTICES if fewest_edits(f" {n.text} ", joined) <= n.edits}
    starts = [k for _, k in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted({x for x, _ in base} | more)))


def damaged(text: str, r: random.Random, edits: int) -> str:
    t = list(text)
    for _ in range(edits):
        k = r.randrange(len(t))
        kind = r.randrange(3)
        t[k:k + 1] = [[], [t[k], r.choice("abcdxyzé ")], [r.choice("abcdxyzé ")]][kind]
    return "".join(t)


def sample(seed: int):
    r = random.Random(seed)
    filler = "the under license mit gnu general public terms of permission Apache, use; and copy in any (cc) by Naïve — forms-source".split()
    out = []
    for k in range(40):
        parts = [" ".join(r.choices(filler, k=r.randint(0, 25)))]
        for _ in range(r.randint(0, 3)):
            n = r.choice(NOTICES + PHRASES)
            parts += [damaged(n.text.title() if r.random() < 0.3 else n.text, r, r.randint(0, n.edits + 2)), " ".join(r.choices(filler, k=r.randint(0, 9)))]
        out.append((k, " ".join(parts)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_edit_distance_at_every_place(spark, seed):
    rows = sample(seed)
    got = {r.doc_id: tuple(r)[1:7] for r in licenses.license_report(licenses.scan_licenses(table(spark, rows))).collect()}
    want = {i: plain(t) for i, t in rows}
    assert got == want
    assert len({w[5] for w in want.values()}) > 5 and any(w[4] != w[5] for w in want.values())


def test_spans_and_edits():
    text = "Naïve words — (Permision is hereby granted, free of charge, to any persn obtaining a copy). MIT License"
    n, found = Scanner(PHRASES + NOTICES).scan(text.encode())
    assert n == 18  # the dash is not ASCII, so it is a word
    mit = next(m for m in found if m["edits"])
    assert (mit["label"], mit["edits"], mit["first_word"], mit["last_word"], text[mit["start"]:mit["end"]]) == (
        "mit", 2, 3, 15, text[text.index("Permision"):text.index(")")])
    base = next(m for m in found if m["base"])
    assert (base["first_word"], base["last_word"], text[base["start"]:base["end"]]) == (16, 17, "MIT License")


def test_pieces_cover_a_wording_once():
    for n in NOTICES:
        cut = licenses.pieces(n.text, n.edits)
        assert "".join(p for _, p in cut) == n.text and len(cut) == n.edits + 1 and all(n.text[a:a + len(p)] == p for a, p in cut)


def test_repeats_are_all_counted(spark):
    rows = [(1, "mit license " * 2000), (2, "apache license mit license apache license"), (3, "general public license general public license general public")]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_report(licenses.scan_licenses(table(spark, rows))).collect()}
    assert got == {1: (2000, 0, 3998, "mit"), 2: (3, 0, 4, "apache,mit"), 3: (2, 0, 3, "gpl")}


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "MIT license"), (3, "MIT\nLICENSE"), (3, "MIT\nLICENSE"), (4, " ,.-"), (5, "omit license mit licenses"), (6, "x " * 60_000 + "apache-license"), (7, "y" * 200_000)]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.base_labels, r.labels, r.score) for r in licenses.license_report(licenses.scan_licenses(table(spark, rows))).collect()))
    assert got == [(0, 2, 1, "mit", "mit", 1.0), (1, 0, 0, "", "", 0.0), (2, 0, 0, "", "", 0.0), (3, 2, 1, "mit", "mit", 1.0), (3, 2, 1, "mit", "mit", 1.0), (4, 0, 0, "", "", 0.0),
                   (5, 4, 0, "", "", 0.0), (6, 60_002, 1, "apache", "apache", 1.0), (7, 1, 0, "", "", 0.0)]
    assert licenses.license_report(licenses.scan_licenses(table(spark, []))).count() == 0


def test_wordings_out_of_form_are_refused(spark):
    for n in (Notice("x", "Mit license"), Notice("x", "mit  license"), Notice("x", "abc", 3)):
        with pytest.raises(ValueError):
            licenses.scan_licenses(table(spark, []), (), (n,))
