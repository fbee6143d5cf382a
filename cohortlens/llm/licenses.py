"""License scan: short notices found in whole texts with a bounded number of edits.

A notice with k edits allowed is cut into k + 1 pieces. Any occurrence leaves one piece untouched, so exact hits
of pieces, found for all notices in one pass of an automaton, are the only places to look at; there the
``regex`` library's bounded-error matching decides, and gives the best span and its edits.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of words, after A-Z is lower-cased; all others separate words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    """A wording in lower-case words with single spaces, its label, and the edits allowed (characters).

    A notice without edits counts word for word; its places are reported as ``base``.
    """

    label: str
    text: str
    edits: int = 0


# Phrases that count word for word.
PHRASES = (Notice("apache", "apache license"), Notice("gpl", "general public license"), Notice("mit", "mit license"))

# Wordings of common licenses with the edits allowed; short ones that name a license by a few letters have few.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 2),
    Notice("apache", "under the apache license", 2),
    Notice("apache", "you may not use this file except in compliance with the license", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("cc", "creative commons attribution", 2),
    Notice("cc", "licensed under cc by", 1),
    Notice("gpl", "general public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mit", "under the mit license", 1),
    Notice("mpl", "the terms of the mozilla public license", 3),
)


def normalised(data: bytes) -> tuple[str, int]:
    """Words of a text (UTF-8), lower-cased and with one space before, between and after them; and their number."""
    words = data.translate(_SPACED).split()
    return (" " + b" ".join(words).decode("utf-8", "replace") + " " if words else ""), len(words)


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Scanner:
    """All notices in one automaton of pieces, and one bounded-error pattern for each."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            if normalised(notice.text.encode())[0] != f" {notice.text} " or len(notice.text) <= notice.edits:
                raise ValueError(f"not in normal form, or too short for its edits: {notice}")
            for at, piece in pieces(f" {notice.text} ", notice.edits):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    @cached_property
    def patterns(self) -> list:
        return [regex.compile(r"(?b)(?:%s){e<=%d}" % (regex.escape(f" {n.text} ", literal_spaces=True), n.edits)) for n in self.notices]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a normalised text: every place of a notice without edits, and for the others
        every occurrence that no better one of the same notice overlaps."""
        near: dict[int, set[int]] = {}
        for end, (length, uses) in self.seeds.iter(text):
            for k, at in uses:
                near.setdefault(k, set()).add(end + 1 - length - at)
        out = []
        for k, starts in near.items():
            edits, length = self.notices[k].edits, len(self.notices[k].text) + 2
            found = set()
            for start in starts:
                hit = self.patterns[k].search(text, max(start - edits, 0), min(start + length + edits, len(text)))
                if hit:
                    found.add((sum(hit.fuzzy_counts), hit.start(), hit.end()))
            if not edits:
                out += [(k, a, b, 0) for _, a, b in found]
                continue
            taken: list[tuple[int, int]] = []  # spans apart from each other, in order
            for cost, a, b in sorted(found):
                place = bisect.bisect(taken, (a, b))
                # neighbours may share the space between them
                if (not place or taken[place - 1][1] <= a + 1) and (place == len(taken) or b <= taken[place][0] + 1):
                    taken.insert(place, (a, b))
                    out.append((k, a, b, cost))
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))

    def scan(self, data: bytes | None):
        """(number of words, matches) of one text."""
        text, n_words = normalised(data or b"")
        found = self.find(text)
        if not found:
            return n_words, []
        spans = [m.span() for m in _WORDS.finditer(data.decode("utf-8", "replace"))]
        out, seen, counted = [], 0, 0
        for k, a, b, cost in found:
            counted += text.count(" ", seen, a)
            seen = a
            inside = text[a:b]
            first = counted - (0 if inside.startswith(" ") else 1)
            last = first + len(inside.split()) - 1
            notice = self.notices[k]
            out.append({"label": notice.label, "notice": notice.text, "base": not notice.edits, "edits": cost,
                        "score": 1 - cost / (notice.edits + 1), "first_word": first, "last_word": last, "start": spans[first][0], "end": spans[last][1]})
        return n_words, out


_MATCH = "array<struct<label:string,notice:string,base:boolean,edits:int,score:double,first_word:long,last_word:long,start:long,end:long>>"
_MATCH_ARROW = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("score", pa.float64()),
                                   ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(docs: DataFrame, phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """License notices in every whole text of (doc_id, text), one row per row of ``docs``.

    Columns: doc_id; n_words; matches, in the order of the text: label, notice, base (a phrase word for word), edits,
    score (1 - edits / (edits allowed + 1)), first and last word (from 0), and the span in the text (code points,
    end exclusive). Every place of a phrase is a match; of overlapping matches of one notice with edits, the one
    with fewest edits is kept (ties: the first), which never empties the set of labels.

    Null and empty texts have no words and no matches; null and repeated ids are kept row by row; other columns are
    ignored; an empty table gives no rows. A text is scanned in one pass, nothing is shuffled.
    """
    every = tuple(phrases) + tuple(notices)
    Scanner(every)  # refuses wordings that are not in normal form

    def scan(batches):
        scanner = Scanner(every)
        for batch in batches:
            found = [scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], _MATCH_ARROW)],
                                             ["doc_id", "n_words", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, f"doc_id long, n_words long, matches {_MATCH}")


def license_report(found: DataFrame) -> DataFrame:
    """What ``scan_licenses`` found, in one line per row: base places, and the labels without and with the method's."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first_word"])

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels("matches").alias("labels"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"), F.size("matches").cast("long").alias("n_matches"))
