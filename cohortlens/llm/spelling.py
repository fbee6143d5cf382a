"""Spelling variants: words one edit apart, found in k-d trees over letter counts, and the forms they lead to.

A word's letter counts are written in unary: bit l of letter c is set when the word holds c more than l times.
A box of counts is then a pair of masks (the bits all its words have, the bits any of them has), the L1 distance
of a word to a box is two popcounts, and a k-d split of a letter at a count is one bit. One edit changes one
count by one (insertion, deletion) or two counts by one each (replacement), so L1 is at most two. Counts beyond
the levels kept, and accented letters that share a class, only make distances smaller: nothing is lost, and every
candidate is verified letter by letter.

Two levels of trees: a coarse one per word length deals words to units of bounded size over the cluster, and a
word is sent as a query to the units whose box lies near enough, once among words of its own length and once
among those that are one letter longer. Each unit builds its own tree and streams its queries through it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage

U64 = np.uint64
#: Words that one unit holds about, and bytes of its letter matrix.
UNIT_WORDS = 16_384
UNIT_BYTES = 32_000_000
#: Words that the coarse trees of all lengths are fitted on at most: those with the smallest hash. All words are dealt.
SAMPLE_WORDS = 1_000_000
LEAF_WORDS = 16
#: Pairs of query and word that one vectorised step holds.
STEP_PAIRS = 1_000_000
STEP_QUERIES = 4_096
#: Distinct words that a task counts before it passes its counts on.
COUNTED_WORDS = 400_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LEVELS = 4  # of each of 26 letters
_CLASSES = 12  # of accented letters, with two levels each: 26 * 4 + 12 * 2 = 128 bits
_CLASS = np.full(256, -1, np.int16)
_CLASS[97:123] = np.arange(26)
_CLASS[192:256] = 26 + np.arange(64) % _CLASSES


# --- words -----------------------------------------------------------------------------------

def document_words(doc_id: int | None, data: bytes, least: int = 6, modulus: int = 199) -> Counter:
    """Words (UTF-8) of one text with their counts: runs of letters, some of them with one letter taken out."""
    shortest = least if data.isascii() else None
    pattern = rb"[a-z]{%d,}" % least if shortest else rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least
    runs = Counter(re.findall(pattern, data.translate(_LOWER)))
    if not modulus:
        return runs
    start, out = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id)), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run, start)
        if h % modulus:
            out[run] += n
            continue
        letters = run.decode()
        k = h % len(letters)
        if len(letters) > least:
            out[(letters[:k] + letters[k + 1:]).encode()] += n
    return out


def word_counts(docs: DataFrame, least: int = 6, often: int = 5, modulus: int = 199) -> DataFrame:
    """(word, length, n) of the words of all texts with at least ``least`` code points and ``often`` occurrences."""
    def count(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if data.is_valid:
                    held.update(document_words(doc_id, data.as_buffer().to_pybytes(), least, modulus))
                    if len(held) > COUNTED_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return (counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)
            .select("word", F.length("word").alias("length"), "n"))


# --- letter counts and trees -----------------------------------------------------------------

def letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of code points, which are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def unary(matrix: np.ndarray) -> np.ndarray:
    """Letter counts of each row in unary, as two 64-bit masks."""
    code = np.zeros((len(matrix), 2), U64)
    kinds = _CLASS[matrix]
    for c in range(26 + _CLASSES):
        n = (kinds == c).sum(1)
        levels, first = (_LEVELS, c * _LEVELS) if c < 26 else (2, 26 * _LEVELS + (c - 26) * 2)
        for k in range(levels if n.any() else 0):
            code[:, (first + k) // 64] |= (n > k).astype(U64) << U64((first + k) % 64)
    return code


@dataclass
class Tree:
    """K-d tree as arrays; node 0 is the root, a leaf has no children and holds ``order[start:end]``."""

    order: np.ndarray
    low: np.ndarray  # bits that all words below a node have
    high: np.ndarray  # bits that any of them has
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    end: np.ndarray


def grow(code: np.ndarray, leaf: int = LEAF_WORDS, regions: bool = False) -> Tree:
    """Split at the bit nearest to half until ``leaf`` words are left or none tells them apart.

    Boxes are those of the words, or with ``regions`` those of all that the splits would send there.
    """
    order = np.arange(len(code))
    bits = np.unpackbits(np.ascontiguousarray(code).view(np.uint8).reshape(len(code), 16), axis=1, bitorder="little")
    nodes: list[list] = []

    def add(a: int, b: int, low, high) -> int:
        if not regions and b > a:
            rows = code[order[a:b]]
            low, high = np.bitwise_and.reduce(rows, 0), np.bitwise_or.reduce(rows, 0)
        nodes.append([low, high, -1, -1, -1, a, b])
        return len(nodes) - 1

    todo = [add(0, len(code), np.zeros(2, U64), np.full(2, ~U64(0)))]
    while todo:
        low, high, _, _, _, a, b = node = nodes[todo.pop()]
        if b - a <= leaf:
            continue
        rows = order[a:b]
        ones = bits[rows].sum(0, dtype=np.int64)
        j = int(np.abs(2 * ones - (b - a)).argmin())
        if ones[j] in (0, b - a):
            continue
        side = bits[rows, j].astype(bool)
        order[a:b] = np.r_[rows[~side], rows[side]]
        mark = np.zeros(2, U64)
        mark[j // 64] = U64(1) << U64(j % 64)
        middle = b - int(ones[j])
        node[2:5] = j, add(a, middle, low, high & ~mark), add(middle, b, low | mark, high)
        todo += node[3:5]
    low, high, *rest = zip(*nodes)
    return Tree(order, np.array(low, U64), np.array(high, U64), *(np.array(x, np.int64) for x in rest))


def leaf_of(tree: Tree, code: np.ndarray) -> np.ndarray:
    """The leaf that each code is dealt to."""
    at = np.zeros(len(code), np.int64)
    while (inner := tree.left[at] >= 0).any():
        j = tree.split[at[inner]]
        bit = (code[inner, j // 64] >> (j % 64).astype(U64)) & U64(1)
        at[inner] = np.where(bit == 1, tree.right[at[inner]], tree.left[at[inner]])
    return at


def reach(tree: Tree, query: np.ndarray, more: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs whose box may hold words with at most ``more`` counts above and ``fewer`` below the query's."""
    q, node, out = np.arange(len(query)), np.zeros(len(query), np.int64), []
    while len(q):
        x = query[q]
        near = ((np.bitwise_count(tree.low[node] & ~x).sum(1) <= more) & (np.bitwise_count(x & ~tree.high[node]).sum(1) <= fewer))
        q, node = q[near], node[near]
        leaf = tree.left[node] < 0
        out.append((q[leaf], node[leaf]))
        q, node = q[~leaf], node[~leaf]
        q, node = np.r_[q, q], np.r_[tree.left[node], tree.right[node]]
    return np.concatenate([x for x, _ in out] or [q]), np.concatenate([x for _, x in out] or [node])


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows differ by exactly one replaced letter or, where ``long`` is one longer, one inserted letter."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    n = short.shape[1]
    ahead, behind = short != long[:, :n], short != long[:, 1:]
    first = np.where(ahead.any(1), ahead.argmax(1), n)  # letters that agree from the front
    last = np.where(behind.any(1), behind[:, ::-1].argmax(1), n)  # and from the back
    return first + last >= n


class Unit:
    """Words of one length with their tree."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = np.array(words, object), np.array(n, np.int64)
        self.matrix = letters(words, len(words[0]))
        self.code = unary(self.matrix)
        self.tree = grow(self.code)

    def near(self, words: list[str], n: np.ndarray):
        """Pairs (word, near, n of near) between queries of one length and the unit's words: all words of the
        queries' own length once from each side, or longer words from both sides at once."""
        length = len(words[0])
        longer = self.matrix.shape[1] - length
        matrix, asked = letters(words, length), np.array(words, object)
        code = unary(matrix)
        for a in range(0, len(words), STEP_QUERIES):
            q, leaf = reach(self.tree, code[a:a + STEP_QUERIES], 1, 0 if longer else 1)
            size = (self.tree.end - self.tree.start)[leaf]
            steps = np.cumsum(size) // max(STEP_PAIRS // max(length // 64, 1), 1)
            for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(steps)) + 1):
                m = size[part]
                left = np.repeat(q[part], m) + a
                place = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.tree.start[leaf[part]], m)
                right = self.tree.order[place]
                x, y = code[left], self.code[right]
                close = (np.bitwise_count(y & ~x).sum(1) <= 1) & (np.bitwise_count(x & ~y).sum(1) <= (0 if longer else 1))
                left, right = left[close], right[close]
                same = one_edit(matrix[left], self.matrix[right])
                left, right = left[same], right[same]
                yield asked[left], self.words[right], self.n[right]
                if longer:
                    yield self.words[right], asked[left], n[left]


# --- the operator ----------------------------------------------------------------------------

_POINT, _SAME, _SHORTER = 0, 1, 2


@dataclass
class Plan:
    """Coarse trees by word length; leaf k of a tree is dealt into ``slices[k]`` units from number ``first[k]``."""

    trees: dict[int, tuple[Tree, np.ndarray, np.ndarray]]

    def deal(self, words: pd.DataFrame):
        """(unit, role, word, n) rows of words of one length: each word once as a point, and as a query in all units near it."""
        length = int(words["length"].iloc[0])
        code = unary(letters(words["word"].tolist(), length))
        hashes = np.array([zlib.crc32(w.encode()) for w in words["word"]], np.int64)
        for role, at in ((_POINT, length), (_SAME, length), (_SHORTER, length + 1)):
            if at not in self.trees:
                continue
            tree, first, slices = self.trees[at]
            if role == _POINT:
                row, leaf = np.arange(len(words)), leaf_of(tree, code)
                unit = first[leaf] + hashes % slices[leaf]
            else:
                row, leaf = reach(tree, code, 1, 1 if role == _SAME else 0)
                m = slices[leaf]
                row, unit = np.repeat(row, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[leaf], m)
            yield pd.DataFrame({"unit": unit, "role": np.int32(role), "length": np.int32(length), "word": words["word"].to_numpy()[row], "n": words["n"].to_numpy()[row]})


def plan_units(words: DataFrame, unit_words: int = UNIT_WORDS, sample_words: int = SAMPLE_WORDS) -> Plan:
    """Coarse trees for the lengths present. Counts are of all words; the splits come from a bounded sample."""
    sizes = {r["length"]: r["count"] for r in words.groupBy("length").count().collect()}
    units = {k: -(-n // max(1, min(unit_words, UNIT_BYTES // k))) for k, n in sizes.items()}
    split = [k for k, u in units.items() if u > 1]
    share = min(1.0, sample_words / max(1, sum(sizes[k] for k in split)))
    told: dict[int, list[str]] = {}
    if split:
        short = words.filter(F.col("length").isin(split))
        for r in short.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("length", "word").collect():
            told.setdefault(r["length"], []).append(r["word"])
    trees, first = {}, 0
    for k in sorted(sizes):
        sample = told.get(k, [])
        code = unary(letters(sample, k)) if sample else np.zeros((0, 2), U64)
        tree = grow(code, max(1, -(-len(sample) // units[k])), regions=True)
        held = (tree.end - tree.start) * (tree.left < 0)
        slices = np.where(tree.left < 0, np.maximum(1, np.round(held / max(1, len(sample)) * units[k])), 0).astype(np.int64)
        trees[k] = (tree, first + np.cumsum(slices) - slices, slices)
        first += int(slices.sum())
    return Plan(trees)


def near_pairs(words: DataFrame, unit_words: int = UNIT_WORDS) -> DataFrame:
    """(word, near, near_n) for all pairs of words (word, length, n) one edit apart, from both sides."""
    plan = plan_units(words, unit_words)

    def deal(frames):
        for frame in frames:
            for _, group in frame.groupby("length"):
                for a in range(0, len(group), STEP_QUERIES):
                    yield from plan.deal(group.iloc[a:a + STEP_QUERIES])

    def search(batches):
        now, points, unit = None, [], None
        for batch in batches:
            frame = batch.to_pandas()
            for (number, role, _), rows in frame.groupby(["unit", "role", "length"], sort=True):
                if number != now:
                    now, points, unit = number, [], None
                if role == _POINT:
                    points.append(rows)
                    continue
                if unit is None and points:
                    unit = Unit([w for p in points for w in p["word"]], [n for p in points for n in p["n"]])
                    points = []
                if unit is None:  # a box without words
                    continue
                for word, near, n in unit.near(rows["word"].tolist(), rows["n"].to_numpy()):
                    if len(word):
                        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    dealt = words.select("word", "length", "n").mapInPandas(deal, "unit long, role int, length int, word string, n long")
    units = sum(int(s.sum()) for _, _, s in plan.trees.values())
    least = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(max(least, -(-units // 4)), "unit").sortWithinPartitions("unit", "role", "length")
            .mapInArrow(search, "word string, near string, near_n long"))


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of links (word, form) that form no loop: the last form reached, by doubling the steps in each round."""
    found = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stage(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        found = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return found
    raise RuntimeError("links run in a loop")


def variants(docs: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, modulus: int = 199, unit_words: int = UNIT_WORDS) -> DataFrame:
    """Words of all texts with the form that each is a variant of.

    Words: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; where ``modulus`` divides the crc32 of
    ``<doc_id>:<run>``, one letter is taken out (0 for never). Kept are those with ``least`` (1 or more) code
    points and ``often`` occurrences. Columns: word; form, the near word with the largest n (ties: the smallest in
    code-point order) if that is at least ``ratio`` (2 or more) times the word's; root, the end of the chain of forms;
    n; n_near; form_n. Words without a near word have n_near 0 and are their own root.

    Null and empty texts have no words; a null doc_id counts as the empty text before the colon; repeated rows
    count each time; other columns are ignored; an empty table gives no rows. Counts cover every text, and every
    word is dealt, searched for and searched in.
    """
    if least < 1 or ratio < 2:
        raise ValueError("least must be 1 or more, ratio 2 or more")
    words = stage(word_counts(docs, least, often, modulus), "spelling-words")
    near = (near_pairs(words, unit_words).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("likely"), (-F.col("best.less")).alias("likely_n"))
    clear = F.col("likely_n") >= ratio * F.col("n")
    judged = stage(judged.select("word", F.when(clear, F.col("likely")).alias("form"), "n", "n_near", F.when(clear, F.col("likely_n")).alias("form_n")), "spelling-forms")
    ends = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
