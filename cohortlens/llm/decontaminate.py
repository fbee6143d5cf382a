"""Benchmark decontamination by the q-gram lemma."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, mix, steps, utf8
from cohortlens.session import stage

#: Characters of a q-gram, and the edits allowed for each character of an item.
Q, EDIT_SHARE = 10, 0.06
#: Bytes of a segment of a longer item, and from one segment's beginning to the next one's.
SEGMENT, SEGMENT_STEP = 200, 50
#: Bytes of benchmark text whose index goes to every task at once; more items are looked up in further passes.
BLOCK_BYTES = 8_000_000
_FOLD = bytes.maketrans(bytes(range(128)), bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(128)))
_SLOTS = 22


def normal(text: str | None) -> bytes:
    """Lower-cased A-Z; other ASCII than letters and digits becomes a space; spaces are single. Further characters stay."""
    return b" ".join(utf8(text).translate(_FOLD).split())


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """64-bit hash of the q bytes from each place on."""
    x = np.frombuffer(data, np.uint8).astype(U64)
    n = len(x) - q + 1
    if n < 1:
        return np.empty(0, U64)
    h = x[:n].copy()
    for k in range(1, q):
        h *= U64(0x100000001B3)
        h += x[k:n + k]
    return mix(h)


def budget(length: int, share: float, q: int) -> int:
    """Edits allowed to an item: its share, but no more than leave a common q-gram for sure."""
    return max(0, min(int(share * length), (length - q) // q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Fewest edits between the whole item and any stretch of the text on the diagonals low..high (text place
    less item place), and the place after that stretch; (most + 1, -1) if there are more than ``most``."""
    d = np.arange(low, high + 1)
    big = most + 1
    ramp = np.arange(len(d))
    row = np.where((d >= 0) & (d <= len(text)), 0, big)
    for i, c in enumerate(item):
        j = i + d  # text place compared with item place i
        inside = (j >= 0) & (j < len(text))
        step = row + np.where(inside, text[np.clip(j, 0, max(len(text) - 1, 0))] != c, big)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.where((j + 1 >= 0) & (j + 1 <= len(text)), step, big)
        row = np.minimum(np.minimum.accumulate(step - ramp) + ramp, big)
        if row.min() >= big:
            return big, -1
    best = int(row.argmin())
    return int(row[best]), int(len(item) + d[best])


def segments(item: bytes, length: int = SEGMENT, step: int = SEGMENT_STEP) -> list[bytes]:
    """Overlapping parts of a longer item, the last one at its end: a quote of length + step bytes holds one whole."""
    if len(item) <= length:
        return []
    return [item[i:i + length] for i in [*range(0, len(item) - length, step), len(item) - length]]


@dataclass
class Index:
    """q-grams of patterns: sorted distinct hashes, where their postings start, and pattern number and place of each posting.

    Patterns are the whole items and, after them, the segments of long ones; ``owner`` is the item's number. Items of
    fewer than q bytes have no q-gram: they are kept by length, with the sorted hashes of that length.
    """

    ids: list
    wholes: int
    owner: list[int]
    patterns: list[bytes]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    mask: np.ndarray
    short: dict[int, tuple[np.ndarray, dict[bytes, list]]]
    q: int

    @classmethod
    def build(cls, rows: list[tuple], share: float, q: int) -> Index:
        kept = [(i, t) for i, t in rows if len(t) >= q]
        parts = [(k, x) for k, (_, t) in enumerate(kept) for x in segments(t)]
        patterns, owner = [t for _, t in kept] + [x for _, x in parts], [*range(len(kept)), *(k for k, _ in parts)]
        hashed = [grams(t, q) for t in patterns]
        keys = np.concatenate(hashed) if hashed else np.empty(0, U64)
        item = np.repeat(np.arange(len(patterns)), [len(h) for h in hashed]).astype(np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashed]) if hashed else np.empty(0, np.int64)
        by = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[by], return_index=True)
        mask = np.zeros(1 << _SLOTS, bool)
        mask[(distinct >> U64(64 - _SLOTS)).astype(np.int64)] = True
        edits = np.array([budget(len(t), share, q) for t in patterns], np.int64)
        need = np.array([len(t) for t in patterns], np.int64) + 1 - q - edits * q
        by_length: dict[int, dict[bytes, list]] = {}
        for i, t in rows:
            if 0 < len(t) < q:
                by_length.setdefault(len(t), {}).setdefault(t, []).append(i)
        short = {n: (np.unique(np.concatenate([grams(t, n) for t in found])), found) for n, found in by_length.items()}
        return cls([i for i, _ in kept], len(kept), owner, patterns, edits, need, distinct, np.r_[first, len(by)], item[by], place[by], mask, short, q)

    def find_short(self, data: bytes) -> list[tuple]:
        """(item id, start, end, 0) of the short items that stand in the normalised text as whole words, the first place of each."""
        x = np.frombuffer(b" " + data + b" ", np.uint8) == 32
        out: dict[tuple, tuple] = {}
        for n, (keys, items) in sorted(self.short.items()):
            at = np.flatnonzero(x[:-n - 1] & x[n + 1:])
            for k in at[np.isin(grams(data, n)[at], keys)].tolist() if len(at) else []:
                for i in items.get(data[k:k + n], []):
                    out.setdefault((i, n, data[k:k + n]), (i, k, k + n, 0))
        return [out[k] for k in sorted(out)]

    def find(self, data: bytes) -> list[tuple]:
        """(item id, start, end, edits) of items that occur in the normalised text, the best place of each.

        An item found whole is told by that place; else by the place of its segment with the fewest edits.
        """
        return self.find_short(data) + self.find_long(data) if self.short else self.find_long(data)

    def find_long(self, data: bytes) -> list[tuple]:
        g = grams(data, self.q)
        if not len(g) or not len(self.keys):
            return []
        at = np.flatnonzero(self.mask[(g >> U64(64 - _SLOTS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[slot] == g[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        n = self.first[slot + 1] - self.first[slot]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        posting = np.repeat(self.first[slot], n) + offset
        item, diagonal = self.item[posting], np.repeat(at, n) - self.place[posting]
        # Bands of two steps overlap by one, so diagonals that span up to ``edits`` lie in one of them.
        step = self.edits[item] + 1
        band = np.floor_divide(diagonal, step)
        cell_item, cell_band = np.r_[item, item], np.r_[band, band - 1]
        shift = int(cell_band.min())
        width = int(cell_band.max()) - shift + 1
        cells, count = np.unique(cell_item * width + (cell_band - shift), return_counts=True)
        which = cells // width
        good = count >= self.need[which]
        text = np.frombuffer(data, np.uint8)
        best: dict[int, tuple] = {}  # of an item: (is a segment, edits, start, end)
        for k, b in zip(which[good].tolist(), (cells[good] % width + shift).tolist()):
            own, part = self.owner[k], k >= self.wholes
            floor = best.get(own, (True, len(data) + 1, 0, 0))
            if (part, 0) >= floor[:2]:
                continue
            e, pattern = int(self.edits[k]), np.frombuffer(self.patterns[k], np.uint8)
            low = b * (e + 1) - e
            exact = data.find(self.patterns[k], max(0, low), max(0, low + 4 * e + 2) + len(pattern))
            if exact >= 0:  # nothing to align
                best[own] = (part, 0, exact, exact + len(pattern))
                continue
            edits, end = banded_distance(pattern, text, low, low + 2 * (e + 1) - 1 + 2 * e, e)
            if edits <= e and (part, edits) < floor[:2]:
                best[own] = (part, edits, max(0, end - len(pattern)), end)
        return [(self.ids[k], start, end, edits) for k, (_, edits, start, end) in sorted(best.items())]


FOUND = "found array<struct<item_id:long,start:long,end:long,edits:long>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, q: int = Q,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` with ``found``: the benchmark items in each text.

    Item and text are normalised (``normal``). An item counts as found if some stretch of the text is within
    its edit budget: ``share`` of its length, and few enough that the lemma guarantees a common q-gram.
    Shared q-grams are counted in overlapping bands of diagonals, bands with at least length + 1 - q -
    edits * q of them are aligned within the band, and ``start`` and ``end`` (normalised bytes) tell the place.

    An item of more than SEGMENT bytes also counts as found if one of its segments is, each with a budget of its
    own, so a quote of SEGMENT + SEGMENT_STEP bytes is found wherever it is cut; ``start``, ``end`` and ``edits`` are then
    the segment's. An item of fewer than ``q`` bytes counts as found where it stands unchanged as whole words.

    Narrow: texts are never shuffled, so no document or source can be hot. The items go to the tasks in
    blocks of bounded bytes; with several blocks the rows are staged after each, so one index is held at a time.
    Items without normalised bytes, null texts or null ids are not looked for; null and empty documents hold
    nothing; all rows stay, repeated ones too. A column of docs named ``found`` is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("found")
    names = docs.columns
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = F.octet_length("text")
    total = items.agg(F.sum(F.when(size > SEGMENT, size * (1 + SEGMENT // SEGMENT_STEP)).otherwise(size))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.withColumn("found", F.array().cast(FOUND.split(" ", 1)[1]))
    schema = out.schema
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index.build(sorted((r.item_id, normal(r.text)) for r in part.collect()), share, q))

        def look(batches, index=index):
            for batch in steps(batches):
                old = batch.column("found").to_pylist()
                new = [o + [dict(zip(("item_id", "start", "end", "edits"), f)) for f in index.value.find(normal(t))] for o, t in zip(old, batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(new, _FOUND)], [*names, "found"])

        out = out.mapInArrow(look, schema)
        if blocks > 1:
            out = stage(out, "benchmark-block")
            index.destroy()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, q: int = Q) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whole, by a segment or as short words, with their columns."""
    return find_benchmark(docs, benchmark, share, q).filter(F.size("found") == 0).select(*docs.columns)
