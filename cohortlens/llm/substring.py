"""Exact removal of repeated passages, found by recompression.

Words are hashed to symbols; rounds then name short token runs and pairs. A name is a 64-bit hash of
what it stands for, so all tasks give equal substrings equal names without exchanging a dictionary.
Which neighbours merge depends on nothing but the two symbols, so two copies of a passage are cut
alike except for a few words at their ends. The cuts that remain are shared by every pair of equal
windows; the text around a cut is the key by which repeats are found, and whole windows verify them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, WORD_HASHES, join_hash, mix, ordered_bucket, pack_sorted, parts_for, planes, steps, text_bytes, unpack_sorted, unplanes, utf8
from cohortlens.session import stage

_BASE = U64(0x9E3779B97F4A7C15)
#: Bytes of text whose keys one bucket gets.
BUCKET_TEXT = 12_000_000
#: Stands for a null doc_id and sorts before all others.
NULL_ID = -(1 << 63)
_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` symbols from each place on, by doubling; the last size - 1 places wrap and are meaningless."""
    out, done, power, have = np.zeros(len(h), U64), 0, h, 1
    left = size
    while left:
        if left & 1:
            out = join_hash(out, np.roll(power, -done)) if done else power.copy()
            done += have
        left >>= 1
        if left:
            power = join_hash(power, np.roll(power, -have))
            have *= 2
    return out


def caps_for(window: int) -> list[int]:
    """Longest symbols that may merge in each round, so that a window keeps a common cut.

    An end of a window loses two words to the runs and at most the cap to each round of pairs. A third of
    the window is given up at either end: more rounds would make cuts rarer, but leave a window fewer of them to choose from.
    """
    left, caps = (window - 2) // 3 - 2, []
    for cap in (1, 1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32, 32):
        if cap > left:
            break
        caps.append(cap)
        left -= cap
    return caps


def cuts(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the words at which symbols begin after all rounds, ascending.

    First maximal runs of exactly two equal words are named, longer runs stay single words. Then, in each
    round, a symbol with hash bit 0 and its right neighbour with hash bit 1 become one, if both are within the cap.
    """
    at = np.arange(len(h))
    sym, size = mix(h), np.ones(len(h), np.int64)
    if len(h) > 1:
        same = np.r_[False, sym[1:] == sym[:-1], False]  # same[i]: word i equals word i - 1
        second = same[:-1] & ~same[1:] & ~np.r_[False, same[:-2]]
        first = np.r_[second[1:], False]
        sym = np.where(first, mix(sym ^ _BASE), sym)
        size = np.where(first, 2, size)
        at, sym, size = at[~second], sym[~second], size[~second]
    for n, cap in enumerate(caps_for(window)):
        if len(sym) < 2:
            break
        bit = (sym >> U64(n + 7)) & U64(1)
        merge = (bit[:-1] == 0) & (bit[1:] == 1) & (size[:-1] <= cap) & (size[1:] <= cap)
        named = join_hash(sym[:-1], sym[1:])
        sym[:-1] = np.where(merge, named, sym[:-1])
        size[:-1] += np.where(merge, size[1:], 0)
        keep = np.r_[True, ~merge]
        at, sym, size = at[keep], sym[keep], size[keep]
    return at


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): the cuts that some window relies on, and the hash of the words around each.

    A window relies on the smallest-keyed of the common cuts within it, so one cut serves many windows.
    A key covers ``reach`` words on either side; a window's common cuts have at least that many words around them within it.
    """
    n, reach = len(h), _reach(window)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = cuts(h, window)
    at = at[(at >= reach) & (at <= n - reach)]
    keys = window_hashes(h, 2 * reach)[at - reach]
    if not len(at):
        return at, keys
    # For each window start i the cuts in [i + reach, i + window - reach]; their smallest key by blocks of one sliding span.
    span = window - 2 * reach + 1
    rank = np.full(n + 1, np.iinfo(np.uint64).max, U64)
    rank[at] = keys
    least = _sliding_min(rank[reach:n - reach + 1], span)
    chosen = np.zeros(len(at), bool)
    # A cut is relied on if it is the smallest of some span that covers it.
    place = at - reach
    best = _sliding_max(least, span)  # largest of the minima over spans that cover a place
    chosen = best[place] >= keys
    return at[chosen], keys[chosen]


def _reach(window: int) -> int:
    """Words that a window may lose at either end before cuts are common."""
    return 2 + sum(caps_for(window))


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """min(x[i:i + span]) for every full span."""
    have, out = 1, x
    while have * 2 <= span:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = span - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _sliding_max(x: np.ndarray, span: int) -> np.ndarray:
    """For places 0 .. len(x) + span - 2: the largest x[i] over i in [place - span + 1, place] that exist."""
    padded = np.concatenate([np.zeros(span - 1, U64), x, np.zeros(span - 1, U64)])
    return ~_sliding_min(~padded, span)


def _later(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the smallest ``order`` of each distinct key, and which entries have a larger one than their key's smallest."""
    by = np.lexsort((order, keys))
    k = keys[by]
    head = np.r_[True, k[1:] != k[:-1]]
    first = by[head]
    late = np.zeros(len(keys), bool)
    late[by] = order[by] > order[first][np.cumsum(head) - 1]
    return first, late


def _doc_rows(doc: np.ndarray, place: np.ndarray, ids: list, marks: list) -> list[tuple]:
    """(doc_id, text key, places) of documents by number."""
    if not len(doc):
        return []
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return [(ids[doc[a]], marks[doc[a]], place[a:b].astype(np.int32)) for a, b in zip(first, np.r_[first[1:], len(doc)])]


_PLACES = "doc_id long, mark long, places array<int>"
_POSTED = "home int, ids binary, marks binary, counts binary, places binary"


def _posted(doc: np.ndarray, place: np.ndarray, ids: list, marks: list, homes: int) -> pa.Table:
    """Places of documents by number, packed in one row for each home of documents."""
    i, m = np.array(ids, np.int64), np.array(marks, np.int64)
    home = np.mod(m[doc], homes) if len(doc) else np.empty(0, np.int64)
    by = np.lexsort((place, doc, home))
    doc, place, home = doc[by], place[by], home[by]
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    ends = np.r_[head[1:], len(doc)].astype(np.int64)
    bounds = np.searchsorted(home[head], np.arange(homes + 1))
    rows = []
    for h in np.flatnonzero(bounds[1:] > bounds[:-1]):
        a, b = bounds[h], bounds[h + 1]
        d = doc[head[a:b]]
        rows.append((h, i[d].tobytes(), m[d].tobytes(), (ends - head)[a:b].astype(np.uint32).tobytes(), planes(place[head[a]:ends[b - 1]].astype(np.uint32))))
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], [x.split()[0] for x in _POSTED.split(", ")])


def _gathered(posted: DataFrame) -> DataFrame:
    """One row per document: its sorted places."""
    def gather(key, table):
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        ids, marks = (np.repeat(np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]), counts) for c in ("ids", "marks"))
        place = np.concatenate([unplanes(x, np.uint32) for x in table.column("places").to_pylist()]).astype(np.int32)
        by = np.lexsort((place, marks, ids))
        ids, marks, place = ids[by], marks[by], place[by]
        head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(ids)].astype(np.int32)), pa.array(place))
        return pa.table([pa.array(ids[head]), pa.array(marks[head]), lists], ["doc_id", "mark", "places"])

    return posted.groupBy("home").applyInArrow(gather, _PLACES)


_SENT = "bucket int, keys binary, docs binary, places binary, ids array<long>, marks array<long>, done array<int>"
_KINDS = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [x.split()[0] for x in _SENT.split(", ")])


def _send(keys, doc, place, ids, marks, buckets) -> list[tuple]:
    """One row for each bucket: keys ascending within it, with the number of their document and their place."""
    by = np.argsort(keys, kind="stable")
    keys, doc, place = keys[by], doc[by].astype(np.uint32), place[by].astype(np.uint32)
    to = ordered_bucket(keys, buckets).astype(np.int64)
    bounds = np.searchsorted(to, np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        s = slice(bounds[b], bounds[b + 1])
        if bounds[b] < bounds[b + 1]:
            used, local = np.unique(doc[s], return_inverse=True)
            rows.append((b, pack_sorted(keys[s]), planes(local.astype(np.uint32)), planes(place[s]), [ids[k] for k in used], [marks[k] for k in used], None))
    return rows


def _received(table: pa.Table) -> tuple:
    """Keys, document numbers, places, ids and marks of all rows of a bucket."""
    keys, doc, place, ids, marks = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
    for k, d, p, i, m in zip(*(table.column(c).to_pylist() for c in ("keys", "docs", "places", "ids", "marks"))):
        keys.append(unpack_sorted(k))
        doc.append(unplanes(d, np.uint32).astype(np.int64) + len(ids))
        place.append(unplanes(p, np.uint32).astype(np.int64))
        ids.extend(i)
        marks.extend(m)
    return np.concatenate(keys), np.concatenate(doc), np.concatenate(place), ids, marks


def _order(ids: list, marks: list, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers that order occurrences by (doc_id, mark, place); equal for the same place of the same document."""
    i, m = np.array(ids, np.int64), np.array(marks, np.int64)
    by = np.lexsort((m, i))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.r_[0, (np.diff(i[by]) != 0) | (np.diff(m[by]) != 0)])
    return (rank[doc] << 32) + place


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for k, text in enumerate(batch.column("text").to_pylist()):
        words = utf8(text).split()
        yield k, WORD_HASHES.of(words)


def _shared_cuts(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Places of cuts whose surrounding words occur elsewhere too: (doc_id, mark, places)."""
    def emit(batches):
        for batch in steps(batches):
            keys, doc, place = [], [], []
            for k, h in _hashed(batch):
                at, key = anchors(h, window)
                keys.append(key), doc.append(np.full(len(at), k)), place.append(at)
            keys, doc, place = np.concatenate(keys), np.concatenate(doc), np.concatenate(place)
            if len(keys):
                yield _batch(_send(keys, doc, place, batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), buckets))

    def match(key, table):
        keys, doc, place, ids, marks = _received(table)
        by = np.argsort(keys, kind="stable")
        k = keys[by]
        same = np.r_[False, k[1:] == k[:-1]]
        shared = by[same | np.r_[same[1:], False]]
        return _posted(doc[shared], place[shared], ids, marks, buckets)

    return docs.mapInArrow(emit, _SENT).groupBy("bucket").applyInArrow(match, _POSTED)


def _later_windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Starts of windows whose words also start earlier: (doc_id, mark, places); docs carry the shared cuts.

    Of the occurrences of a window in one step of a task only the earliest is sent on; the others are
    known to be later, so a passage that fills a third of all rows costs each task one entry.
    """
    reach = _reach(window)

    def emit(batches):
        for batch in steps(batches):
            ids, marks, found = (batch.column(c).to_pylist() for c in ("doc_id", "mark", "places"))
            keys, doc, place = [], [], []
            for k, h in _hashed(batch):
                if not found[k] or len(h) < window:
                    continue
                at = np.array(found[k], np.int64)
                starts = np.unique((at[:, None] - np.arange(reach, window - reach + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(h) - window)]
                keys.append(window_hashes(h, window)[starts]), doc.append(np.full(len(starts), k)), place.append(starts)
            if not keys:
                continue
            keys, doc, place = np.concatenate(keys), np.concatenate(doc), np.concatenate(place)
            first, late = _later(keys, _order(ids, marks, doc, place))
            done = [(m % buckets, None, None, None, [i], [m], p) for i, m, p in _doc_rows(doc[late], place[late], ids, marks)]
            yield _batch(_send(keys[first], doc[first], place[first], ids, marks, buckets) + done)

    def match(key, table):
        own = pa.compute.is_valid(table.column("done"))
        told = table.filter(own)
        keys, doc, place, ids, marks = _received(table.filter(pa.compute.invert(own)))
        late = _later(keys, _order(ids, marks, doc, place))[1] if len(keys) else np.zeros(0, bool)
        done = [np.array(x, np.int64) for x in told.column("done").to_pylist()]
        number = [np.full(len(x), len(ids) + n) for n, x in enumerate(done)]
        ids, marks = (a + [x[0] for x in told.column(c).to_pylist()] for a, c in ((ids, "ids"), (marks, "marks")))
        return _posted(np.concatenate([doc[late], *number]).astype(np.int64), np.concatenate([place[late], *done]).astype(np.int64), ids, marks, buckets)

    return docs.mapInArrow(emit, _SENT).groupBy("bucket").applyInArrow(match, _POSTED)


def kept_words(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """Which words no removed window covers."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, len(words)), -1)
    return np.cumsum(change[:-1]) == 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_mark", F.xxhash64("text"))


def _beside(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Rows with the places of their document. The places are hashed and the texts streamed, not sorted."""
    p = places.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("places").alias("_places"))
    return rows.join(p.hint("shuffle_hash"), ["_id", "_mark"], how)


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """Starts of windows whose words also start earlier: (doc_id, mark, places), documents without any left out.

    ``mark`` is the xxhash64 of the text, and a null doc_id is written as the smallest number. "Earlier"
    is a smaller doc_id, or an earlier start in the same document; null ids come first. Rows that repeat
    doc_id and text are one document; different texts of one doc_id are ordered by their mark.
    """
    rows = _keyed(docs).select("_id", "_mark", "text")
    buckets = parts_for(rows.sparkSession, text_bytes(rows), BUCKET_TEXT)
    named = rows.select(F.col("_id").alias("doc_id"), F.col("_mark").alias("mark"), "text")
    shared = stage(_gathered(_shared_cuts(named, window, buckets)), "shared-cuts")
    found = _beside(rows, shared, "inner").select(F.col("_id").alias("doc_id"), F.col("_mark").alias("mark"), "text", F.col("_places").alias("places"))
    return stage(_gathered(_later_windows(found, window, buckets)), "late-windows")


def removal_report(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; see ``repeated_windows``.

    A null or empty text has no words and the digest of nothing. Other columns are ignored.
    """
    def report(batches):
        for batch in steps(batches):
            rows = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = utf8(text).split()
                n = len(words)
                if places:
                    words = [w for w, k in zip(words, kept_words(words, np.array(places, np.int64), window)) if k]
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            n, gone, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _beside(rows, repeated_windows(docs, window), "left").select("doc_id", "text", F.col("_places").alias("places")).mapInArrow(report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, starts: np.ndarray, window: int) -> str:
    """The text without the covered words and the white space after each."""
    data = utf8(text)
    spans = [m.span() for m in _WORD_BYTES.finditer(data)]
    keep = kept_words(spans, starts, window)
    if keep.all():
        return text
    ends = [s[0] for s in spans[1:]] + [len(data)]
    return (data[:spans[0][0]] + b"".join(data[a:e] for (a, _), e, k in zip(spans, ends, keep) if k)).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut from ``text``, its white space kept, and ``n_chars`` brought up to date.

    All rows and columns stay, whatever their names; a text that is repeated throughout becomes empty; null texts stay null.
    """
    taken = {c.lower() for c in docs.columns} | {"_id", "_mark", "_places"}
    names = []
    for c in docs.columns:
        while c.lower() in ("_id", "_mark", "_places") or c in names:
            c = f"{c}_"
            while c.lower() in taken:
                c = f"{c}_"
        names.append(c)
    docs, schema = docs.toDF(*names), docs.schema
    both = _beside(_keyed(docs), repeated_windows(docs.select("doc_id", "text"), window), "left").select(*names, "_places")

    def cut(batches):
        for batch in steps(batches):
            found = batch.column("_places").to_pylist()
            texts = [t if not p else cut_text(t, np.array(p, np.int64), window) for t, p in zip(batch.column("text").to_pylist(), found)]
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if t is not None and p else c for t, p, c in zip(texts, found, batch.column("n_chars").to_pylist())], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema.names)

    return both.mapInArrow(cut, schema)
