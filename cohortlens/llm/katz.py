"""Katz backoff language model of any order: Good-Turing discounted n-grams over smoothed words, exactly normalised.

Every word has its own n-grams, keyed by 64-bit hashes of all their words; nothing is cut by frequency. What grows
with the corpus (slices of texts, counts of each order, sums over each context) stays in staged tables; the driver
and every task get some numbers for each order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, WORD_HASHES, join_hash, ordered_bucket, parts_for, planes, steps, unplanes, utf8
from cohortlens.session import stage

#: Words of an n-gram at most.
ORDER = 3
#: Counts up to this one are discounted.
DISCOUNTED = 5
SLICE_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000
_START, _END = U64(0x5DEECE66D1CE4E5B), U64(0xA3EC647659359ACD)


@dataclass
class Classes:
    """Tokens and their base distribution where all fit in one array: counts of words, then end, rest, start."""

    words: np.ndarray
    counts: np.ndarray  # of words
    ends: int  # training texts
    tokens: int  # training tokens, ends included
    types: int  # distinct training tokens, the end included

    def __post_init__(self):
        self.total = self.tokens + 0.5 * (self.types + 1)
        p = (np.r_[self.counts, self.ends] + 0.5) / self.total
        self.base = np.r_[p, max(1 - p.sum(), 1e-300), 0.0]
        # Occurrences as a context.
        self.seen = np.r_[self.counts, 0, self.tokens - self.ends - self.counts.sum(), self.ends].astype(np.int64)


@dataclass
class Level:
    """What one order backs off to: occurrences of its contexts and the probabilities of the order below."""

    seen: np.ndarray
    base: np.ndarray


@dataclass
class Backoff:
    """Discounts by count and, for each context, its denominator's factor and its backoff weight."""

    discount: np.ndarray
    factor: np.ndarray
    weight: np.ndarray

    def probability(self, level: Level | Classes, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """P(word | context): the discounted n-gram, or else what the order below gives, weighted."""
        seen = self.discount[np.minimum(count, DISCOUNTED + 1)] * count * self.factor[context] / np.maximum(level.seen[context], 1)
        return np.where(count > 0, seen, self.weight[context] * level.base[word])


def good_turing(of_counts: np.ndarray) -> np.ndarray:
    """Discount of each count 0 .. DISCOUNTED + 1 from the numbers of n-grams seen 0 .. DISCOUNTED + 1 times.

    Katz's formula where it gives a value in (0, 1]; 1 - 0.5 / r where the counts of counts are too uneven for it.
    """
    d = np.ones(DISCOUNTED + 2)
    n = of_counts.astype(float)
    common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        d[r] = value if 0 < value <= 1 else 1 - 0.5 / r
    return d


def weigh(discount: np.ndarray, seen: np.ndarray, kept: np.ndarray, base: np.ndarray) -> Backoff:
    """Weights that make each context's probabilities add up to one.

    kept[h]: discounted occurrences of the context's n-grams; base[h]: probability of all its seen words one order
    below. A context whose discounts leave nothing for unseen words gets one more in its denominator; one that
    has seen every word is scaled to one.
    """
    n = np.maximum(seen, 1).astype(float)
    kept = kept / n
    factor = np.where(1 - kept < 1e-9, n / (n + 1), 1.0)
    open_ = 1 - base
    left = 1 - kept * factor
    closed = open_ < 1e-9
    factor = np.where(closed & (kept > 0), 1 / np.where(kept > 0, kept, 1), factor)
    return Backoff(discount, factor, np.where(closed, 0.0, left / np.where(closed, 1, open_)))


def backoff(classes: Classes, of_counts: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray) -> Backoff:
    """``weigh`` from low[h, r], n-grams of the context seen r times, and high[h], occurrences of those seen more than DISCOUNTED times."""
    d = good_turing(of_counts)
    return weigh(d, classes.seen, low @ (d[:DISCOUNTED + 1] * np.arange(DISCOUNTED + 1)) + high, base)


@dataclass
class Totals:
    """Training texts, tokens and distinct tokens (ends included), the denominator of the smoothed words, and discounts by order."""

    texts: int
    tokens: int
    types: int
    total: float
    discounts: dict[int, np.ndarray]


def _zip(values: np.ndarray) -> bytes:
    return pa.compress(memoryview(planes(values)), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def _unzip(data: bytes, dtype=np.int64) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    return unplanes(pa.decompress(memoryview(data)[:-8], n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=U64(0)))


def _unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, U64), dtype=U64)


def _zip_floats(values: np.ndarray) -> bytes:
    """Few distinct values: each once, and which stands where."""
    distinct, _, of = _distinct(np.ascontiguousarray(values).view(U64))
    table = _zip_sorted(distinct)
    return len(table).to_bytes(8, "little") + table + _zip(of)


def _unzip_floats(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    return _unzip_sorted(data[8:end]).view(float)[_unzip(data[end:], np.int32)]


def _marked(at: np.ndarray, n: int) -> np.ndarray:
    marks = np.zeros(n, bool)
    marks[at] = True
    return marks


def _by_frequency(total: np.ndarray) -> np.ndarray:
    """Words from the most frequent on: small numbers for most tokens."""
    return np.argsort(-total, kind="stable")


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, a place of each, and which of them stands at each place."""
    by_value = np.argsort(ids)
    ids = ids[by_value]
    new = np.r_[True, ids[1:] != ids[:-1]][:len(ids)]
    of = np.empty(len(ids), np.int32)
    of[by_value] = np.cumsum(new) - 1
    return ids[new], by_value[new], of


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    bounds = np.searchsorted(ordered_bucket(keys, buckets).astype(np.int64), np.arange(buckets + 1))
    return [(b, x, y) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y]


def _sliced(batches):
    """Rows of some texts each: ids, folds, lengths, the distinct words' hashes, counts in training and in all, and the rank by frequency of each token's word."""
    first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def packed() -> pa.RecordBatch:
        texts, learn, ids = (pa.chunked_array([x.column(c) for x in held]).to_pylist() for c in ("text", "learn", "doc_id"))
        h = [WORD_HASHES.of(utf8(t).lower().split()) for t in texts]
        lengths = np.array([len(x) + 1 for x in h], np.int64)
        word = np.full(int(lengths.sum()), _END)
        is_word = np.ones(len(word), bool)
        is_word[np.cumsum(lengths) - 1] = False
        word[is_word] = np.concatenate(h)
        words, _, of = _distinct(word)
        n, total = (np.bincount(x, minlength=len(words)) for x in (of[np.repeat(np.array(learn, bool), lengths)], of))
        rank = np.empty(len(words), np.int32)
        rank[_by_frequency(total)] = np.arange(len(words))
        return _rows([(first + made, ids, learn, sum(learn), size, _zip(lengths), _zip_sorted(words), _zip(n), _zip(total), _zip(rank[of]))], _SLICES).to_batches()[0]

    for batch in steps(batches):
        more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + more > SLICE_BYTES:
            yield packed()
            made, held, size = made + 1, [], 0
        held.append(batch)
        size += more
    if held:
        yield packed()


class _Slice:
    """N-grams of the texts of one slice by order: distinct keys, which stands at each token, counts in training, and for each
    n-gram its context (an n-gram one shorter, or the starts, which come last) and what is left without its first word.

    An n-gram that only one slice holds is counted there. So is each longer one around it, which is not asked for.
    """

    def __init__(self, row: pa.Table, answers: pa.Table, order: int, answered: int, buckets: int):
        r = row.to_pylist()[0]
        self.ids, self.learn, self.order, self.buckets = r["ids"], r["learn"], order, buckets
        self.lengths = _unzip(r["lengths"])
        self.first = np.cumsum(self.lengths) - self.lengths
        words = _unzip_sorted(r["words"])
        at = _by_frequency(_unzip(r["total"])).astype(np.int32)[_unzip(r["tokens"], np.int32)]
        teaches = np.repeat(np.array(r["learn"], bool), self.lengths)
        self.told: dict[tuple[str, int], list] = {}
        for kind, k, *data in zip(*(answers.column(c).to_pylist() for c in ("kind", "k", "bucket", "a", "b"))):
            self.told.setdefault((kind, k), []).append(data)
        self.keys, self.of, self.n, self.context, self.shorter, self.asked, self.count, self.own, self.alone, self.held, self.starts = ({} for _ in range(11))
        ids = word = words[at]
        start = _START
        for k in range(1, order + 1):
            if k == 1:
                self.keys[k], self.of[k], known = words, at, np.zeros(len(words), bool)
            else:
                before, m = np.r_[start, ids[:-1]], len(self.keys[k - 1])
                before[self.first] = start
                ids, self.starts[k] = join_hash(before, word), start
                start = join_hash(np.array([start]), np.array([_START]))[0]
                self.keys[k], place, self.of[k] = _distinct(ids)
                context = np.r_[np.int32(m), self.of[k - 1][:-1]]
                context[self.first] = m
                self.context[k], self.shorter[k] = context[place], self.of[k - 1][place]
                known = self.alone[k - 1][self.shorter[k]] | np.r_[self.alone[k - 1], False][self.context[k]]
            self.n[k] = np.bincount(self.of[k][teaches], minlength=len(self.keys[k]))
            self.asked[k] = np.flatnonzero(~known)
            if k <= answered:
                told, _ = self._answers("count", k, self.keys[k][self.asked[k]], np.int64, _unzip)
                self.count[k], self.own[k], self.alone[k] = self.n[k].copy(), self.n[k] > 0, known
                self.held[k] = np.zeros(len(known), bool)
                for of, x in ((self.own, told & 1 == 1), (self.alone, told & 2 == 2), (self.held, told & 4 == 4), (self.count, told >> 3)):
                    of[k][self.asked[k]] = x

    def _answers(self, kind: str, k: int, keys: np.ndarray, dtype, unzip) -> tuple[np.ndarray, np.ndarray]:
        """Answers to ascending keys, in their order."""
        out, where = (np.zeros(len(keys), dtype), np.zeros(len(keys), dtype)), {b: (x, y) for b, x, y in _by_bucket(keys, self.buckets)}
        for b, *data in self.told.get((kind, k), ()):
            x, y = where[b]
            for values, d in zip(out, data):
                if d is not None:
                    values[x:y] = unzip(d)
        return out

    def questions(self, of: int, k: int) -> list[tuple]:
        """Order k's n-grams that other slices may hold; counts of the counts of the rest go to any bucket."""
        keys, n = self.keys[k][self.asked[k]], _taught_and_held(self.n[k], np.bincount(self.of[k], minlength=len(self.keys[k])))[self.asked[k]]
        rest = self.n[k].copy()
        rest[self.asked[k]] = -1
        return [("count", k, of % self.buckets, of, None, None, _of_counts(rest[rest >= 0]).tobytes(), None), *_count_questions(k, of, keys, n, self.buckets)]

    def learn_contexts(self, totals: Totals, order: int, sums_from: int = 2) -> None:
        """Contexts of orders 2 to ``order``, their occurrences, sums over the n-grams owned here, and which of them to ask for.

        A context is open for certain when one of its n-grams here leaves something to unseen words and so does one of its shorter
        context; at order 2, when it has not occurred often enough to be followed by nearly all words. Open contexts have factor 1,
        so their sums matter only where an n-gram was not seen in training, which takes a text held out that holds the context.
        """
        self.seen, self.kept, self.mass, self.ask, self.open, self.shorter_context = ({} for _ in range(6))
        self.base = below = (self.count[1] + 0.5) / totals.total
        for k in range(2, order + 1):
            c, context, m = self.count[k], self.context[k], len(self.keys[k - 1]) + 1
            alone = np.r_[self.alone[k - 1], False]
            seen = self.seen[k] = np.r_[self.count[k - 1], totals.texts]
            share, of = totals.discounts[k][np.minimum(c, DISCOUNTED + 1)] * c, seen[context]
            self.open[k] = _marked(context[c - share > 1e-7 * of], m)
            if k > 2:
                # All n-grams of a context have the same shorter context.
                self.shorter_context[k] = np.zeros(m, np.int32)
                self.shorter_context[k][context] = self.context[k - 1][self.shorter[k]]
            self.open[k] &= self.open[k - 1][self.shorter_context[k]] if k > 2 else 1.5 * (totals.types - seen) + 0.5 > 1e-7 * totals.total
            if k >= sums_from:
                self.kept[k] = np.bincount(context, share * self.own[k], m)
                self.mass[k] = np.bincount(context, below[self.shorter[k]] * self.own[k], m)
            below = share / np.maximum(of, 1)
            ask = np.flatnonzero(_marked(context, m) & (seen > 0) & ~alone & (np.r_[self.held[k - 1], True] | ~self.open[k]))
            self.ask[k] = ask[np.argsort(self._contexts(k)[ask], kind="stable")]

    def _contexts(self, k: int) -> np.ndarray:
        return np.r_[self.keys[k - 1], self.starts[k]]

    def context_questions(self, of: int, k: int) -> list[tuple]:
        wanted = _marked(self.context[k][self.count[k] == 0], len(self.seen[k]))
        keys, n, kept, mass = (x[self.ask[k]] for x in (self._contexts(k), wanted.astype(np.int64) << 1 | self.open[k], self.kept[k], self.mass[k]))
        return [("context", k, b, of, _zip_sorted(keys[x:y]), _zip(n[x:y]), _zip_floats(kept[x:y]), _zip_floats(mass[x:y])) for b, x, y in _by_bucket(keys, self.buckets)]

    def score(self, totals: Totals) -> np.ndarray:
        """Probability of each token: order by order, each n-gram backing off to the one below."""
        p, factor = self.base, None
        for k in range(2, self.order + 1):
            kept, mass = (np.where(np.r_[self.alone[k - 1], False], x, 0.0) for x in (self.kept[k], self.mass[k]))
            kept[self.ask[k]], mass[self.ask[k]] = self._answers("context", k, self._contexts(k)[self.ask[k]], float, _unzip_floats)
            # The shorter context's factor stands before the sum.
            model = weigh(totals.discounts[k], self.seen[k], kept, mass if factor is None else mass * factor[self.shorter_context[k]])
            p = model.probability(Level(self.seen[k], p), self.context[k], self.shorter[k], self.count[k])
            factor = model.factor
        return p[self.of[self.order]]


_SLICES = "slice long, ids array<long>, learn array<boolean>, taught long, size long, lengths binary, words binary, n binary, total binary, tokens binary"
_ASKED = "kind string, k int, bucket int, slice long, keys binary, n binary, a binary, b binary"
_TOLD = "kind string, k int, bucket int, slice long, a binary, b binary"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, _KINDS[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(names), names)], [n for n, _ in names])


def _of_counts(count: np.ndarray) -> np.ndarray:
    """How many n-grams have each count 0 .. DISCOUNTED + 1."""
    return np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[:DISCOUNTED + 2].astype(np.int64)


def _taught_and_held(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return n << 1 | (total > n)


def _count_questions(k: int, of: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    return [("count", k, b, of, _zip_sorted(keys[x:y]), _zip(n[x:y]), None, None) for b, x, y in _by_bucket(keys, buckets)]


def _meet(table: pa.Table):
    """Questions of all slices to one bucket, by slice: slices, distinct keys, and where each slice's keys are among them."""
    table = table.sort_by("slice")
    keys = [_unzip_sorted(x) for x in table.column("keys").to_pylist()]
    distinct, _, inverse = _distinct(np.concatenate([np.empty(0, U64), *keys]))
    return table, distinct, inverse, np.cumsum([len(x) for x in keys])[:-1]


def _joined(table: pa.Table, column: str, unzip=_unzip) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(unzip(x) for x in table.column(column).to_pylist())])


def _answer_counts(k: int, bucket: int, table: pa.Table) -> list[tuple]:
    """Counts of n-grams. Below them, a bit says that a text held out holds the n-gram, one that only one slice asks for it, and
    the lowest that this slice, the first that saw it in training, owns it."""
    of_counts = sum((np.frombuffer(x, np.int64) for x in table.column("a").to_pylist() if x is not None), np.zeros(DISCOUNTED + 2, np.int64))
    table, distinct, inverse, cuts = _meet(table.filter(pc.is_valid(table.column("keys"))))
    n = _joined(table, "n")
    held = np.bincount(inverse[n & 1 == 1], minlength=len(distinct)) > 0
    n = n >> 1
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, inverse, n)
    owner = np.full(len(distinct), -1, np.int64)
    taught = np.flatnonzero(n > 0)[::-1]
    owner[inverse[taught]] = taught
    alone = np.bincount(inverse, minlength=len(distinct)) == 1
    told = (count << 3 | held << 2 | alone << 1)[inverse] | (owner[inverse] == np.arange(len(n)))
    rows = [("count", k, bucket, s, _zip(x), None) for s, x in zip(table.column("slice").to_pylist(), np.split(told, cuts))]
    return [*rows, ("total", k, bucket, None, (of_counts + _of_counts(count)).tobytes(), np.array([count.sum(), (count > 0).sum()], np.int64).tobytes())]


def _answer_contexts(k: int, bucket: int, table: pa.Table) -> list[tuple]:
    """Sums of contexts: told where a slice backs off from them or where none knows them to be open, else zeros, which pack to nothing."""
    table, distinct, inverse, cuts = _meet(table)
    n = _joined(table, "n")
    kept, mass = (np.bincount(inverse, _joined(table, c, _unzip_floats), len(distinct)) for c in "ab")
    shut = np.bincount(inverse[n & 1 == 1], minlength=len(distinct)) == 0
    tell = (n & 2 == 2) | shut[inverse]
    kept, mass = (np.split(np.where(tell, x[inverse], 0.0), cuts) for x in (kept, mass))
    return [("context", k, bucket, s, _zip_floats(x), _zip_floats(y)) for s, x, y in zip(table.column("slice").to_pylist(), kept, mass)]


def _answer(key, table):
    kind, k, bucket = (x.as_py() for x in key)
    return _rows({"count": _answer_counts, "context": _answer_contexts}[kind](k, bucket, table), _TOLD)


def _add_totals(before: Totals, told: DataFrame, k: int) -> Totals:
    """With order k, from one row of some numbers for each bucket."""
    of, sums = np.zeros(DISCOUNTED + 2, np.int64), np.zeros(2, np.int64)
    for r in told.filter("kind = 'total'").select("a", "b").toLocalIterator():
        of += np.frombuffer(r.a, np.int64)
        sums += np.frombuffer(r.b, np.int64)
    tokens, types = (int(x) for x in sums) if k == 1 else (before.tokens, before.types)
    return Totals(before.texts, tokens, types, tokens + 0.5 * (types + 1), before.discounts | {k: good_turing(of)})


def score_texts(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and score every row's whole text.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are the words with
    A-Z lower-cased and one end; texts begin after order - 1 starts. ``base_score`` is the smoothed unigram's
    log10 probability of the text, ``score`` that of the model of n-grams up to ``order``, whose probabilities of
    all words of the training texts, the end and an unseen word add up to one after any context.

    Texts become slices of bounded size, staged once as words numbered within the slice. Order by order, each slice
    asks once for each distinct n-gram that other slices may hold, the question carrying its own training count, and
    once for each context of the order before that other slices hold and whose sums can matter, the question carrying
    its sums over the n-grams that the slice owns. So counting and looking up are one exchange of packed rows each, whose files go when its answers
    are staged. Keys are dealt by hashes of whole n-grams and combined within slices, so no word or context is a hot key.

    Null and empty texts are one end; null and repeated ids are kept row by row; a null held_out counts as
    false; other columns are ignored. Without training rows both scores are those of an unseen token each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~F.coalesce(held_out, F.lit(False))).alias("learn"))
    slices = stage(rows.mapInArrow(_sliced, _SLICES), "lm-slices")
    size, texts = slices.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("taught"), F.lit(0))).first()
    buckets = parts_for(spark, size, BUCKET_BYTES)

    def ask_words(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = _count_questions(1, r["slice"], _unzip_sorted(r["words"]), _taught_and_held(_unzip(r["n"]), _unzip(r["total"])), buckets)
                yield from _rows(rows, _ASKED).to_batches()

    def answered(asked: DataFrame) -> DataFrame:
        return stage(asked.groupBy("kind", "k", "bucket").applyInArrow(_answer, _TOLD), "lm-answers", drop_shuffles=True)

    def with_answers(answers: DataFrame, work, schema: str) -> DataFrame:
        """work(slice, its row, its answers) for every slice."""
        def one(key, row, told):
            return work(key[0].as_py(), row, told) if row.num_rows else _rows([], schema)

        return slices.drop("n").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(one, schema)

    def ask(k: int, totals):
        """Questions for counts of order k and for contexts of the order before."""
        def work(of, row, told):
            s = _Slice(row, told, min(k, order), k - 1, buckets)
            s.learn_contexts(totals.value, k - 1, k - 1)
            return _rows([*(s.questions(of, k) if k <= order else ()), *(s.context_questions(of, k - 1) if k > 2 else ())], _ASKED)

        return work

    answers = answered(slices.select("slice", "words", "n", "total").mapInArrow(ask_words, _ASKED))
    known = _add_totals(Totals(texts, 0, 0, 0.0, {}), answers, 1)
    totals = spark.sparkContext.broadcast(known)
    for k in range(2, order + 2 if order > 1 else 2):
        told = answered(with_answers(answers.filter("kind = 'count'"), ask(k, totals), _ASKED))
        if k <= order:
            known = _add_totals(known, told, k)
            totals = spark.sparkContext.broadcast(known)
        answers = answers.union(told)

    def score(of, row, told):
        t, s = totals.value, _Slice(row, told, order, order, buckets)
        s.learn_contexts(t, order)
        known, base, p = (np.add.reduceat(x, s.first) for x in ((s.count[1] > 0).astype(np.int64)[s.of[1]], np.log10(s.base)[s.of[1]], np.log10(s.score(t))))
        return _rows([(i, not learn, *x) for i, learn, *x in zip(s.ids, s.learn, s.lengths.tolist(), known.tolist(), [t.tokens] * len(known), base.tolist(), p.tolist())], _SCORES)

    return with_answers(answers.filter("kind <> 'total'"), score, _SCORES)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
