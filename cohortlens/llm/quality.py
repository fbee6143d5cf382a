"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import crc_fold, steps, utf8
from cohortlens.session import stage

#: Labelled documents that a model is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 40_000
FEATURES = ("log_chars", "log_words", "word_mean", "word_std", "word_max", "upper", "digit", "space", "punct", "symbol", "other",
            "shout_words", "symbol_words", "marked_ends", "pipes", "exclaims", "commas", "stops", "line_mean", "repeated_lines",
            "repeated_words", "repeated_pairs", "top_word", "byte_entropy", "high_bytes", "log_lines")
_KIND = np.full(256, 5, np.int8)  # other
for _chars, _code in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2), (" \t\n\r\x0b\x0c", 3),
                      (".,;:!?'\"()-", 4), ("#$%&*+/<=>@[\\]^_`{|}~", 6)):
    _KIND[[ord(c) for c in _chars]] = _code
_END_MARKS = frozenset(b"#$%&*!")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe one whole text; an empty one has zeros throughout."""
    data = utf8(text)
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(data), len(words)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, bytes_, minlength=7)
    lengths = np.fromiter(map(len, words), np.int32, m)
    counts = Counter(words)
    upper = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper())
    marked = sum(c for w, c in counts.items() if len(w) > 2 and w[-1] in _END_MARKS and w[-2] == w[-1])
    symbols = sum(c for w, c in counts.items() if not w.isalnum() and not any(97 <= b <= 122 or 65 <= b <= 90 or b > 127 for b in w))
    lines = [x for x in data.split(b"\n") if x]
    p = bytes_[bytes_ > 0] / n
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n), math.log1p(m), float(lengths.mean()), float(lengths.std()), float(min(lengths.max(), 200)),
        kinds[0] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[6] / n, kinds[5] / n,
        upper / m, symbols / m, marked / m, bytes_[124] / m, bytes_[33] / m, bytes_[44] / m, bytes_[46] / m,
        n / len(lines) if lines else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - len(counts) / m, 1 - pairs / max(m - 1, 1) if m > 1 else 0.0, counts.most_common(1)[0][1] / m,
        float(-(p * np.log2(p)).sum()), float(bytes_[128:].sum() / n), math.log1p(len(lines))]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row; nulls and empty texts have zeros."""
    def measure(batches):
        for batch in steps(batches):
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, x array<double>")


@dataclass
class Trees:
    """Complete binary trees as flat arrays: node k has the children 2k+1 and 2k+2; leaves are the last level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right where x > threshold
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def to_json(self) -> str:
        return json.dumps({"base": self.base, **{k: getattr(self, k).tolist() for k in ("feature", "threshold", "value")}})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        return cls(d["base"], np.array(d["feature"], np.int64), np.array(d["threshold"]), np.array(d["value"]))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
         penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting on histograms of quantile bins; each level's histograms are one ``bincount``.

    A split needs a hessian sum of ``least`` on both sides; nodes without one pass all rows to the left.
    Without rows, or with one class only, the trees are none and the base is the smoothed class share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    k = x.shape[1]
    margin = np.full(len(y), base)
    feature, threshold, value = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f_all, t_all = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2 ** level - 1, 2 ** level
            local = at - first
            cell = (local[:, None] * k + np.arange(k)) * bins + binned
            G = np.bincount(cell.ravel(), np.repeat(g, k), nodes * k * bins).reshape(nodes, k, bins)
            H = np.bincount(cell.ravel(), np.repeat(h, k), nodes * k * bins).reshape(nodes, k, bins)
            gl, hl = G.cumsum(2), H.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt ** 2 / (ht + penalty)
            gain[(hl < least) | (ht - hl < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e):] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // bins, best % bins
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            f_all[first:first + nodes] = f
            t_all[first:first + nodes] = [edges[j][c] if ok else np.inf for j, c, ok in zip(f, b, good)]
            at = 2 * at + 1 + (x[np.arange(len(y)), f_all[at]] > t_all[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        margin += v[leaf]
        feature.append(f_all)
        threshold.append(t_all)
        value.append(v)
    return Trees(base, np.array(feature), np.array(threshold), np.array(value))


def fit(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from (doc_id, x) and labels (doc_id, quality).

    The fit is on at most ``sample_rows`` labelled documents, the ones with the smallest hash of their
    id, so the sample does not depend on layout. A document labelled more than once takes the mean label,
    rounded (a tie counts as 1); null ids and labels are left out; a document that repeats is taken once.
    """
    told = (labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y")))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = measured.join(told, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "x", "y").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return grow(x, rows["y"].to_numpy(float))


def apply(measured: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score, predicted) of every row of (doc_id, x)."""
    packed = trees.to_json()

    def traverse(batches):
        model = Trees.from_json(packed)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return measured.mapInArrow(traverse, "doc_id long, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, held_modulus: int = 3, held_remainder: int = 1,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels of held-out rows (crc32 of the id as text, modulo) are never read. Scores use statistics of the
    whole text only. Null and empty texts are scored on zeros; null and repeated ids are kept row by row;
    other columns are ignored; without labels every score is 0.5; an empty table gives no rows.
    """
    held = crc_fold("doc_id", held_modulus) == held_remainder
    measured = stage(features(docs), "quality-features")
    trees = fit(measured, labels.filter(~held), sample_rows)
    return apply(measured, trees).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    Texts are read twice, once for the statistics that are joined with the labels and once to filter, and
    never shuffled. All labels may teach. Rows with null or repeated ids are judged like others.
    """
    names = docs.columns
    packed = fit(stage(features(docs), "quality-features"), labels, sample_rows).to_json()

    def choose(batches):
        model = Trees.from_json(packed)
        for batch in steps(batches):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.select(*names).mapInArrow(choose, docs.schema)
