"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, WORD_HASHES, components, join_hash, joined_components, mix, steps, utf8
from cohortlens.session import stage

_LONE = U64(0xA5A5F00D)
#: Members of one bucket that one block holds when members of different components are compared.
BLOCK = 2_048
#: Cells over which a set's members are counted; one byte each.
CELLS = 256
#: Ids of documents to be confirmed that may go to every task.
FEW_IDS = 5_000


@dataclass(frozen=True)
class Near:
    """Shingle size, similarity as a ratio of integers, and the MinHash layout.

    160 minima in 32 bands of 5 miss a pair of similarity 0.8 with probability 3e-6, and one of 0.9 with 1e-12.
    ``bits`` low bits of each minimum are kept. ``slack`` below the wanted similarity, six standard errors of
    the estimate, still goes to the exact check.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 32
    rows: int = 5
    bits: int = 4
    slack: float = 0.2

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def sig_bytes(self) -> int:
        return -(-self.minima * self.bits // 8)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of the whole text if it has fewer; none without words.
    A-Z are lower-cased; words are what stands between the characters 0x20 and 0x09 to 0x0D."""
    w = WORD_HASHES.of(utf8(text).lower().split())
    if not len(w):
        return w
    size = min(words, len(w))
    h = w[:len(w) - size + 1]
    for k in range(1, size):
        h = join_hash(h, w[k:len(w) - size + 1 + k])
    if size < words:
        h = mix(h ^ _LONE ^ U64(size))
    return np.unique(h)


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64)) | U64(1)


def minima(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Smallest value of each multiply-shift hash, over blocks of the set."""
    best = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(shingles), 2048):
        block = (multipliers[:, None] * shingles[None, a:a + 2048]) >> U64(32)
        np.minimum(best, block.min(axis=1).astype(np.uint32), out=best)
    return best


def low_bits(values: np.ndarray, bits: int) -> bytes:
    """The low bits of each minimum, packed."""
    kept = (values[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(kept.astype(np.uint8).ravel()).tobytes()


def estimated(a: np.ndarray, b: np.ndarray, near: Near) -> np.ndarray:
    """Similarity of packed signatures (rows of bytes), corrected for chance agreement of ``bits`` bits."""
    differs = a ^ b
    if near.bits == 4:  # a minimum is half a byte
        agree = 2 * differs.shape[-1] - (np.count_nonzero(differs & 0xF0, axis=-1) + np.count_nonzero(differs & 0x0F, axis=-1))
    else:
        agree = near.minima - np.unpackbits(differs, axis=-1)[..., :near.minima * near.bits].reshape(*differs.shape[:-1], near.minima, near.bits).any(axis=-1).sum(axis=-1)
    chance = 0.5 ** near.bits
    return (agree / near.minima - chance) / (1 - chance)


def cells(shingles: np.ndarray) -> bytes:
    """How many members of the set fall into each cell of the hash range (255: as many or more), and the set's size."""
    counts = np.bincount((shingles >> U64(56)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.array([len(shingles)], "<u4").tobytes()


def may_link(a: np.ndarray, b: np.ndarray, near: Near) -> np.ndarray:
    """Whether two sets can reach the wanted similarity, from rows of ``cells``: what they share in a cell is at most
    the smaller count, so no pair that would be linked is turned away."""
    shared = np.minimum(a[..., :CELLS], b[..., :CELLS])
    most = shared.sum(axis=-1, dtype=np.int64)
    size = [np.ascontiguousarray(x[..., CELLS:]).view("<u4")[..., 0].astype(np.int64) for x in (a, b)]
    most = np.where((shared == 255).any(axis=-1), np.minimum(*size), most)
    return (near.den + near.num) * most >= near.num * (size[0] + size[1])


def likely(a: np.ndarray, b: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of pairs of signatures with cells behind them, and which pairs go to the exact check."""
    n = near.sig_bytes
    est = estimated(a[..., :n], b[..., :n], near)
    good = est >= near.num / near.den - near.slack
    at = np.flatnonzero(good)
    good[at] = may_link(np.broadcast_to(a, (len(good), a.shape[-1]))[at, n:], b[at, n:], near)
    return est, good


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """(doc_id, n_shingles, set_key binary, sig binary, keys array<long>) of every row; ``sig`` has the cells behind it."""
    def sign(batches):
        multipliers = _multipliers(near.minima)
        for batch in steps(batches):
            n, set_key, sig, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, near.words)
                n.append(len(s))
                if not len(s):
                    set_key.append(None), sig.append(None), keys.append(None)
                    continue
                m = minima(s, multipliers)
                bands = m.reshape(near.bands, near.rows).astype(U64)
                h = np.arange(near.bands, dtype=U64)
                for k in range(near.rows):
                    h = join_hash(h, bands[:, k])
                set_key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(low_bits(m, near.bits) + cells(s))
                keys.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, set_key binary, sig binary, keys array<long>")


def _likely(pairs: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose estimate reaches the wanted similarity less the slack and whose cells allow a link."""
    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(likely(a, b, near)[1]))

    return pairs.mapInArrow(keep, "a long, b long")


def _texts(pairs: DataFrame, docs: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of all documents in the pairs, each text of a doc_id once; those in ``have`` are not fetched again."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    missing = stage(needed if have is None else needed.join(have, "doc_id", "left_anti"), "near-missing")
    # A checked number of ids goes to every task; more are hashed. Either way the texts are not sorted.
    missing = F.broadcast(missing) if missing.count() <= FEW_IDS else missing.hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(missing, "doc_id", "left_semi")
    told_apart = ["doc_id", F.xxhash64("text"), F.crc32("text"), F.octet_length("text")]
    texts = stage(texts.groupBy(*told_apart).agg(F.min("text").alias("text")).select("doc_id", "text"), "near-texts")
    return texts if have is None else have.union(texts)


def _confirmed(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) linked on their full sets: den * intersection >= num * union, in integers."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b"))

    def check(batches):
        last, x = None, None
        for batch in steps(batches, "text_b"):
            good = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b")):
                data = text_a.as_buffer()
                if last is None or not data.equals(last):
                    last, x = data, shingle_set(text_a.as_py(), near.words)
                y = shingle_set(text_b.as_py(), near.words)
                if not len(x) or not len(y) or near.den * min(len(x), len(y)) < near.num * max(len(x), len(y)):
                    good.append(False)
                    continue
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                good.append(near.den * common >= near.num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # documents with several texts are linked by any of them
    return stage(both.mapInArrow(check, "a long, b long").distinct(), "near-links")


def _open_pairs(members: DataFrame, sig: DataFrame, near: Near, best: bool) -> DataFrame:
    """Likely pairs of different components in the same bucket; members: (key, cid, comp), sig: (cid, sig).

    A bucket is cut into blocks, and each pair of blocks is compared at once on signatures, so a large
    bucket is spread over many tasks and only likely pairs come out; with ``best`` only the likeliest
    of each member. Blocks of buckets with one component never form, and signatures are fetched for the rest alone.
    """
    open_keys = (members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
                 .filter("lo <> hi and n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    spread = (members.join(open_keys, "key").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .join(sig, "cid").select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cid", "comp", "sig"))
    ordered = spread.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def within(rows):
        side = np.array([r[3] for r in rows])
        cid, comp = (np.array([r[k] for r in rows], np.int64) for k in (4, 5))
        sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
        left = np.flatnonzero(side == rows[0][1])
        right = np.flatnonzero(side == rows[0][2])
        for i in left:
            others = right[comp[right] != comp[i]]
            if not len(others):
                continue
            est, good = likely(sig[i][None], sig[others], near)
            found = others[good]
            if best and len(found):
                found = found[[est[good].argmax()]]
            for j in found:
                yield min(cid[i], cid[j]), max(cid[i], cid[j])

    def compare(batches):
        held: list[tuple] = []
        out: set[tuple] = set()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if held and held[0][:3] != row[:3]:
                    out.update(within(held))
                    held = []
                held.append(row)
                if len(out) > 100_000:
                    yield _pairs(out)
                    out = set()
        if held:
            out.update(within(held))
        if out:
            yield _pairs(out)

    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _pairs(rows) -> pa.RecordBatch:
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when their distinct shingle sets have den * intersection >= num * union;
    component_id is the smallest doc_id reachable. Equal sets are one class from the start, so groups of
    exact copies cost one signature. Classes meet in band buckets: first each with the bucket's smallest
    (no bucket emits its pairs), then, in buckets that still hold several components, block by block on
    packed signatures: first the likeliest partner of each, then all that still lie in different components. What
    passes the estimate, and is not ruled out by how many members the sets have in each cell of the hash range, is
    checked on full sets, so no link is wrong and none is lost that a band found.

    Empty and null texts have no shingles and link with nothing. A null doc_id keeps its row, with a null
    component and kept true. Rows that repeat a doc_id are one document: each row is returned with the
    document's component, and any of its texts can link it. Other columns are ignored; an empty table gives no rows.
    """
    rows = stage(signatures(docs, near), "near-rows")
    classed = rows.filter("doc_id is not null and set_key is not null")
    classes = classed.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.max("doc_id").alias("top"), F.min_by(F.struct("sig", "keys"), "doc_id").alias("own"))
    classes = stage(classes.select("set_key", "cid", "own.sig", "own.keys"), "near-classes")
    banded = stage(classes.select("cid", F.posexplode("keys").alias("band", "hash")).select("cid", F.xxhash64("band", "hash").alias("key")), "near-bands")
    stars = banded.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo <> hi")
    # Buckets that hold more than one class, with their members; the rest has no pair.
    shared = stage(banded.join(stars, "key").select("key", "cid", "lo"), "near-shared")
    sig = classes.select("cid", "sig")  # a document with several texts has several
    first = shared.filter("cid <> lo").select(F.col("lo").alias("a"), F.col("cid").alias("b")).distinct()
    def with_sigs(pairs: DataFrame) -> DataFrame:
        return (pairs.join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
                .join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b"))
    # A document with several texts stands in several classes: they are one node.
    alike = classed.join(classes.select("set_key", "cid"), "set_key").filter("doc_id <> cid").select(F.col("cid").alias("a"), F.col("doc_id").alias("b")).distinct()
    starred = stage(_likely(with_sigs(first), near).distinct(), "near-likely")
    texts = _texts(starred, docs)
    found = components(_confirmed(starred, texts, near).union(alike))
    for best in (True, False):
        members = (shared.select("key", "cid").distinct().join(found, F.col("cid") == F.col("node"), "left")
                   .select("key", "cid", F.coalesce("component", "cid").alias("comp")))
        rest = stage(_open_pairs(members, sig, near, best), "near-open")
        if rest.isEmpty():
            break
        texts = _texts(rest, docs, texts)
        more = _confirmed(rest, texts, near)
        if not more.isEmpty():
            found = joined_components(found, more)
    return (rows.join(found, rows["doc_id"] == found["node"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
