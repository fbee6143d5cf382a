"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import components
from cohortlens.session import stage

#: Vectors of one shard, and the fewest shards, so that small tables are spread too.
SHARD_ROWS, LEAST_SHARDS = 16_384, 4
#: Queries of one block; blocks that share one copy of a graph.
QUERY_ROWS, BLOCKS_PER_COPY = 1_024, 8
LINKS, BUILD_BEAM, LAYER_SHARE = 12, 40, 16
START_BEAM, AUDIT_ROWS, WANTED_RECALL = 32, 256, 0.995
_SLACK = 1e-4  # single precision searches, double precision decides


@dataclass
class Layer:
    members: np.ndarray  # numbers of the vectors in it
    near: np.ndarray  # neighbours of each, as places in ``members``; -1 where there are fewer


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def beam_search(x: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, floor: float | None = None, each: int = 3):
    """Best-first search of all queries in step; entry: places to start from, one row per query.

    Returns places and similarities (queries x beam, descending, -1 where fewer), and, with ``floor``,
    every (query, place) met whose similarity reaches it.
    """
    n = len(queries)
    places, sims, done = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    hits: list[tuple] = []
    rows = np.arange(n)

    def admit(rows, found):
        found = np.sort(found, axis=1)
        fresh = (found >= 0) & ~np.c_[np.zeros(len(found), bool), found[:, 1:] == found[:, :-1]]
        safe = np.maximum(found, 0)
        fresh &= ~seen[rows[:, None], safe]
        r, c = np.nonzero(fresh)
        s = np.full(found.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("kd,kd->k", queries[rows[r]], x[found[r, c]])
        seen[rows[r], found[r, c]] = True
        if floor is not None:
            good = s[r, c] >= floor
            hits.append((rows[r[good]], found[r[good], c[good]]))
        p = np.concatenate([places[rows], np.where(fresh, found, -1)], 1)
        q = np.concatenate([sims[rows], s], 1)
        d = np.concatenate([done[rows], ~fresh], 1)
        order = np.argpartition(-q, beam - 1, axis=1)[:, :beam]
        places[rows], sims[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (p, q, d))

    admit(rows, entry)
    while len(rows):
        waiting = np.where(done[rows] | (places[rows] < 0), -np.inf, sims[rows])
        rows = rows[waiting.max(1) > -np.inf]
        if not len(rows):
            break
        waiting = np.where(done[rows] | (places[rows] < 0), -np.inf, sims[rows])
        pick = np.argpartition(-waiting, min(each, beam) - 1, axis=1)[:, :each]
        open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
        chosen = np.where(open_, np.take_along_axis(places[rows], pick, 1), -1)
        done[rows[:, None], pick] = True
        found = np.where(chosen[:, :, None] >= 0, near[np.maximum(chosen, 0)], -1).reshape(len(rows), -1)
        admit(rows, found)
    order = np.argsort(-sims, axis=1, kind="stable")
    got = (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])) if hits else None
    return np.take_along_axis(places, order, 1), np.take_along_axis(sims, order, 1), got


def _diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Neighbours of each row out of candidates sorted by similarity: first those closer to the row than to any
    neighbour taken, then the nearest of the rest. This keeps ways out of dense groups."""
    valid = (cand >= 0) & (cand != own[:, None])
    v = x[np.maximum(cand, 0)]
    gram = np.einsum("qad,qbd->qab", v, v)
    taken = np.zeros(cand.shape, bool)
    for c in range(cand.shape[1]):
        blocked = (taken & (gram[:, :, c] > sims[:, c, None])).any(1)
        taken[:, c] = valid[:, c] & ~blocked & (taken.sum(1) < keep)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cand, order, 1), -1)
    return out if out.shape[1] == keep else np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


@dataclass
class Graph:
    x: np.ndarray
    layers: list[Layer] = field(default_factory=list)  # the base layer last
    beam: int = START_BEAM

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> Graph:
        """Layers are nested samples of one in LAYER_SHARE; each is built in growing batches, searched from the layer above."""
        graph = cls(np.ascontiguousarray(x, np.float32))
        order = np.random.default_rng(seed).permutation(len(x))
        sizes = [len(x)]
        while sizes[-1] > 4 * LAYER_SHARE:
            sizes.append(-(-sizes[-1] // LAYER_SHARE))
        for size in reversed(sizes):
            graph._add_layer(np.sort(order[:size]))
        return graph

    def _add_layer(self, members: np.ndarray) -> None:
        v, n, wide = self.x[members], len(members), 2 * LINKS
        near = np.full((n, wide), -1, np.int64)
        # Members of the layer above come first, so that every search has a way in.
        above = np.isin(members, self.layers[-1].members) if self.layers else np.arange(n) < 64
        order = np.concatenate([np.flatnonzero(above), np.random.default_rng(n).permutation(np.flatnonzero(~above))])
        place = np.full(len(self.x), -1, np.int64)
        place[members] = np.arange(n)
        have = 0
        while have < n:
            batch = order[have:have + max(128, min(have, 512))]
            inner = v[batch] @ v[batch].T
            k = min(len(batch), wide)
            mine = _top(inner, k)
            cand, sims = batch[mine], np.take_along_axis(inner, mine, 1)
            if have:
                entry = place[self._enter(v[batch])] if self.layers else np.tile(order[:1], (len(batch), 1))
                entry = np.where(entry >= 0, entry, order[0])
                p, s, _ = beam_search(v, near, v[batch], entry, BUILD_BEAM)
                cand, sims = np.c_[cand, p], np.c_[sims, s]
                by = _top(sims, min(cand.shape[1], BUILD_BEAM))
                cand, sims = np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1)
            near[batch, :LINKS] = _diverse(v, batch, cand, sims, LINKS)
            self._link_back(v, near, batch)
            have += len(batch)
        self.layers.append(Layer(members, near.astype(np.int32)))

    @staticmethod
    def _link_back(v: np.ndarray, near: np.ndarray, batch: np.ndarray) -> None:
        """Neighbours of new members link back; lists that grow too long are thinned."""
        a = np.repeat(batch, near.shape[1])
        b = near[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        nodes, start, count = np.unique(b, return_index=True, return_counts=True)
        for i in range(0, len(nodes), 256):
            own, s, c = nodes[i:i + 256], start[i:i + 256], count[i:i + 256]
            extra = np.full((len(own), int(c.max())), -1, np.int64)
            r = np.repeat(np.arange(len(own)), c)
            col = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            extra[r, col] = a[np.repeat(s, c) + col]
            cand = np.sort(np.c_[near[own], extra], axis=1)
            cand = np.where(np.c_[np.zeros(len(own), bool), cand[:, 1:] == cand[:, :-1]], -1, cand)
            sims = np.where(cand >= 0, np.einsum("qd,qcd->qc", v[own], v[np.maximum(cand, 0)]), -np.inf)
            by = _top(sims, min(cand.shape[1], 3 * near.shape[1]))
            near[own] = _diverse(v, own, np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1), near.shape[1])

    def _enter(self, queries: np.ndarray, width: int = 4) -> np.ndarray:
        """Vectors, by number, from which the next layer's search starts."""
        top = self.layers[0].members
        numbers = top[_top(queries @ self.x[top].T, min(width, len(top)))]
        for layer in self.layers[1:]:
            place = np.full(len(self.x), -1, np.int64)
            place[layer.members] = np.arange(len(layer.members))
            p, _, _ = beam_search(self.x[layer.members], layer.near, queries, place[numbers], 16)
            numbers = np.where(p[:, :width] >= 0, layer.members[p[:, :width]], numbers[:, :1])
        return numbers

    def within(self, queries: np.ndarray, floor: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs met with similarity of at least ``floor``.

        A query whose beam ends full of such vectors is searched again with a beam four times as wide; a
        beam as wide as the shard is a plain comparison with all of it.
        """
        beam = beam or self.beam
        rows, out = np.arange(len(queries)), []
        base = self.layers[-1]
        while len(rows):
            if beam >= len(self.x):
                a, b = np.nonzero(queries[rows] @ self.x.T >= floor)
                out.append((rows[a], b))
                break
            upper = Graph(self.x, self.layers[:-1])
            entry = upper._enter(queries[rows]) if upper.layers else np.zeros((len(rows), 1), np.int64)
            _, s, (a, b) = beam_search(self.x, base.near, queries[rows], entry, beam, floor)
            full = s[:, -1] >= floor
            keep = ~full[a]
            out.append((rows[a[keep]], b[keep]))
            rows, beam = rows[full], beam * 4
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def audit(self, floor: float, rows: int = AUDIT_ROWS, wanted: float = WANTED_RECALL) -> None:
        """Widen the beam until a stated sample of queries finds its neighbours as plain comparison does.

        Queries are vectors of the shard and, as others come from other shards, one turned copy of each, with a
        cosine between floor and 1 to it: so there are true pairs to look at in every shard, however few links it has.
        """
        sample = np.unique(np.linspace(0, len(self.x) - 1, min(rows, len(self.x))).astype(int))
        noise = np.random.default_rng(len(self.x)).standard_normal(self.x[sample].shape)
        noise -= np.einsum("kd,kd->k", noise, self.x[sample])[:, None] * self.x[sample]
        length = np.linalg.norm(noise, axis=1, keepdims=True)
        cosine = np.where(length > 1e-6, np.linspace(floor, 1, len(sample) + 2)[1:-1, None], 1.0)
        turned = cosine * self.x[sample] + np.sqrt(1 - cosine ** 2) * noise / np.maximum(length, 1e-6)
        queries = np.concatenate([self.x[sample], turned]).astype(np.float32)
        own = np.r_[sample, np.full(len(sample), -1)]
        a, b = np.nonzero(queries @ self.x.T >= floor)
        real = set(zip(a.tolist(), b.tolist()))
        # A vector finds itself; only others count.
        others = [p for p in real if own[p[0]] != p[1]]
        while self.beam < len(self.x):
            found = set(zip(*(z.tolist() for z in self.within(queries, floor))))
            if sum(p in found for p in others) >= wanted * len(others) and sum(p in found for p in real) >= wanted * len(real):
                return
            self.beam *= 2

    def dump(self) -> dict:
        return {"vectors": self.x.tobytes(), "members": [x.members.astype(np.int32).tobytes() for x in self.layers],
                "near": [x.near.tobytes() for x in self.layers], "beam": self.beam}

    @classmethod
    def load(cls, n: int, vectors: bytes, members, near, beam: int) -> Graph:
        x = np.frombuffer(vectors, np.float32).reshape(n, -1)
        return cls(x, [Layer(np.frombuffer(m, np.int32).astype(np.int64), np.frombuffer(k, np.int32).reshape(-1, 2 * LINKS)) for m, k in zip(members, near)], beam)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what (a, b) connect: each node with the smallest of its group."""
    parent: dict[int, int] = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(k, root(k)) for k in parent]


def near_vectors(table: DataFrame, least: float = 0.95, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """One row per row of ``table`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one class with a multiplicity, so copies cost one search. Classes are dealt to
    shards by hash; each shard's graph is built, audited against plain comparison and written once. Each
    block of queries then meets every shard's graph (of two shards only one way, as links are mutual). Pairs
    met are decided by cosine in double precision, and each task returns counts and a spanning forest, never pairs.

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, and
    vectors of different lengths never link. A null vec_id keeps its row with a null component, no links and
    kept true. Rows that repeat a vec_id count as vectors of their own in n_links and share its component,
    and n_links is the largest of theirs. Other columns are ignored; an empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    good = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good & F.col("vec_id").isNotNull(), v).alias("v"))
    rows = stage(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    classes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("width", F.size("v")), "vector-classes")
    tops = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect()
    if not tops:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shards = max(least_shards, -(-max(t.n for t in tops) // shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("cid", "width"), F.lit(shards)).cast("int"))

    def make(key, pdf):
        x = _unit(np.stack(pdf["v"].to_numpy()))
        graph = Graph.build(x.astype(np.float32))
        graph.audit(least - _SLACK)
        return pd.DataFrame([{"width": key[0], "shard": key[1], "cids": pdf["cid"].to_numpy(np.int64).tobytes(), "copies": pdf["copies"].to_numpy(np.int64).tobytes(),
                              "exact": np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes(), **graph.dump()}])

    kinds = "width int, shard int, cids binary, copies binary, exact binary, vectors binary, members array<binary>, near array<binary>, beam int"
    graphs = stage(dealt.groupBy("width", "shard").applyInPandas(make, kinds), "vector-graphs")
    # Blocks of queries are cut from the shards, so a block knows which shards it still has to meet.
    blocked = dealt.join(dealt.groupBy("width", "shard").agg(F.count(F.lit(1)).alias("m")), ["width", "shard"]).withColumn(
        "block", F.pmod(F.xxhash64("cid", F.lit(7)), F.ceil(F.col("m") / QUERY_ROWS)).cast("int"))
    packed = blocked.groupBy("width", F.col("shard").alias("home"), "block").agg(F.collect_list(F.struct("cid", "copies", "v")).alias("rows"))
    queries = packed.withColumn("shard", F.explode(F.sequence(F.col("home"), F.lit(shards - 1)))).withColumn(
        "copy", ((F.col("block") + F.col("home") * 1_000_003) % F.greatest(F.lit(1), F.ceil(F.lit(max(t.n for t in tops)) / (QUERY_ROWS * BLOCKS_PER_COPY)))).cast("int"))
    keys = queries.select("width", "shard", "copy").distinct()
    served = graphs.join(keys, ["width", "shard"])
    both = queries.join(served, ["width", "shard", "copy"])

    def search(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cid, copies = np.frombuffer(r.cids, np.int64), np.frombuffer(r.copies, np.int64)
                graph = Graph.load(len(cid), r.vectors, r.members, r.near, r.beam)
                own = np.array([q["cid"] for q in r.rows], np.int64)
                mult = np.array([q["copies"] for q in r.rows], np.int64)
                x = np.array([q["v"] for q in r.rows], np.float64)
                unit = _unit(x)
                a, b = graph.within(unit.astype(np.float32), least - _SLACK)
                other = _unit(np.frombuffer(r.exact, np.float64).reshape(len(cid), -1))
                sure = np.concatenate([np.einsum("kd,kd->k", unit[a[i:i + 50_000]], other[b[i:i + 50_000]]) >= least for i in range(0, len(a), 50_000)]) if len(a) else np.zeros(0, bool)
                a, b = a[sure], b[sure]
                differs = own[a] != cid[b]
                a, b = a[differs], b[differs]
                node, links = [own[a]], [copies[b]]
                if r.home != r.shard:  # met one way only
                    node.append(cid[b]), links.append(mult[a])
                node, links = np.concatenate(node), np.concatenate(links)
                nodes, inverse = np.unique(node, return_inverse=True)
                told = dict(zip(nodes.tolist(), np.bincount(inverse, links, len(nodes)).astype(np.int64).tolist()))
                out += [(k, told.get(k, 0), p) for k, p in _forest(own[a], cid[b])]
            yield pd.DataFrame(out, columns=["cid", "links", "parent"]).astype(np.int64)

    met = stage(both.mapInPandas(search, "cid long, links long, parent long"), "vector-links")
    counted = met.groupBy("cid").agg(F.sum("links").alias("links"))
    # A vec_id with several vectors stands in several classes: they are one node.
    member = rows.filter("v is not null").join(classes.select("v", "cid", "copies"), "v").select("vec_id", "cid", "copies")
    alike = member.filter("vec_id <> cid").select(F.col("cid").alias("a"), F.col("vec_id").alias("b")).distinct()
    found = components(met.select(F.col("cid").alias("a"), F.col("parent").alias("b")).union(alike))
    told = member.join(counted, "cid", "left").groupBy("vec_id").agg(F.max(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    return (rows.select("vec_id").join(told, "vec_id", "left").join(found, F.col("vec_id") == F.col("node"), "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
