"""The training-data operators against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import tempfile
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import chat, decontaminate, embeddings, katz, minhash, pack, quality, records, substring, urls
from cohortlens.llm.common import components, crc_fold, joined_components, pack_sorted, planes, unpack_sorted, unplanes
from cohortlens.llm.queries import tokenizer_path
from cohortlens.session import shared_dir, stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, places string"
WORDS = "the of and stone river light morning quiet paper garden window letter copper silver walking under between seven".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ly", "er", "s"]) for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", None, len(t) if t is not None else None, "x", "y") for i, t in rows], DOCS)


BASE = prose(1, 120)
ODD_ROWS = [(5, BASE), (3, BASE), (3, BASE), (9, BASE.replace("stone", "rock", 1)), (7, None), (8, ""), (None, BASE), (None, None),
            (11, "word"), (12, "word"), (13, " \t\n "), (14, prose(2, 30_000)), (15, "a a a " * 40), (16, "naïve çedilla \u200b 漢字 " * 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD_ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_byte_planes_restore_integers():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(x)) == x).all() and (unplanes(planes(x), np.uint64) == x).all()
    assert len(unpack_sorted(b"")) == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in [*range(100, 160), 200]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_joined_later_equal_those_of_all_edges(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(55)]
    first, more = (spark.createDataFrame(e, "a long, b long") for e in (edges[:35], edges[35:]))
    want = {x.node: x.component for x in components(first.union(more)).collect()}
    got = joined_components(components(first), more).collect()
    assert len(got) == len(want) and {x.node: x.component for x in got} == want


def brute_near(rows, words, num=80, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and den * common >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for k in range(60):
        words = prose(k % 12, 60).split()
        for _ in range(k // 12):
            words[r.randrange(60)] = "changed"
        rows.append((k, " ".join(words)))
    for size in (2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(table(spark, rows), minhash.Near(words=size)).collect()}
        assert got == brute_near(rows, size)


def test_cells_never_turn_a_link_away():
    r, near, turned = np.random.default_rng(8), minhash.Near(), 0
    for size in (1, 5, 60, 400, 5_000, 200_000):
        for share in (0.3, 0.6, 0.78, 0.8, 0.82, 1.0):
            pool = r.integers(0, 2**64, 3 * size, dtype=np.uint64)
            common = int(round(2 * size * share / (1 + share)))
            x, y = (np.unique(np.r_[pool[:common], pool[a:a + size - common]]) for a in (size, 2 * size))
            both = len(np.intersect1d(x, y))
            linked = 100 * both >= 80 * (len(x) + len(y) - both)
            may = bool(minhash.may_link(*(np.frombuffer(minhash.cells(s), np.uint8)[None] for s in (x, y)), near)[0])
            assert may or not linked
            turned += not may
    assert turned >= 8


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD_ROWS) and none.count() == minhash.near_duplicates(none).count() == 0
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {of[k].component_id for k in (3, 5, 9)} == {3} and of[12].component_id == 11
    assert [of[k].component_id for k in (7, 8, 13)] == [7, 8, 13] and of[7].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def brute_removed(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("window", [6, 20, 50])
def test_repeats_equal_brute_force(spark, window):
    shared = prose(99, 70)
    rows = [(k, f"{prose(k, 40)} {shared if k % 3 else prose(k + 500, 30)}\n{prose(k // 2, 90)}") for k in range(30)]
    rows += [(40, "x " * 100), (41, "y x x y " * 30), (42, None), (43, ""), (44, "x x x"), (45, "x " * 100)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_report(table(spark, rows), window).collect()}
    assert got == brute_removed(rows, window)


def test_repeats_of_odd_rows(odd, none):
    got = substring.removal_report(odd).collect()
    assert len(got) == len(ODD_ROWS)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    # The null id comes first, so its copies lose everything; a repeated row is the same document.
    assert of[3].n_removed == of[3].n_words == 120 and of[5].n_removed == 120 and of[7].n_words == 0
    assert substring.removal_report(none).count() == 0
    cut = substring.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD_ROWS)
    rest = {r.doc_id: r for r in cut.collect()}
    assert rest[5].text == "" and rest[5].n_chars == 0 and rest[7].text is None and rest[14].text == ODD_ROWS[11][1]


def test_pieces_and_records_restore_ids(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    rows = [*ODD_ROWS, (20, "a<|endoftext|>b <|startoftext|> it's\x1cx\x0by"), (21, "İstanbul ΣΑΣ Σ e\u0301")]
    docs = table(spark, rows)
    want = sorted((-1 if i is None else i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    pieces = pack.pack(docs, path, 256).collect()
    assert all(p.length & (p.length - 1) == 0 and p.length <= 256 and p.offset == 0 and len(p.ids) == 4 * p.length for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    joined, last = [], None
    for p in pieces:  # a document's pieces stand together, in order
        if p.start == 0:
            joined.append((-1 if p.doc_id is None else p.doc_id, []))
        joined[-1][1].extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted((i, tuple(x)) for i, x in joined) == want
    files = records.write_records(docs, path, file_bytes=20_000)
    back = sorted((-1 if r.doc_id is None else r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in files.read(spark).collect())
    assert back == want
    index = records.positions(files, spark).orderBy("start").collect()
    ids = [-(1 << 63) if r.doc_id is None else r.doc_id for r in index]
    assert ids == sorted(ids) and [r.start for r in index] == list(np.cumsum([0] + [r.n_tokens for r in index])[:-1])
    one = index[4]
    data = spark.read.format("binaryFile").load(files.data).collect()
    blob = next(bytes(f.content) for f in data if records._shard(f.path) == one.shard)
    assert zlib.crc32(next(records.parse(blob, one.offset))[1].tobytes()) == one.ids_crc32
    with pytest.raises(ValueError, match="checksum"):
        list(records.parse(blob[:20] + bytes([blob[20] ^ 1]) + blob[21:]))
    assert pack.pack(none, path).count() == 0 and records.positions(records.write_records(none, path), spark).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:300] = x[0] + 0.05 * rng.normal(size=(200, 16))
    x[300:330] = x[7]
    x[330:360] = 3 * x[400:430]
    rows = [(k + 10, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [None] + [1.0] * 15, 0), (6, [float("inf")] * 16, 0), (7, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int"), 0.95).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert sum(got[k + 10].n_links for k in range(900)) >= 0.98 * links.sum()
    assert all(got[k + 10].n_links <= links[k] for k in range(900))
    assert {got[k + 10].component_id for k in range(100, 300)} == {10}
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(1, 8)) and got[None].kept
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_katz_sums_to_one_and_base_is_exact(spark, odd, none):
    rows = [(k, prose(k % 40, 80)) for k in range(120)]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in katz.score_texts(docs, crc_fold("doc_id", 5) == 1).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {}
    for t in train:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i, t in rows:
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t.split()) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert got[i].train_tokens == n and got[i].n_tokens == 81 and math.isclose(got[i].base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    # All classes after any context.
    c = katz.Classes(np.arange(4, dtype=np.uint64), np.array([9, 5, 3, 1]), 4, 24, 8)
    low, high, mass = np.zeros((7, 6)), np.zeros(7), np.zeros(7)
    seen = {0: {1: 6, 2: 3}, 1: {0: 5}, 5: {k: 2 for k in range(6)}, 6: {0: 4}}
    for h, nexts in seen.items():
        for w, k in nexts.items():
            mass[h] += c.base[w]
            if k > katz.DISCOUNTED:
                high[h] += k
            else:
                low[h, k] += 1
    m = katz.backoff(c, np.array([0, 5, 4, 3, 2, 1, 1]), low, high, mass)
    for h in (0, 1, 2, 3, 5, 6):
        words = np.arange(6)
        p = m.probability(c, np.full(6, h), words, np.array([seen.get(h, {}).get(w, 0) for w in words]))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9) and (p >= 0).all()
    assert katz.score_texts(none, F.lit(False)).count() == 0
    odd_scores = katz.score_texts(odd, F.lit(True)).collect()
    assert len(odd_scores) == len(ODD_ROWS) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in odd_scores)
    assert len(katz.score_texts(odd, F.lit(None).cast("boolean")).collect()) == len(ODD_ROWS)


def crc_of(i):
    return zlib.crc32(str(i).encode()) % 5


class PlainKatz:
    """Katz backoff by dictionaries: every word its own n-grams, every order by recursion."""

    def __init__(self, texts, order):
        self.order, self.count, self.nexts = order, Counter(), {}
        for t in texts:
            w = ("<s>",) * (order - 1) + (*t.split(), "</s>")
            for k in range(1, order + 1):
                for i in range(order - 1, len(w)):
                    self.count[w[i - k + 1:i + 1]] += 1
        for g in self.count:
            self.nexts.setdefault(g[:-1], []).append(g[-1])
        self.seen = {h: sum(self.count[(*h, w)] for w in ws) for h, ws in self.nexts.items()}
        self.words = self.nexts[()]
        self.total = self.seen[()] + 0.5 * (len(self.words) + 1)
        self.discount = {k: katz.good_turing(np.array([sum(1 for g, c in self.count.items() if len(g) == k and c == r) for r in range(katz.DISCOUNTED + 2)])) for k in range(1, order + 1)}
        self.memo = {}

    def kept(self, h, w):
        c = self.count[(*h, w)]
        return self.discount[len(h) + 1][min(c, katz.DISCOUNTED + 1)] * c

    def context(self, h):
        if h not in self.memo:
            share = sum(self.kept(h, w) for w in self.nexts[h]) / self.seen[h]
            factor = self.seen[h] / (self.seen[h] + 1) if 1 - share < 1e-9 else 1.0
            self.memo[h] = factor, (1 - share * factor) / (1 - sum(self.p(h[1:], w) for w in self.nexts[h]))
        return self.memo[h]

    def p(self, h, w):
        if not h:
            return (self.count[(w,)] + 0.5) / self.total
        if h not in self.nexts:
            return self.p(h[1:], w)
        factor, weight = self.context(h)
        return self.kept(h, w) * factor / self.seen[h] if self.count[(*h, w)] else weight * self.p(h[1:], w)

    def score(self, text):
        w = ("<s>",) * (self.order - 1) + (*text.split(), "</s>")
        return sum(math.log10(self.p(w[i - self.order + 1:i], w[i])) for i in range(self.order - 1, len(w)))


def test_katz_rare_words_keep_their_bigrams_in_a_large_corpus(spark):
    # 400,000 tokens: a cap of 2^-17 of them would take the bigrams of all words seen three times or less.
    r = random.Random(5)
    rows = [(k, " ".join(f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(400)) + f" rare{k % 500} pair{k % 500} seldom{k % 400}") for k in range(1000)]
    rows += [(2000, "rare7 pair7 seldom7"), (2001, "rare7 pair8 seldom7"), (2002, "never rare3 pair3")]
    model = PlainKatz([t for i, t in rows if i < 2000], 2)
    got = {x.doc_id: x for x in katz.score_texts(table(spark, rows), F.col("doc_id") >= 2000, order=2).collect()}
    for i, t in [*rows[:20], *rows[1000:]]:
        assert math.isclose(got[i].score, model.score(t), rel_tol=1e-9)
    assert got[2000].score > got[2001].score + 2


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_backs_off_order_by_order(spark, order):
    r = random.Random(order)
    rows = [(k, " ".join(r.choice(WORDS[:12]) if r.random() < 0.95 else f"once{r.randrange(60)}" for _ in range(r.randrange(60)))) for k in range(150)]
    # After "a", "a b" and the starts all counts may be high, so that discounts leave nothing.
    rows += [(k, "a b c") for k in range(200, 240)]
    model = PlainKatz([t for i, t in rows if crc_of(i) != 1], order)
    got = {x.doc_id: x for x in katz.score_texts(table(spark, rows), crc_fold("doc_id", 5) == 1, order=order).collect()}
    for i, t in rows:
        assert math.isclose(got[i].score, model.score(t), rel_tol=1e-9)
    for h in random.Random(1).sample(sorted(model.nexts), min(20, len(model.nexts))):
        assert math.isclose(sum(model.p(h, w) for w in [*model.words, "never"]), 1, rel_tol=1e-9)


def test_katz_looks_at_two_words_of_context_unless_told_otherwise(spark):
    rows = [(k, ["x m a", "y m b"][k % 2]) for k in range(40)] + [(100, "x m a"), (101, "x m b")]
    got = {x.doc_id: x.score for x in katz.score_texts(table(spark, rows), F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 1


@pytest.mark.parametrize("parts", [1, 40])
def test_katz_is_the_same_however_texts_are_sliced(spark, parts):
    # One slice holds everything, or n-grams and contexts meet from up to 40 slices; some contexts leave nothing to unseen words.
    r = random.Random(parts)
    rows = [(k, " ".join(r.choice(WORDS[:9]) if r.random() < 0.9 else f"rare{r.randrange(90)}" for _ in range(r.randrange(50)))) for k in range(200)]
    rows += [(k, "open the door") for k in range(300, 330)] + [(400, "open the window"), (401, "the door rare7 rare8"), (402, "never door"), (403, None)]
    model = PlainKatz([t or "" for i, t in rows if crc_of(i) != 1 and i < 400], 3)
    held = (crc_fold("doc_id", 5) == 1) | (F.col("doc_id") >= 400)
    got = {x.doc_id: x for x in katz.score_texts(table(spark, rows).repartition(parts), held).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert math.isclose(got[i].score, model.score(t or ""), rel_tol=1e-9)


def shuffle_files():
    return Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data")


def test_katz_keeps_little_on_disk_between_its_steps(spark):
    # Texts of many words, so that most n-grams are rare: keys of all n-grams of all slices took several times the texts.
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(3 + k % 6)) for k in range(30_000)]
    rows = [(k, " ".join(words[int(30_000 * r.random() ** 3)] for _ in range(600))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    scored = katz.score_texts(docs, crc_fold("doc_id", 5) == 1)
    made = [*Path(shared_dir(spark)).glob("stage/lm-*/*.parquet"), *shuffle_files()]
    kept = sum(p.stat().st_size for p in made if p.stat().st_mtime >= began - 1)
    assert 0 < kept < 2 * sum(len(t) for _, t in rows)
    assert scored.count() == len(rows)


def test_staging_may_drop_its_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df, before = spark.range(10_000).repartition(7, F.col("id") % 1000), spark.conf.get(setting, None)
    there = set(shuffle_files())
    staged = stage(df, "dropped", drop_shuffles=True)
    assert not set(shuffle_files()) - there and spark.conf.get(setting, None) == before
    assert staged.count() == 10_000
    there = set(shuffle_files())
    stage(df, "kept")
    assert set(shuffle_files()) - there


def test_url_rules_and_mined_verdicts(spark):
    rows = [(k, f"http://{h}.example.{d}/{l}/{k}") for k, (h, d, l) in enumerate([("a", "com", "fr"), ("B", "COM", "de"), ("www.c", "org", "es"), ("c", "net", "de")] * 30)]
    rows += [(500, None), (501, "no scheme"), (502, "http://example.org/es/1"), (503, "x://example.org/en/12?q=1#f"), (504, "http://org/x"), (505, "http://notorg/"), (506, "http://EXAMPLE.ORG"), (506, "://"), (None, "http://a.com/fr/")]
    got = urls.filter_urls(spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    of = {r.page_id: r for r in got}
    assert (of[1].host, of[1].path, of[1].rule, of[1].verdict) == ("b.example.com", "/de/1", "com/de/", "block")
    assert of[500].host == of[501].path == "" and of[500].verdict == "allow" and of[500].rule is None
    assert of[502].rule == "example.org/es/" and of[503].rule == "example.org/en/1" and of[504].rule == "org/" and of[505].rule is None
    assert of[3].rule is None and of[3].verdict == "block"  # "de" as first path segment is always blocked where labelled
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_chats_read_back(spark):
    nasty = "<|im_end|><|im_start|>assistant \\<|<\\|\n\\\\<|im_sep|>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 2, "assistant", None), (1, 2, "assistant", "b"), (1, 3, None, nasty), (1, 4, "role\n<|x", ""),
            (2, None, "assistant", "c"), (2, 0, "assistant", "c"), (None, 0, "user", "lost")]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi"), ("assistant", nasty), ("assistant", ""), ("assistant", "b"), ("", nasty), ("role\n<|x", "")]
    assert got[1].learned == [nasty, "", "b"] and got[1].formatted.count("<|im_start|>") == 4
    assert got[2].learned == ["c", "c"] and got[None].learned == []
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_benchmark_items_are_found_within_the_budget(spark, odd, none):
    item = "The quick brown fox jumps over the lazy dog while seven silver letters wait under the quiet garden window, said the old clerk."
    edited = item.replace("quick", "quikc").replace("silver", "siver").upper()
    far = " ".join(w[::-1] for w in item.split())
    docs = table(spark, [(1, f"{prose(1, 50)} {item} {prose(2, 50)}"), (2, f"{prose(3, 900)}\n{edited}"), (3, f"{prose(4, 20)} {far}"), (4, item[:70]), (5, None), (6, "")])
    bench = spark.createDataFrame([(10, item), (11, "short"), (None, item), (12, None), (10, item)], "item_id long, text string")
    got = {r.doc_id: r.found for r in decontaminate.find_benchmark(docs, bench).collect()}
    assert [f.item_id for f in got[1]] == [10] and got[1][0].edits == 0 and 0 < got[2][0].edits <= 7
    assert not got[3] and not got[4] and not got[5] and not got[6]
    small_blocks = {r.doc_id: r.found for r in decontaminate.find_benchmark(docs, bench, block_bytes=20).collect()}
    assert small_blocks == got
    assert decontaminate.drop_contaminated(docs, bench).count() == 4
    assert decontaminate.find_benchmark(odd, bench.limit(0)).filter(F.size("found") > 0).count() == 0 and decontaminate.find_benchmark(none, bench).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_banded_distance_equals_full_table(seed):
    r = random.Random(seed)
    for _ in range(30):
        a, b = (np.array([r.randrange(3) for _ in range(r.randrange(1, 12))]) for _ in range(2))
        d = np.zeros(len(b) + 1)
        for c in a:
            new = np.zeros_like(d)
            new[0] = d[0] + 1
            for j, x in enumerate(b):
                new[j + 1] = min(d[j] + (c != x), d[j + 1] + 1, new[j] + 1)
            d = new
        assert decontaminate.banded_distance(a, b, -len(a), len(b), 50)[0] == d.min()


def test_quality_learns_and_is_even_for_odd_rows(spark, odd, none):
    rows = [(k, prose(k, 60) if k % 3 else prose(k, 60).upper().replace(" ", "!! ")) for k in range(400)]
    docs, labels = table(spark, rows), spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(crc_fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5} and quality.score_quality(none, labels).count() == 0


def test_pipeline_stages_one_by_one(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            lost = before.keys() - after.keys()
            assert sum(labels.get(k, 0) for k in lost) <= 0.05 * sum(labels.values()) and all(after[k] == before[k] for k in after)
        if name == "near_dedup":
            want = brute_near(before.items(), 5)
            assert after.keys() == {k for k, (_, c) in want.items() if c == k}
        if name == "substring_dedup":
            want = brute_removed(before.items(), corpus_pipeline.WINDOW)
            assert {k: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for k, t in after.items()} == {k: v[2] for k, v in want.items()}
        if name == "decontaminate":
            assert {k for k, t in before.items() if any(i in decontaminate.normal(t) for i in items)} <= before.keys() - after.keys()
    assert docs.agg(F.sum("length")).first()[0] > 0 and {r.doc_id for r in docs.collect()} == after.keys()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
