import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseforge.llm import bucket_pairs, chunk_dedup, decontaminate, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, words
from caseforge.llm.words import block_of, collapsed, pack, pack_sorted, requests, shingle_hashes, unpack, unpack_sorted

from .conftest import prose

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "")) if w]


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_packing_round_trip():
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(a)) == a).all()
    for d in (np.uint32, np.int64, np.float32):
        assert (unpack(pack(a.astype(d))) == a.astype(d)).all()
    assert len(unpack(pack(np.zeros(0, np.uint64)))) == 0
    w = np.arange(7, dtype=np.uint64)
    assert len(shingle_hashes(w)) == 3 and len(shingle_hashes(w[:2])) == 1 and len(shingle_hashes(w[:0])) == 0


class BruteAutomaton:
    """The same model from dictionaries over words: states are tuples of words, one text is read word by word."""

    def __init__(self, training, least_pair=2):
        cls = lambda x: math.frexp(x)[1]
        self.grams, self.context, self.back = [None, Counter(), Counter(), Counter()], Counter(), {}
        for t in training:
            t = ["\n\n", *t]
            self.context["\n\n",] += 1
            for i in range(1, len(t)):
                for k in (1, 2, 3):
                    if i - k + 1 >= 0:
                        self.grams[k][tuple(t[i - k + 1 : i + 1])] += 1
        c = self.grams[1]
        self.context.update({g: n for g, n in c.items() if g != ("\n",)})
        self.context.update({g: n for g, n in self.grams[2].items() if g[1] != "\n" and n >= least_pair})
        self.n, self.v = sum(c.values()), len(c)
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        self.d = min(0.9, n1 / (n1 + 2 * n2)) if n1 else 0.5
        for k in (2, 3):
            once, all_ = Counter(), Counter()
            for g, n in self.grams[k].items():
                if g[:-1] in self.context:
                    once[cls(self.context[g[:-1]])] += n == 1
                    all_[cls(self.context[g[:-1]])] += n
            for g in [g for g in self.context if len(g) == k - 1]:
                x = cls(self.context[g])
                self.back[g] = min(0.95, max(0.001, once[x] / max(1, all_[x])))

    def p(self, state, w):
        if not state:
            return (self.grams[1][w,] - self.d) / self.n if self.grams[1][w,] else self.d * self.v / self.n
        b = self.back[state]
        return (1 - b) * self.grams[len(state) + 1][*state, w] / self.context[state] + b * self.p(state[1:], w)

    def score(self, words):
        read, total = ["\n\n"], 0.0
        for w in words:
            # The state is the longest one that ends here.
            state = next((s for s in (tuple(read[-2:]), tuple(read[-1:])) if s in self.context), ())
            while state and not self.grams[len(state) + 1][*state, w]:
                total, state = total + math.log10(self.back[state]), state[1:]  # a failure arc
            total += math.log10(self.p(state, w))
            read.append(w)
        return total


def brute_lm(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _, _ in rows]
    toks = [[w.translate(LOWER) for w in words_of(t)] + ["\n"] for _, t, _ in rows]
    m = BruteAutomaton([t for h, t in zip(held, toks) if not h])
    c, n, v = m.grams[1], m.n, m.v
    base = [sum(math.log10((c[w,] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in toks]
    return sorted([(i, h, len(t), sum(c[w,] > 0 for w in t), n, round(b, 6), round(m.score(t), 6)) for (i, _, _), h, t, b in zip(rows, held, toks, base)], key=str)


@pytest.mark.parametrize("block_bytes", [6 << 20, 4000])
def test_lm_scores_equal_brute_force(docs, rows, block_bytes):
    got = lm_scoring.score(docs, block_bytes=block_bytes, bucket_bytes=3 * block_bytes)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()]
    want = brute_lm(rows)
    assert [x[:5] for x in sorted(got, key=str)] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in sorted(got, key=str)], [x[5:] for x in want], atol=2e-6)


def test_lm_pairs_of_words_are_worth_their_states(spark):
    r = np.random.default_rng(3)
    sentences = [" ".join(f"w{x}" for x in r.integers(0, 40, 12)) for _ in range(60)]
    text = [(i, " ".join(sentences[k] for k in r.integers(0, 60, 6))) for i in range(300)]
    df = spark.createDataFrame(text, "doc_id long, text string")
    of = [{x.doc_id: x.score for x in lm_scoring.score(df, **o).collect() if x.held_out} for o in ({}, {"least_pair": 1 << 40})]
    assert of[0] and sum(of[0].values()) > 0.5 * sum(of[1].values())  # less than half the bigrams' log loss


def test_lm_rows_without_id_are_spread_over_blocks(spark):
    text = [(None, prose(f"n{i}", 40)) for i in range(200)] + [(None, "all the same")] * 500
    df = spark.createDataFrame(text, "doc_id long, text string").repartition(3)
    blocks = 10
    placed = collapsed(df, "text").withColumn("block", block_of(blocks, "doc_id", "text")).groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    assert len(placed) == blocks and max(r["rows"] for r in placed) < 60 and sum(r["n"] for r in placed) == 700
    got = lm_scoring.score(df, block_bytes=4000, bucket_bytes=4000).collect()
    assert len(got) == 700 and len({r.score for r in got if r.n_tokens == 4}) == 1


def test_messages_grow_with_the_keys_not_with_blocks_times_buckets():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    for buckets in (1, 7, 1000, 1_000_000):
        t = requests(3, keys, np.ones(500, np.int64), buckets)
        assert t.num_rows <= min(buckets, 500)
        assert (np.concatenate([unpack_sorted(k.as_py()) for k in t["keys"]]) == keys).all()
        assert t["bucket"].to_pylist() == sorted(set(t["bucket"].to_pylist())) and max(t["bucket"].to_pylist()) < buckets
    assert requests(3, keys[:0], np.ones(0, np.int64), 9).num_rows == 0


@pytest.mark.parametrize("slice_bytes", [1, 17, 1 << 18])
def test_word_hashes_tell_words_apart(monkeypatch, slice_bytes):
    monkeypatch.setattr(words, "SLICE_BYTES", slice_bytes)
    r, hash_of = random.Random(slice_bytes), {}
    parts = [b"a", b"B", b"b", b" ", b"\n", b"\t", "é".encode(), b"\x0b", b"Z", b"\x08", b"x" * 70]
    for _ in range(60):
        texts = [None if r.random() < 0.1 else b"".join(r.choices(parts, k=r.choice([0, 1, 5, 50]))) for _ in range(r.randrange(9))]
        hashes, sizes = words.word_hashes(pa.array(texts, pa.binary()))
        want = [(t or b"").lower().split() for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        for w, h in zip([w for ws in want for w in ws], hashes.tolist()):
            assert hash_of.setdefault(w, h) == h
    assert len(set(hash_of.values())) == len(hash_of)


def test_lm_is_a_distribution_and_beats_the_base(spark):
    text = [(i, " ".join(["the cat sat on the mat", "a dog ran to the park"][(i + k) % 2] for k in range(5))) for i in range(100)]
    r = lm_scoring.score(spark.createDataFrame(text, "doc_id long, text string")).collect()
    held = [x for x in r if x.held_out]
    assert held and sum(x.score for x in held) > sum(x.base_score for x in held)
    assert all(x.score < 0 for x in r)


def test_lm_empty_and_untrained(spark, empty):
    assert lm_scoring.score(empty).count() == 0
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm_scoring.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0) and abs(r.base_score) < 1e-9


def brute_lines(rows, least):
    keys = [[x.strip(BLANK).translate(LOWER) for x in (t or "").split("\n")] for _, t, _ in rows]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t, _), ks in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if n[k] < least or not k]
        out.append((i, len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(docs, rows, empty):
    assert collected(line_dedup.counted(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows, 10)
    assert collected(line_dedup.counted(docs, min_docs=2), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows, 2)
    out = line_dedup.dropped(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not out.filter("text like 'Common%'").count() and out.filter("text is null").count() == 1
    assert line_dedup.counted(empty).count() == 0 and line_dedup.dropped(empty).count() == 0


def brute_classes(rows):
    bags = []
    for _, t, _ in rows:
        w = [x.translate(LOWER) for x in words_of(t)]
        bags.append((tuple(w), Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()))
    df, n = Counter(k for _, b in bags for k in b), len(rows)
    weight = lambda k, c: c * (1 + math.log((1 + n) / (1 + df[k])) / math.log(1 + n))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        (wa, x), (wb, y) = bags[a], bags[b]
        sims = []
        for f in (weight, lambda k, c: c):
            both = sum(f(k, min(x[k], y[k])) for k in x if k in y)
            whole = sum(f(k, c) for k, c in x.items()) + sum(f(k, c) for k, c in y.items()) - both
            sims.append(both / whole if whole else 0)
        if wa == wb or max(sims) >= 0.8:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        groups[find(k)].append((i is None, i))
    return sorted(((i, min(groups[find(k)])[1]) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block_bytes", [6 << 20, 5000])
def test_near_duplicate_classes_equal_brute_force(docs, rows, block_bytes):
    got = near_dedup.classes(docs, block_bytes=block_bytes, bucket_bytes=3 * block_bytes)
    assert collected(got, "doc_id", "class_id") == brute_classes(rows)
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert len(kept) == len(set(kept)) and kept == sorted({c for _, c in brute_classes(rows) if c is not None})


@pytest.mark.parametrize("linking", [{}, {"hub_members": 8, "small": 3}])
def test_near_duplicates_of_a_large_group(spark, linking):
    base = prose("large", 150)
    rows = [(0, base, "s")]
    for i in range(1, 150):
        w = base.split()
        for k in range(i % 6):
            w[(7 + i * 13 + k * 29) % 150] = f"new{i}_{k}"
        rows.append((i, " ".join(w), "s"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert collected(near_dedup.classes(d, **linking), "doc_id", "class_id") == brute_classes(rows)


def test_near_duplicates_whose_hub_is_far_from_most(spark):
    """Pairs in one bucket, none of which the hub is linked with; and two that only a very frequent passage links under plain counts."""
    base = prose("star", 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(8):
            w[(11 * (i // 2) + 25 * k) % 200] = f"s{i // 2}_{k}"
        w[(3 * i) % 200] = f"own{i}"
        rows.append((i, " ".join(w), "s"))
    passage = prose("passage everywhere", 90)
    rows += [(100 + i, passage + " " + prose(f"tail {i}", 8), "s") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for linking in ({}, {"hub_members": 4, "small": 2}):
        assert collected(near_dedup.classes(d, **linking), "doc_id", "class_id") == brute_classes(rows)


def test_near_duplicate_recall_against_all_pairs(spark):
    """Of all pairs of documents of sf0.01 that reach 0.8 under either weights, the share that ends in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: words_of((r.text or "").translate(LOWER)) for r in docs.select("doc_id", "text").collect()}
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in texts.items() if w}
    df = Counter(k for b in bags.values() for k in b)
    n = len(texts)
    idf = {k: 1 + math.log((1 + n) / (1 + c)) / math.log(1 + n) for k, c in df.items()}
    holders, shared = defaultdict(list), Counter()
    for i, b in bags.items():
        for k in b:
            holders[k].append(i)
    for h in holders.values():
        shared.update(combinations(sorted(h), 2))
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    reached = {"tf-idf": [], "counts": []}
    for (a, b), _ in shared.items():
        x, y = bags[a], bags[b]
        for name, f in (("tf-idf", idf.get), ("counts", lambda k: 1)):
            both = sum(f(k) * min(x[k], y[k]) for k in x if k in y)
            whole = sum(f(k) * c for k, c in x.items()) + sum(f(k) * c for k, c in y.items()) - both
            if both / whole >= 0.8:
                reached[name].append(found[a] == found[b])
    for name, hits in reached.items():
        print(f"recall under {name}: {sum(hits)} of {len(hits)} pairs")
        assert len(hits) > 50 and sum(hits) >= 0.99 * len(hits)


@pytest.mark.parametrize("linking", [{}, {"small": 3}])
def test_pairs_of_a_large_bucket_that_share_no_more_samples(spark, linking):
    """Five pairs in one bucket; the hub is far from four of them, and a pair shares the bucket's four samples only."""
    rows = []
    for node in range(1, 11):
        pair = (node + 1) // 2
        keys = np.array(sorted([*range(100 * pair, 100 * pair + 9), 100 * pair + 50 + node]), np.uint64)
        drawn = [1, 2, 3, 4, *(1000 * node + k for k in range(92))]
        rows.append((node, 10.0, 10.0, 10.0, 10.0, drawn, bytearray(pack_sorted(keys)), bytearray(pack(np.ones(10, np.uint32))), bytearray(pack(np.ones(10, np.float32)))))
    found = near_dedup.linked(spark.createDataFrame(rows, near_dedup.VECTORS), **linking)
    assert {x.node: x.root for x in found.collect()} == {n: n - 1 + n % 2 for n in range(1, 11)}


@pytest.mark.parametrize("sizes", [(40, 30), (1, 7)])
def test_common_shingles_of_two_chunks(monkeypatch, sizes):
    monkeypatch.setattr(bucket_pairs, "HOLDERS", 100)
    rng, weights = np.random.default_rng(1), np.random.default_rng(5).random(2000).astype(np.float32) + 1

    def bags(n):
        keys = [np.unique(np.concatenate([rng.integers(0, 50, 30), rng.integers(50, 2000, 40)])) for _ in range(n)]
        return [(k, np.where(rng.random(len(k)) < 0.2, rng.integers(2, 6, len(k)), 1).astype(np.uint32)) for k in keys]

    def chunk(rows):
        t = {"root": range(len(rows)), "weight": [1.0] * len(rows), "terms": [1.0] * len(rows)}
        t |= {"keys": [words.pack_sorted(k.astype(np.uint64)) for k, _ in rows], "tf": [words.pack(f) for _, f in rows], "idf": [words.pack(weights[k]) for k, _ in rows]}
        return bucket_pairs._Chunk(bucket_pairs._packed(pa.table(t)))

    a, b = map(bags, sizes)
    terms, weight = bucket_pairs.common(chunk(a), chunk(b))
    for i, (k, f) in enumerate(a):
        for j, (k2, f2) in enumerate(b):
            both, x, y = np.intersect1d(k, k2, return_indices=True)
            least = np.minimum(f[x], f2[y]).astype(float)
            assert terms[i, j] == least.sum() and abs(weight[i, j] - (least * weights[both]).sum()) < 1e-9


def test_near_duplicates_empty(empty):
    assert near_dedup.classes(empty).count() == 0 and near_dedup.deduplicated(empty).count() == 0


def test_consistent_sampling_estimates_weighted_jaccard():
    t, rng = near_dedup._Tables(), np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    w = rng.random(400) * 3 + 1
    a, b = np.arange(320), np.arange(40, 360)
    want = w[40:320].sum() / (w[:320].sum() + w[320:360].sum())
    hits = []
    for k in range(30):
        shift = np.uint64(k * 7919 + 1)
        x, y = (near_dedup.samples(t, keys[i] * shift, w[i], 0.0, 1) for i in (a, b))
        hits.append((x == y).mean())
    assert abs(np.mean(hits) - want) < 0.05


def test_passages(docs, rows, empty):
    r = chunk_dedup.passages(docs, block_bytes=5000, bucket_bytes=20000).collect()
    by = defaultdict(list)
    for x in r:
        by[x.doc_id].append(x)
    texts = {i: t for i, t, _ in rows}
    # Each later copy stands in its first document in one piece.
    for x in r:
        if x.removed and x.first_doc_id is not None:
            piece = texts[x.doc_id][x.start : x.start + x.n_chars].strip()
            assert any(piece in (t or "") for i, t, _ in rows if i == x.first_doc_id)
    assert by[30] and by[31] and not by[30][0].removed and by[31][0].removed and by[31][0].first_doc_id == 30
    clean = {*range(12), 40, 41, 42, 43, 44, 52}
    assert not clean & set(by)
    for i, xs in by.items():
        for x in xs:
            assert len(words_of(texts[i][x.start : x.start + x.n_chars])) == x.n_words >= 20
    cut = {x.doc_id: x.text for x in chunk_dedup.cut(docs).collect()}
    assert len(cut[31]) < len(texts[31]) and cut[30] == texts[30] and cut[21] == "" and cut[40] is None
    assert chunk_dedup.passages(empty).count() == 0 and chunk_dedup.cut(empty).columns == empty.columns


def test_adjacent_passages_stay_once(spark):
    p, q, r = (prose(f"adjacent {k}", n) for k, n in (("p", 60), ("q", 60), ("r", 60)))
    around = lambda k, *parts: " ".join(x for j, part in enumerate(parts) for x in (prose(f"around {k} {j}", 30), part)) + " " + prose(f"end {k}", 30)
    phrase = " ".join(q.split()[20:30])
    rows = [(0, around(0, q)), (1, around(1, q + " " + p)), (2, around(2, p)), (3, around(3, p + " " + q + " " + r)), (4, around(4, r)), (5, around(5, phrase + " " + r + " " + p))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id: x.text for x in chunk_dedup.cut(d).collect()}
    for k, passage in enumerate((q, p, r)):
        middle = " ".join(passage.split()[15:45])
        assert [i for i, t in sorted(kept.items()) if middle in t] == [(0, 1, 3)[k]]
    of = defaultdict(set)
    for x in chunk_dedup.passages(d).collect():
        of[x.doc_id].add((x.first_doc_id, x.removed))
    assert of == {0: {(0, False)}, 1: {(0, True), (1, False)}, 2: {(1, True)}, 3: {(0, True), (1, True), (3, False)}, 4: {(3, True)}, 5: {(3, True), (1, True)}}
    # Whatever is beside what, each chunk of the corpus stays somewhere.
    rng = np.random.default_rng(5)
    parts = [prose(f"part {k}", int(rng.integers(3, 60))) for k in range(12)]
    rows = [(i, " ".join(parts[k] for k in rng.permutation(12)[:4])) for i in range(40)]
    left = Counter(w for x in chunk_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect() for w in x.text.split())
    assert {w for _, t in rows for w in t.split()} == set(left)


def brute_repeats(rows, least):
    """Words of each row that stand in a run of ``least`` words or more that a row before holds."""
    windows, out = {}, {}
    for i, t in rows:
        w, mine = t.split(), set()
        for k in range(len(w) - least + 1):
            if windows.setdefault(tuple(w[k : k + least]), i) != i:
                mine.update(range(k, k + least))
        out[i] = mine
    return out


def test_passages_lie_in_what_brute_force_finds_and_cover_most_of_it(spark):
    rng = np.random.default_rng(8)
    shared = [prose(f"shared {k}", int(rng.integers(50, 120))) for k in range(15)]
    phrases = [prose(f"phrase {k}", 6) for k in range(5)]
    rows = []
    for i in range(80):
        parts = [prose(f"own {i} {j}", int(rng.integers(10, 60))) for j in range(4)] + [shared[k] for k in rng.choice(15, 2, replace=False)] + [phrases[k] for k in rng.integers(0, 5, 6)]
        rows.append((i, " ".join(parts[k] for k in rng.permutation(len(parts)))))
    want, texts = brute_repeats(rows, 10), dict(rows)
    found, planted = defaultdict(set), 0
    for x in chunk_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if x.removed:
            assert x.n_words >= 20 and texts[x.doc_id][x.start : x.start + x.n_chars].strip() in texts[x.first_doc_id]
            a = len(texts[x.doc_id][: x.start].split())
            found[x.doc_id].update(range(a, a + x.n_words))
    assert all(found[i] <= want[i] for i in found)
    missed = sum(len(want[i] - found[i]) for i in want)
    assert missed < 0.25 * sum(map(len, want.values()))  # the chunks at both ends also hold words around


def test_passages_of_rows_without_id_and_with_one_id(spark):
    p = prose("nobody's passage", 60)
    for i in (None, 7):
        rows = [(i, prose(f"nb {k}", 40) + " " + p + " " + prose(f"na {k}", 40)) for k in range(4)] + [(i, prose("clean", 120))]
        d = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(x.removed for x in chunk_dedup.passages(d).collect()) == [False, True, True, True]
        kept = sorted(x.text for x in chunk_dedup.cut(d).collect())
        assert sum(" ".join(p.split()[15:45]) in t for t in kept) == 1 and prose("clean", 120) in kept
        assert all(sum(prose(f"n{s} {k}", 40).split()[10 if s == "b" else 25] in t.split() for t in kept) for k in range(4) for s in "ba")


def test_chunks_survive_insertions():
    text = prose("chunks", 2000).encode()
    parts = lambda t: {t[a:b] for a, b in zip([0, *chunk_dedup.cuts(t)], chunk_dedup.cuts(t))}
    assert b"".join(text[a:b] for a, b in zip([0, *chunk_dedup.cuts(text)], chunk_dedup.cuts(text))) == text
    moved = b"something new here " + text[:5000] + b" inserted words " + text[5000:]
    assert len(parts(text) & parts(moved)) > 0.95 * len(parts(text))
    long = ("é" * 5000).encode()
    assert all(long[a:b].decode() for a, b in zip([0, *chunk_dedup.cuts(long)], chunk_dedup.cuts(long)))


def test_contaminated(docs, rows, items, empty):
    item = {tuple(w) for w in zip(*(words_of(prose("item", 30))[k:] for k in range(5)))}
    want = []
    for i, t, _ in rows:
        w = [x.translate(LOWER) for x in words_of(t)]
        got = item & set(zip(*(w[k:] for k in range(5))))
        if len(got) >= 0.8 * len(item):
            want.append((i, 0, len(got)))
    assert want and collected(decontaminate.contaminated(docs, items), "doc_id", "item_id", "shared") == want
    assert collected(decontaminate.contaminated(docs, items, pass_bytes=50), "doc_id", "item_id", "shared") == want
    out = decontaminate.decontaminated(docs, items)
    assert out.columns == docs.columns and out.count() == docs.count() - len(want)
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_rows_without_id_are_judged_by_their_own_text(spark, items):
    held, base = prose("x", 50) + " " + prose("item", 30) + " " + prose("y", 50), prose("null base", 150)
    rows = [(None, held), (7, held), (7, prose("seven", 80)), *((None, prose(f"null {i}", 80)) for i in range(20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.decontaminated(d, items).collect()) == sorted(t for _, t in rows if t != held)
    near = [(None, base), (None, base), *((None, base.replace(base.split()[k * 20 + 10], f"new{k}")) for k in range(4)), (None, prose("alone", 90)), (3, prose("three", 90)), (3, prose("three", 90) + " more")]
    out = near_dedup.deduplicated(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.split()[1] == base.split()[1]) for r in out) == [(0, False), (0, True), (3, False)]


def brute_quality(t):
    w = words_of(t)
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(win)
    covered = {p for k, x in enumerate(win) if n[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows, empty):
    more = [("again and again " * 60), "a b c a b c a b c", "x y x y x", "l\nl\n \nl", "é# é# ü"]
    d = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(900 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    got = collected(quality_rules.scored(d), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in [(i, t) for i, t, _ in rows] + [(900 + k, t) for k, t in enumerate(more)]:
        q = brute_quality(t)
        want.append((i, *q, q[0] < 50 or 100 * q[4] > 50 * q[0]))
    assert got == sorted(want, key=str)
    kept = {r.doc_id for r in quality_rules.scored(docs).filter("kept").collect()}
    assert {*range(12), 30, 31, 44} <= kept and not {40, 41, 42, 43, 50, 51} & kept
    out = quality_rules.passed(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality_rules.scored(empty).count() == 0


def test_weak_supervision_finds_faults_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    q = quality_rules.scored(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = q.selectExpr("avg(case when quality = 0 then cast(not kept as int) end) as caught", "avg(case when quality = 1 and not base_failed then cast(kept as int) end) as spared").first()
    assert r.caught > 0.95 and r.spared > 0.98


def test_good_documents_keep_one_odd_feature_at_every_size(spark):
    names = list(quality_rules.votes())
    clean, junk = (1, 1, 1, 1, 1, 1, 1), (-1, 1, 1, 1, 1, 1, 1)
    odd = [tuple(-1 if n == f"vote_{rule}" else 1 for n in names) for rule in ("vocabulary", "dup_lines", "shouting")]
    faults = [(1, -1, -1, 1, 1, -1, 1), (1, -1, 1, 1, -1, 1, 1), (1, -1, 1, 1, 1, -1, 1)]
    for scale in (1, 100, 10000):
        w = quality_rules.Weights({clean: 800 * scale, junk: 70 * scale, **{p: 10 * scale for p in odd}, **{p: 30 * scale for p in faults}}, names)
        assert all(w.classes(p)[0] > 0.5 for p in [clean, *odd]) and all(w.classes(p)[0] < 0.5 for p in [junk, *faults])
        d = spark.createDataFrame([clean, *odd, junk], ", ".join(f"{n} int" for n in names))
        got = [r.p for r in d.select(w.posterior().alias("p")).collect()]
        assert np.allclose(sorted(got), sorted(w.classes(p)[0] for p in [clean, *odd, junk]))


def test_planted_good_documents_with_one_bad_vote_are_kept(spark):
    def lines(i):
        return [prose(f"{i}_{k}", 12) + "." for k in range(12)]

    odd = {900: " ".join(prose("few", 3000, 120).split()), 901: "\n".join(["Item."] * 20 + lines("list")), 902: prose("loud", 200).upper().replace("W", "WX")}
    rows = [(i, "\n".join(lines(i))) for i in range(400)] + [(500 + i, " ".join(w + " ###" for w in prose(i, 80).split())) for i in range(30)] + list(odd.items())
    r = {x.doc_id: x for x in quality_rules.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [r[900].vote_vocabulary, r[901].vote_dup_lines, r[902].vote_shouting] == [-1, -1, -1]
    assert all(r[i].kept for i in [*range(400), *odd]) and not any(r[500 + i].kept for i in range(30))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, left, fixed = share * sum(sizes.values()), set(names), {}
    while left:
        level = (total - sum(fixed.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return fixed | {s: level * w[s] for s in left}
        fixed |= {s: most * sizes[s] for s in over}
        left -= over
    return fixed


@pytest.mark.parametrize("cell", [4096, 8])
def test_mixing(spark, cell):
    rows = [(i, prose(i, 1 + i * 7 % 40), None if i % 11 == 0 else f"s{i % 7 if i % 2 else 0}") for i in range(600)] + [(700, None, "s0"), (701, "", "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = mixing.mixed_sizes(d, cell=cell).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for x in r:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    assert len(r) == len(rows) and all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    again = mixing.mixed_sizes(d.repartition(7), cell=cell)
    assert collected(again, "doc_id", "taken") == sorted(((x.doc_id, x.taken) for x in r), key=str)
    out = mixing.mixed(d, cell=cell)
    assert out.columns == d.columns and out.count() == sum(x.copies for x in r)


@pytest.mark.parametrize("same", [None, 5])
def test_mixing_gives_a_row_for_each_document_whatever_its_id(spark, same):
    rows = [(same, prose(f"m{i}", 5 + i % 30), f"s{i % 3}") for i in range(90)] + [(same, "all alike here", "s0")] * 31
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    r = mixing.mixed_sizes(d).collect()
    assert len(r) == len(rows) and sorted(x.size for x in r) == sorted(len(t.split()) for _, t, _ in rows)
    by = defaultdict(list)
    for x in r:
        by[x.source].append(x)
        assert 0 <= x.taken <= 2 * x.size
    assert all(abs(sum(x.taken for x in xs) - xs[0].target) <= max(x.size for x in xs) for xs in by.values())
    out = Counter(x.text for x in mixing.mixed(d).collect())
    assert sum(out.values()) == sum(x.copies for x in r) and out["all alike here"] == sum(x.copies for x in r if x.size == 3)


def test_mixing_of_a_source_for_each_document(spark):
    d = spark.createDataFrame([(i, prose(i, 10 + i % 7), f"source {i}") for i in range(300)], "doc_id long, text string, source string")
    r = mixing.mixed_sizes(d, cell=32).collect()
    assert len(r) == 300 and all(abs(x.taken - x.target) <= x.size + 1e-6 for x in r)


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 50), rng.random(50)
    hits = np.zeros(50)
    for seed in range(400):
        out, held = mixing.pivot(np.arange(50), size, p, seed)
        assert ((out == 0) | (out == 1) | (np.arange(50) == held)).all()
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        hits += out
    assert np.abs(hits / 400 - p).max() < 0.12


def test_mixing_cases(docs, empty):
    assert mixing.mixed_sizes(docs).count() == docs.count()
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed_sizes(empty).count() == 0
