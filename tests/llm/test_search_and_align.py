import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseforge.llm import lexical_search, token_align, topk_search
from caseforge.llm.lexical_search import Asked, Lists
from caseforge.llm.words import pack

from .conftest import MORE, prose

ABSENT = (0,) * 6


def read(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def both():
    return token_align.tokenizers(read(token_align.BYTE_BPE), read(token_align.PIECE_BPE))


# Alignment


WHOLE = Tokenizer.from_file(token_align.BYTE_BPE)
WHOLE.encode_special_tokens = True


def brute_groups(t, text):
    """Groups of one text, token by token: A from the JSON file's own library."""
    a, b = WHOLE.encode(" " + text, add_special_tokens=False).ids if text else [], t.pieces.encode(text) if text else []
    if not text or b"".join(t.bytes_a[i] for i in a) != (" " + text).encode() or b"".join(t.bytes_b[i] for i in b) != (" " + text).encode():
        return []
    out, i, j, x, y, g = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            g[0].append(a[i])
            x += len(t.bytes_a[a[i]])
            i += 1
        else:
            g[1].append(b[j])
            y += len(t.bytes_b[b[j]])
            j += 1
        if x == y:
            out.append(g)
            g = ([], [])
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute_alignment(t, texts):
    groups = [brute_groups(t, x or "") for x in texts]
    links = [Counter((a, b) for g in own for a in g[0] for b in g[1]) for own in groups]
    docs = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for own, l in zip(groups, links):
        best = sum(n for p, n in l.items() if docs[p] == most[p[0]])
        out.append((sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), sum(l.values()), best, sum(n * docs[p] for p, n in l.items()), hashlib.sha256(written(own).encode()).hexdigest() if own else ""))
    return out, docs


TEXTS = [
    "one two three", "one two three", "one  two\n\n three\t", "Naïve café – “quoted” 東京 🙂 é", "x▁y", "<|endoftext|> and <s> </s> <unk>", " leading and trailing ",
    "\x00\x01 odd ​ bytes  　", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a", " ", "\n", None, "", "don't I'll we've 12345 3.14159 ---- ====", "ééé" * 40,
]


def test_alignment_equals_brute_force(spark, both):
    texts = [*TEXTS, *(prose(k, 60) for k in range(12)), *[prose("hot", 40)] * 9, prose("long", 20000)]
    want, docs = brute_alignment(both, texts)
    df = spark.createDataFrame([(k, x, "t", 1, 1, 2, 3, "x", "y", 4) for k, x in enumerate(texts)], "doc_id long, text string, digest string, n_a long, " + MORE).repartition(4)
    for block_bytes in (2000, 8 << 20):
        rows = token_align.measured(df, block_bytes=block_bytes)
        assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert [tuple(r)[1:] for r in sorted(rows.collect())] == want
    assert {(r.a, r.b): r.docs for r in token_align.pair_counts(df, block_bytes=2000).collect()} == docs
    groups = {r.doc_id: r.groups for r in token_align.grouped(df).collect()}
    assert groups == {k: written(brute_groups(both, x or "")) for k, x in enumerate(texts)}
    assert want[4][:6] == ABSENT and want[12][:6] == ABSENT and want[5][0] > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_groups_and_links_of_any_texts(both, texts):
    own = token_align.Aligned(both, texts)
    groups = [brute_groups(both, t) for t in texts]
    assert [w.decode() for w in own.written(both)] == [written(g) for g in groups]
    assert own.n_links.tolist() == [sum(len(a) * len(b) for a, b in g) for g in groups]
    of, pairs, times = own.links()
    got = Counter()
    for k, p, n in zip(of.tolist(), pairs.tolist(), times.tolist()):
        got[k, p >> 16, p & 0xFFFF] += n
    assert got == Counter((k, a, b) for k, gs in enumerate(groups) for g in gs for a in g[0] for b in g[1])


def test_large_groups_are_counted_not_paired(both, monkeypatch):
    texts = ["aaaaaaaaaaaaaaaaaaaaaaa bbb", "日本語のテキスト", prose(3, 30)]
    want = [x.tolist() for x in token_align.Aligned(both, texts).links()]
    monkeypatch.setattr(token_align, "LARGE_GROUP", 1)
    assert [x.tolist() for x in token_align.Aligned(both, texts).links()] == want


def test_alignment_of_nothing(spark, empty):
    assert token_align.measured(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (None, ""), (2, "▁")], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in token_align.measured(blank).collect()) == [(*ABSENT, "")] * 3


# Ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(t):
    return TERM.findall((t or "").translate(LOWER))


def brute_ranks(docs, items, k=10):
    terms = [(i, Counter(terms_of(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in terms:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            scores.append((i, sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in {*terms_of(text)} if t in c)))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(scores[:k]) if s > 0]
    return sorted(out, key=str)


def skewed(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"W{int(vocabulary * r.random() ** 3)}" for _ in range(n))


def test_ranks_equal_brute_force(spark):
    docs = [(k, skewed(k, 5 + k % 90)) for k in range(150)] + [(None, skewed(7, 30)), (None, skewed(8, 30)), (9, skewed(9, 14)), (9, skewed(9, 14)), (500, None), (501, ""), (502, ".,;"), (503, skewed("long", 30000)), (504, "Ünïcode ÉÉ été 東京 w1")]
    docs += [(600 + k, "hot words hot") for k in range(60)]
    items = [(k, skewed(f"q{k}", 3 + k)) for k in range(25)] + [(30, None), (31, "?"), (32, "absent terms"), (33, "hot"), (33, "hot"), (34, "hot words of w3 and w3"), (None, "ünïcode W1 éé"), (35, " ".join(f"w{k}" for k in range(400)))]
    d = spark.createDataFrame([(i, t, "s", 1, 1, 2, 3, "x", "y", 4) for i, t in docs], "doc_id long, text string, shard string, score long, " + MORE).repartition(3)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, digest int")
    want = brute_ranks(docs, items)
    for shard_bytes, pass_bytes in ((1500, 2 << 20), (8 << 20, 150)):
        got = lexical_search.ranked(d, q, shard_bytes=shard_bytes, pass_bytes=pass_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def lists_of(own, n_docs, pairs):
    """A shard with the given lists: term -> {document: impact}."""
    terms = sorted(own)
    both = {p: sorted({*own[a]} & {*own[b]}) for p, (a, b) in enumerate(pairs) if {*own.get(a, {})} & {*own.get(b, {})}}
    joint = [max(own[pairs[p][0]][d] + own[pairs[p][1]][d] for d in ds) for p, ds in both.items()]
    flat = lambda x, t: np.array(list(x), t)
    parts = [flat(terms, np.int32), flat((len(own[t]) for t in terms), np.int32), flat((d for t in terms for d in sorted(own[t])), np.int32), flat((own[t][d] for t in terms for d in sorted(own[t])), np.int64)]
    parts += [flat(both, np.int32), flat(map(len, both.values()), np.int32), flat((d for ds in both.values() for d in ds), np.int32), flat(joint, np.int64)]
    return Lists(list(range(n_docs)), [pack(p) for p in parts])


def test_pair_bounds_skip_more_than_single_ones():
    # Two frequent terms whose best documents differ: alone 50 + 50, together 55 at most; a rare one adds 40.
    own = {0: {d: 50 if d < 10 else 5 for d in range(60)}, 1: {d: 50 if d >= 50 else 5 for d in range(60)}, 2: {3: 40, 55: 40}}
    paired = lists_of(own, 60, [(0, 1)])
    seen, single = [], []
    units = [(0, 1, 0), (2, -1, -1)]
    assert [x.tolist() for x in paired.best(units, 60, 2, seen)] == [[3, 55], [95, 95]]
    assert [x.tolist() for x in paired.best([(0, -1, -1), (1, -1, -1), (2, -1, -1)], 60, 2, single)] == [[3, 55], [95, 95]]
    assert seen == [(1, 60)] or seen[0][1] < single[0][1]
    assert paired.best(units, 96, 2)[0].tolist() == [] and paired.bounds([(0, 1, 0)])[0][0] == 55


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6))
def test_a_shard_answers_like_a_full_sum(seed):
    r = random.Random(seed)
    n, terms = r.randrange(1, 40), r.randrange(1, 9)
    own = {t: {d: r.randrange(1, 60) for d in r.sample(range(n), r.randrange(1, n + 1))} for t in range(terms)}
    pairs = [(a, a + 1) for a in range(0, terms - 1, 2)]
    units = [(a, b, p) for p, (a, b) in enumerate(pairs)] + [(terms - 1, -1, -1)] * (terms % 2)
    s, k, least = lists_of(own, n, pairs), r.randrange(1, 6), r.randrange(1, 200)
    full = sorted(((sum(own[t].get(d, 0) for t in own), d) for d in range(n)), key=lambda x: (-x[0], x[1]))
    docs, score = s.best(units, least, k)
    assert list(zip(score.tolist(), docs.tolist())) == [x for x in full if x[0] >= least][:k]
    led = sorted(s.leaders(units, k).tolist(), reverse=True)
    assert all(a <= b for a, (b, _) in zip(led, full))


def test_ranks_of_nothing(spark, empty, items):
    assert lexical_search.ranked(empty, items).count() == 0
    assert lexical_search.ranked(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert Asked([b"", b"A a b"]).items[1].tolist() == [0, 1]


# Top k


def brute_top(rows, k=5):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fit:
        if i is not None and i % 50 == 0:
            scores = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c)))), j is None, j or 0, j) for j, c in fit if j != i))
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(scores[:k])]
    return sorted(out, key=str)


def topped(spark, table, **options):
    df = spark.createDataFrame([(i, v, 1, 1, 2, 3, "x", "y", 4) for i, v in table], "vec_id long, embedding array<double>, label int, " + MORE).repartition(3)
    got = topk_search.nearest(df, df.filter("vec_id % 50 = 0"), **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("blocks", [{"rows": 37, "at_once": 3}, {}])
def test_top_products_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=30) * np.exp(-np.arange(30) / 6)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # a vector of many rows
    rows += [(2000, None), (2050, [None] * 30), (2100, [float("nan")] * 30), (2150, [float("inf")] + [0.0] * 29), (None, rows[0][1]), (7, rows[7][1]), (2200, [0.1, 5.0]), (2250, []), (2300, [1.0] * 34)]
    assert topped(spark, rows, **blocks) == brute_top(rows)


def test_large_numbers_and_few_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 15)).tolist()) for i in range(0, 600, 10)]
    assert topped(spark, rows) == brute_top(rows)
    assert topped(spark, [(0, [1.0]), (50, [2.0]), (51, [2.0])]) == [(0, 1, 50, 131072), (0, 2, 51, 131072), (50, 1, 51, 262144), (50, 2, 0, 131072)]
    assert topped(spark, [(0, [1.0])]) == [] and topped(spark, [(1, [1.0])][:0]) == []


def test_bounds_leave_few_pairs_for_the_last_steps():
    rng = np.random.default_rng(6)
    m = np.floor(256 * rng.normal(size=(64, 3000)) * np.exp(-np.arange(64) / 8)[:, None]).astype(np.int64)
    c = topk_search.Columns(0, list(range(3000)), 64, pack(m))
    q = topk_search.Columns(1, list(range(100)), 64, pack(m[:, :100].copy()))
    seen = []
    row, col, score = topk_search.survivors(q, c, slice(0, 64), 5, seen=seen)
    assert seen[0] == 64 * 3000 and seen[-1] < 0.02 * seen[0]
    want = m[:, :64].T @ m
    np.fill_diagonal(want, -(1 << 60))
    assert (score == want[row, col]).all()
    for i in range(64):
        assert {*np.argsort(-want[i], kind="stable")[:5].tolist()} <= {*col[row == i].tolist()}
