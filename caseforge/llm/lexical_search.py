"""Ranked lexical search: MaxScore whose bounds are those of term pairs.

The index. Each task cuts the documents it reads into shards of bounded text, one row a shard:
sorted term hashes, and for each term the documents that hold it with their counts. All terms
of all documents are indexed, nothing is shuffled, and a hot id, source or text is in no one's way.
What is counted over the whole corpus (documents, terms, document frequencies of asked terms) is
summed over the shards.

The queries are taken in passes of bounded bytes, each distinct text once. A pass's terms are
paired, per item, neighbours in the order of their document frequency, and each shard gets its
impact lists: every asked term's documents with their share of the score, and for every pair
the list of documents that hold both, with the largest joint impact. The documents that lead
the best of an item's lists in each shard are scored in full; the k-th of these scores over all
shards is a threshold that the item's k-th document reaches at least.

A shard then answers an item as MaxScore does, on pairs: a pair adds at most the largest of its
joint maximum and its terms' own maxima, which is below their sum where the terms' best documents
differ. Pairs are left out from the least on while the sum of their bounds is below the threshold;
documents only in these can't enter. The others' lists are added up, then the pairs left out one by one, the
largest first: a document stays while its score and what is left can reach the threshold, where
a document of the pair's list may get the joint maximum, another one the larger of the terms' own.
A shard puts out k rows an item at most, and those below the threshold not at all.

Terms are 64-bit hashes (``words``): of n distinct terms expect n^2 / 3.7e19 collisions.

Cases. A null or empty text has no terms: it isn't counted, and no item finds it. An item without terms,
or whose terms no document holds, has no rows. Rows that repeat a document id are documents of their own
and may each have a rank; rows that repeat an item id are items of their own. Equal scores go by
``doc_id``, null last, then by place. An id that is no number is returned as null. Fewer than k documents above 0: all of them.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .words import pack, pack_sorted, shares, unpack, unpack_sorted, word_hashes

K = 10
#: Bytes of text in a shard, and of item texts that one pass collects and broadcasts.
SHARD_BYTES, PASS_BYTES = 8 << 20, 2 << 20
#: Bytes of a term stand for themselves, all others for a space.
_SPACED = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
SHARD = "shard long, ids array<long>, with_terms long, n_terms long, lengths binary, terms binary, sizes binary, docs binary, counts binary"
_SHARD = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("with_terms", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("lengths", "terms", "sizes", "docs", "counts"))])
LISTS = "shard long, ids array<long>, lists array<binary>"
_LISTS = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("lists", pa.list_(pa.binary()))])
_SCORE = pa.schema([("item", pa.int32()), ("score", pa.int64())])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("shard", pa.int64()), ("place", pa.int32()), ("score", pa.int64())])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of the (binary) ``texts``, and how many each has: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    t = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = t.buffers()
    if data is None or not len(t):
        return np.zeros(0, np.uint64), np.zeros(len(t), np.int64)
    ends = np.frombuffer(ends, np.int64)[t.offset : t.offset + len(t) + 1]
    spaced = _SPACED[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    return word_hashes(pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(spaced)]))


def _shard(ids: list, texts: list[pa.Array]) -> pa.RecordBatch:
    hashes, sizes = (np.concatenate(x) for x in zip(*(term_hashes(t) for t in texts)))
    order = np.argsort(hashes, kind="stable")  # documents stay in order within a term
    h, d = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    first = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(d, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
    terms, n = np.unique(h[first], return_counts=True)
    packed = pack(sizes.astype(np.int64)), pack_sorted(terms), pack(n.astype(np.int32)), pack(d[first].astype(np.int32)), pack(np.diff(first, append=len(h)).astype(np.int32))
    row = [secrets.randbits(62), pa.concat_arrays(ids).to_pylist(), int((sizes > 0).sum()), int(sizes.sum()), *packed]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD)], schema=_SHARD)


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs``, kept in the shared checkpoint folder: one row a shard."""

    def shards_of(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            done = 0
            while done < b.num_rows:
                before = int(ends[done - 1]) if done else 0
                upto = max(done + 1, int(np.searchsorted(ends, before + shard_bytes - size, "right")))
                ids.append(b.column(0).slice(done, upto - done)), texts.append(b.column(1).slice(done, upto - done))
                size, done = size + int(ends[upto - 1]) - before, upto
                if size >= shard_bytes or done < b.num_rows:
                    yield _shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _shard(ids, texts)

    rows = docs.select(F.col(f"`{doc_id}`").try_cast("long").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return saved(rows.mapInArrow(shards_of, SHARD), let_go=False)


class Asked:
    """A pass's items: their terms as places among all its terms."""

    def __init__(self, texts: list[bytes]):
        hashes, sizes = term_hashes(pa.array(texts, pa.binary()))
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        own = [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.terms = np.unique(hashes)
        self.items = [np.searchsorted(self.terms, o) for o in own]
        self.df = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        """Weights from the document frequencies; each item's terms in pairs of like frequency, and singly if they are odd in number."""
        self.df, self.n_docs, self.n_terms = df, n_docs, n_terms
        of = {int(x): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in np.unique(df)}
        self.weights = np.array([of[x] for x in df.tolist()], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        self.units = []  # per item: (first term, second term or -1, pair or -1)
        for terms in self.items:
            held = sorted((t for t in terms.tolist() if df[t] and self.weights[t] > 0), key=lambda t: (-df[t], t))
            units = [(a, b, pairs.setdefault((a, b), len(pairs))) for a, b in zip(held[::2], held[1::2])]
            self.units.append(units + [(t, -1, -1) for t in held[len(units) * 2 :]])
        self.pairs = np.array(list(pairs), np.int64).reshape(-1, 2)


def frequencies(index: DataFrame, asked) -> np.ndarray:
    """In how many documents each asked term is, summed over the shards."""

    def counted(batches):
        a, df = asked.value, None
        for b in batches:
            for terms, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                terms, sizes = unpack_sorted(terms), unpack(sizes)
                _, own, place = np.intersect1d(a.terms, terms, assume_unique=True, return_indices=True)
                df = np.zeros(len(a.terms), np.int64) if df is None else df
                df[own] += sizes[place]
        if df is not None:
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(asked.value.terms), np.int64)
    for r in index.select("terms", "sizes").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def impacts(weight: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of documents of these lengths that hold it ``counts`` times; whole numbers throughout."""
    m = 100 - 90 + (90 * n_docs * lengths) // max(1, n_terms)
    return weight * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def with_lists(index: DataFrame, asked) -> DataFrame:
    """Per shard the lists of the asked terms, and of each pair the documents that hold both with the largest joint impact."""

    def listed(batches):
        a = asked.value
        for b in batches:
            for row in b.to_pylist():
                terms, sizes, docs, counts, lengths = unpack_sorted(row["terms"]), unpack(row["sizes"]), unpack(row["docs"]).astype(np.int64), unpack(row["counts"]).astype(np.int64), unpack(row["lengths"])
                _, own, place = np.intersect1d(a.terms, terms, assume_unique=True, return_indices=True)
                starts, n = (np.cumsum(sizes) - sizes)[place], sizes[place].astype(np.int64)
                at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
                d, t = docs[at], np.repeat(own, n)
                shares_ = impacts(a.weights[t], counts[at], lengths[d], a.n_docs, a.n_terms)
                ends = np.cumsum(n)
                where = np.full(len(a.terms), -1)
                where[own] = np.arange(len(own))
                both, held, joint = [], [], []
                first, second = where[a.pairs[:, 0]], where[a.pairs[:, 1]]
                slot = np.full(len(lengths), -1)
                for p in np.flatnonzero((first >= 0) & (second >= 0)).tolist():
                    x, y = (slice(int(ends[k] - n[k]), int(ends[k])) for k in (first[p], second[p]))
                    slot[d[x]] = np.arange(x.start, x.stop)
                    met = slot[d[y]]
                    hit = np.flatnonzero(met >= 0)
                    slot[d[x]] = -1
                    if len(hit):
                        both.append(d[y][hit])
                        held.append((p, len(hit)))
                        joint.append(int((shares_[met[hit]] + shares_[y][hit]).max()))
                pairs, sizes_ = np.array(held, np.int64).reshape(-1, 2).T
                lists = [own.astype(np.int32), n.astype(np.int32), d.astype(np.int32), shares_, pairs.astype(np.int32), sizes_.astype(np.int32), np.concatenate(both).astype(np.int32) if both else np.zeros(0, np.int32), np.array(joint, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["shard"], row["ids"], [pack(x) for x in lists]), _LISTS)], schema=_LISTS)

    return index.select("shard", "ids", "lengths", "terms", "sizes", "docs", "counts").mapInArrow(listed, LISTS)


class Lists:
    """A shard's lists: of each asked term its documents and impacts, of each pair its documents and joint maximum."""

    def __init__(self, ids: list, lists: list[bytes]):
        own, n, d, shares_, pairs, sizes, both, joint = map(unpack, lists)
        self.n_docs = len(ids)
        ends = np.cumsum(n).tolist()
        self.of = {t: (d[e - k : e], shares_[e - k : e]) for t, e, k in zip(own.tolist(), ends, n.tolist())}
        self.top = {t: int(i.max()) for t, (_, i) in self.of.items()}
        ends = np.cumsum(sizes).tolist()
        self.both = {p: (both[e - k : e], j) for p, e, k, j in zip(pairs.tolist(), ends, sizes.tolist(), joint.tolist())}
        ids = pa.array(ids, pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.order = np.empty(self.n_docs, np.int64)  # places among equal scores
        self.order[np.lexsort((ids.fill_null(0).to_numpy(), ~known))] = np.arange(self.n_docs)

    def bounds(self, units: list) -> list[tuple[int, tuple]]:
        """What each unit of an item can add in this shard, with the unit; those that add nothing aren't there."""
        out = []
        for u in units:
            own = max(self.top.get(u[0], 0), self.top.get(u[1], 0))
            if own:
                out.append((max(own, self.both[u[2]][1]) if u[2] in self.both else own, u))
        return out

    def leaders(self, units: list, k: int) -> np.ndarray:
        """Full scores of up to ``k`` documents: those that lead the item's list with the largest k-th impact (a pair's documents with what both terms add)."""
        found, most = None, (False, -1)
        for a, b, p in units:
            if p in self.both:
                docs, score = self.both[p][0], self._add([a, b], self.both[p][0])
            elif a in self.of or b in self.of:
                docs, score = self.of[a if a in self.of else b]
            else:
                continue
            m = min(k, len(score))
            if (kth := (m == k, int(np.partition(score, len(score) - m)[len(score) - m]))) > most:
                most, found = kth, docs[np.argpartition(score, len(score) - m)[len(score) - m :]]
        return np.zeros(0, np.int64) if found is None else self._add([t for a, b, _ in units for t in (a, b)], found)

    def _add(self, terms: list[int], docs: np.ndarray) -> np.ndarray:
        score = np.zeros(len(docs), np.int64)
        for t in terms:
            if t in self.of:
                d, i = self.of[t]
                at = np.searchsorted(d, docs)
                at[at == len(d)] = 0
                score += np.where(d[at] == docs, i[at], 0)
        return score

    def best(self, units: list, least: int, k: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the item's ``k`` best here that reach ``least``; ``seen`` gets how many units were left out and how many documents were looked at."""
        bounds = sorted(self.bounds(units))
        out, total = 0, 0
        while out < len(bounds) and total + bounds[out][0] < least:
            total += bounds[out][0]
            out += 1
        score = np.zeros(self.n_docs, np.int64)
        for _, (a, b, _p) in bounds[out:]:
            for t in (a, b):
                if t in self.of:
                    d, i = self.of[t]
                    score[d] += i
        alive = score > 0
        if seen is not None:
            seen.append((out, int(alive.sum())))
        left = total
        for bound, (a, b, p) in reversed(bounds[:out]):
            left -= bound
            may = np.full(self.n_docs, max(self.top.get(a, 0), self.top.get(b, 0)))
            if p in self.both:
                may[self.both[p][0]] = self.both[p][1]
            alive &= score + may + left >= least
            for t in (a, b):
                if t in self.of:
                    d, i = self.of[t]
                    on = alive[d]
                    score[d[on]] += i[on]
        found = np.flatnonzero(alive & (score >= max(1, least)))
        found = found[np.lexsort((self.order[found], -score[found]))][:k]
        return found, score[found]


def _each(batches):
    for b in batches:
        for row in b.to_pylist():
            yield row, Lists(row["ids"], row["lists"])


def thresholds(lists: DataFrame, asked, k: int) -> dict[int, int]:
    """Per item of the pass a score that its k-th document reaches: the k-th largest of the leaders' scores over all shards."""

    def led(batches):
        for _, s in _each(batches):
            found = [(i, s.leaders(u, k)) for i, u in enumerate(asked.value.units)]
            item, score = np.repeat([i for i, _ in found], [len(x) for _, x in found]), np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(score)], schema=_SCORE)

    at = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    kth = lists.mapInArrow(led, "item int, score long").withColumn("at", at).filter(F.col("at") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    return {r["item"]: r["score"] for r in kth.filter(F.col("n") == k).collect()}


def _found(lists: DataFrame, asked, least, k: int) -> DataFrame:
    def searched(batches):
        for row, s in _each(batches):
            parts = [(i, *s.best(u, least.value.get(i, 1), k)) for i, u in enumerate(asked.value.units)]
            item = np.repeat([i for i, _, _ in parts], [len(d) for _, d, _ in parts]).astype(np.int32)
            docs, score = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in (1, 2))
            ids = pa.array(row["ids"], pa.int64()).take(pa.array(docs))
            yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(np.full(len(item), row["shard"])), pa.array(docs.astype(np.int32)), pa.array(score)], schema=_FOUND)

    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place")
    out = lists.mapInArrow(searched, "item int, doc_id long, shard long, place int, score long")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents of the ``index``."""
    spark = items.sparkSession
    all_items = items.select(F.col(f"`{item_id}`").try_cast("long").alias("item_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text")).withColumn("digest", F.sha2("text", 256))
    texts = saved(all_items.groupBy("digest").agg(F.any_value("text").alias("text")), let_go=False)
    passes = shares(texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0, pass_bytes)
    totals = index.agg(F.sum("with_terms").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    ranks = None
    for number in range(passes):
        own = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(passes)) == number).collect()
        a = Asked([bytes(r["text"]) for r in own])
        told = spark.sparkContext.broadcast(a)
        df = frequencies(index, told)
        told.destroy()
        a.weigh(df, n_docs, n_terms)
        told = spark.sparkContext.broadcast(a)
        lists = saved(with_lists(index, told), let_go=False)
        least = spark.sparkContext.broadcast(thresholds(lists, told, k))
        names = spark.createDataFrame([(i, r["digest"]) for i, r in enumerate(own)], "item int, digest string")
        part = saved(_found(lists, told, least, k).join(names, "item").drop("item"), let_go=False)
        told.destroy(), least.destroy()
        ranks = part if ranks is None else ranks.unionByName(part)
    return all_items.select("item_id", "digest").join(ranks, "digest").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``search`` in an index of ``docs``."""
    return search(indexed(docs, doc_id, text, shard_bytes), items, k, item_id, item_text, pass_bytes)
