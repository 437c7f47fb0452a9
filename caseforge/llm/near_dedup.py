"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Texts with the same words are one node (a 64-bit digest); its multiplicity counts in
   document frequencies.
2. The document frequency of every five-word shingle is taken over all documents (``words``:
   blocks ask, buckets answer). Its inverse is scaled to lie between 1 (in all documents) and 2
   (in one), whatever the corpus's size. A shingle in one text only can't be shared, so its
   weight counts but it needs no sample of its own: the least of many sampled values is itself
   an exponential variate with their total weight.
3. A document whose shared weight is below the threshold can't reach it with any other. The
   rest draw 96 consistent weighted samples (Ioffe 2010), in 24 bands of 4.
4. Members of a bucket are compared with its hub, the least edited member, and in a large bucket
   with the hub of their chunk of members; what links then is one class. Buckets that have two
   classes or more compare all members of different classes, whatever their size: small ones
   pair by pair, large ones chunk by chunk (``bucket_pairs``). Pairs whose weights and shared
   weights exclude the threshold are dropped unread, and so are members that can't reach it
   with any in their bucket.
5. Verification is exact: weighted Jaccard over TF-IDF, or over plain term counts, of
   ``threshold`` or more.

A class is a connected component of the verified links. Its least row by id, then
node, is kept: one text a class, whatever ids its rows share or lack.

Chance of a miss. Two documents with similarity s under TF-IDF share no band with probability
(1 - s^4)^24: 3e-6 at 0.8. Similarity 0.8 under plain counts is two thirds or more under these
weights, as they lie between 1 and 2: 5e-3 at worst. No pair of a bucket is left out, however
large the bucket. That is for the pair alone; a class holds together if any path of its links is seen.

Cases. A text under five words has one shingle, all its words. Texts without words (null,
empty, blank) are copies of each other. Rows that repeat an id are rows of their own. A null
id sorts last and is returned as null, as is an id that is no number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bucket_pairs import class_links
from .graph import components
from .store import fresh, saved
from .words import (
    BLOCK_BYTES,
    BUCKET_BYTES,
    REQUEST,
    answered,
    answers,
    answers_of,
    block_of,
    block_shingles,
    by_text,
    collapsed,
    mix,
    pack,
    pack_sorted,
    requests,
    shares,
    text_bytes,
    unpack,
    unpack_sorted,
    word_hashes,
)

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
NO_ID = (1 << 63) - 1
#: Shingles that the sampler takes at once.
SLICE = 1024
#: Members of a bucket in a chunk with a hub of its own; members up to which a bucket's pairs are read one by one.
HUB_MEMBERS, SMALL = 256, 32


def node_of(words: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64))


def nodes(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with a column ``into``: the digest of the words of its text."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())])

    def digest(batches):
        at = names.index(text)
        for b in batches:
            found = [node_of(w) for w in by_text(b.column(at).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*names, into])

    return docs.mapInArrow(digest, schema)


class _Tables:
    """Variates of the sampler: 65,536 triples of r, beta and a number that c goes into."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << 16
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        log_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        #: ln c - r (1 - beta): what is left of the sampled value is - r times the step.
        self.base = log_c - self.r * (np.float32(1) - self.beta)
        self.odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(t: _Tables, keys: np.ndarray, weights: np.ndarray, rest: float, node: int) -> np.ndarray:
    """Consistent weighted samples of the shared shingles ``keys``; 0 where the ``rest`` of the weight wins."""
    cols = np.arange(len(t.odd))
    least, out = np.full(len(cols), np.inf, np.float32), np.zeros(len(cols), np.uint64)
    for a in range(0, len(keys), SLICE):
        k = keys[a : a + SLICE]
        at = ((k[:, None] * t.odd[None, :]) >> np.uint64(48)).astype(np.intp)
        r = t.r[at]
        step = np.log(weights[a : a + SLICE]).astype(np.float32)[:, None] / r
        step += t.beta[at]
        np.floor(step, out=step)
        r *= step
        value = t.base[at] - r
        best = value.argmin(0)
        won = value[best, cols] < least
        least = np.where(won, value[best, cols], least)
        out = np.where(won, mix(k[best] + mix(step[best, cols].astype(np.int64).astype(np.uint64) + t.odd)), out)
    if rest > 0:
        u = (mix(t.odd + np.uint64(node & (1 << 64) - 1)) >> np.uint64(11)).astype(float) / (1 << 53)
        out[np.log(-np.log(np.maximum(u, 1e-300)) / rest) < least] = 0
    return out


def inverse_frequency(df: np.ndarray, total: int) -> np.ndarray:
    """1 for what all documents have to 2 for what one has."""
    return 1 + np.log((1 + total) / (1 + df)) / np.log(1 + max(1, total))


class _Shingles:
    """The shingles of the texts of a block that stand for a node: of text k ``place`` (in the sorted ``keys``) and ``tf`` from ``at[k]`` to ``at[k + 1]``."""

    def __init__(self, docs: pa.Table, owners: pa.Table):
        stands = {(o["row"], o["node"]): o["n"] for o in owners.select(["row", "node", "n"]).to_pylist()}
        hashes, sizes = word_hashes(docs["text"])
        ends = np.cumsum(sizes)
        self.node, self.n, chosen = [], [], np.zeros(len(sizes), bool)
        for k, (row, end, size) in enumerate(zip(docs["row"].to_pylist(), ends.tolist(), sizes.tolist())):
            n = stands.pop((row, node := node_of(hashes[end - size : end])), None)
            if n is not None and size:
                self.node.append(node), self.n.append(n)
                chosen[k] = True
        keys, text = block_shingles(hashes[np.repeat(chosen, sizes)], sizes[chosen])
        self.keys, place = np.unique(keys, return_inverse=True)
        code, self.tf = np.unique(text * max(1, len(self.keys)) + place, return_counts=True)
        text, self.place = np.divmod(code, max(1, len(self.keys)))
        self.at = np.searchsorted(text, np.arange(len(self.node) + 1))

    def sent(self) -> np.ndarray:
        docs = np.bincount(self.place, np.repeat(self.n, np.diff(self.at)), len(self.keys))
        return np.stack([docs, np.bincount(self.place, minlength=len(self.keys))], 1).astype(np.uint32)


def _frequency(place, sent):
    """Documents that hold the shingle; 0 if they all have one text."""
    docs, texts = np.bincount(place, sent[:, 0]), np.bincount(place, sent[:, 1])
    return np.where(texts > 1, docs, 0).astype(np.uint32), np.zeros(1, np.int64)


VECTORS = "node long, weight double, terms double, own_weight double, own_terms double, drawn array<long>, keys binary, tf binary, idf binary"
_VECTORS = pa.schema([("node", pa.int64()), ("weight", pa.float64()), ("terms", pa.float64()), ("own_weight", pa.float64()), ("own_terms", pa.float64()), ("drawn", pa.list_(pa.int64())), ("keys", pa.binary()), ("tf", pa.binary()), ("idf", pa.binary())])


def vectors(texts: DataFrame, owners: DataFrame, total: int, threshold: float, size: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """Samples and shared shingles of the texts that can be near copies of another."""
    blocks, buckets = shares(size, block_bytes), shares(size, bucket_bytes)
    by_block = collapsed(texts, "text").withColumn("block", block_of(blocks, "row")).groupBy("block")
    own = owners.withColumn("block", block_of(blocks, "row"))

    def ask(key, docs_, owners_):
        s = _Shingles(docs_, owners_)
        return requests(key[0].as_py(), s.keys, s.sent(), buckets)

    def draw(docs_, told):
        is_owner = np.asarray(told["row"].is_valid())
        s = _Shingles(docs_, told.filter(pa.array(is_owner)))
        found = answers(told.filter(pa.array(~is_owner)))
        tables, out, at = _Tables(), [], s.at.tolist()
        for node, n, a, b in zip(s.node, s.n, at, at[1:]):
            place, tf = s.place[a:b], s.tf[a:b]
            df = found[place].astype(np.int64)
            shared = df > 0
            idf = inverse_frequency(np.where(shared, df, n), total)
            w = tf * idf
            weight, terms = w.sum(), float(tf.sum())
            if w[shared].sum() < threshold * weight * (1 - 1e-9) and tf[shared].sum() < threshold * terms:
                continue
            keys = s.keys[place[shared]]
            drawn = samples(tables, keys, w[shared], weight - w[shared].sum() if not shared.all() else 0.0, node)
            out.append((node, weight, terms, w[shared].sum(), float(tf[shared].sum()), drawn.view(np.int64).tolist(), pack_sorted(keys), pack(tf[shared].astype(np.uint32)), pack(idf[shared].astype(np.float32))))
        return pa.table([list(c) for c in zip(*out)], schema=_VECTORS) if out else _VECTORS.empty_table()

    asked = by_block.cogroup(own.groupBy("block")).applyInArrow(ask, REQUEST)
    told = answers_of(answered(asked, _frequency)).unionByName(own.select("block", "row", "node", "n"), allowMissingColumns=True)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(draw, VECTORS)


def _verified(pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity reaches the threshold."""

    def similar(batches):
        for batch in batches:
            a, b = [], []
            for x in batch.to_pylist():
                ka, kb = unpack_sorted(x["keys"]), unpack_sorted(x["keys_b"])
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                tf = np.minimum(unpack(x["tf"])[i], unpack(x["tf_b"])[j])
                terms, weight = float(tf.sum()), float((tf * unpack(x["idf"])[i].astype(float)).sum())
                if max(weight / (x["weight"] + x["weight_b"] - weight), terms / (x["terms"] + x["terms_b"] - terms)) >= threshold - 1e-9:
                    a.append(x["a"]), b.append(x["b"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    v = vecs.drop("drawn", "own_weight", "own_terms")
    left = v.withColumnRenamed("node", "a")
    right = v.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in v.columns if c != "node"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(similar, "a long, b long")


SIZES = ("weight", "terms", "own_weight", "own_terms")


def _can_reach(threshold: float, slack: float = 1e-4) -> Column:
    """Whether the shared weights of a pair leave room for the threshold: the common part is in the shared part of both."""

    def room(whole: str, own: str) -> Column:
        common = F.least(own, f"{own}_h")
        return common >= (threshold - slack) * (F.col(whole) + F.greatest(f"{whole}_h", common) - common)

    return room("weight", "own_weight") | room("terms", "own_terms")


def _spread(vecs: DataFrame) -> DataFrame:
    """A row for each node and band whose samples all are shared shingles."""
    of = f"slice(drawn, {ROWS} * j + 1, {ROWS})"
    bands = F.expr(f"filter(transform(sequence(0, {BANDS - 1}), j -> named_struct('none', array_contains({of}, 0L), 'band', xxhash64(j, {of}))), x -> not x.none)")
    sizes = [F.col(c).cast("float").alias(c) for c in SIZES]
    return vecs.select("node", *sizes, F.explode(bands).alias("x")).select("node", "x.band", *SIZES)


HUB = ["node", "root", *SIZES]


def _hub() -> Column:
    """The least edited member."""
    return F.max_by(F.struct(*HUB), F.struct(F.col("own_terms") / F.col("terms"), -F.col("node"))).alias("hub")


def _against(hub: str) -> list[Column]:
    return [F.col(f"{hub}.{c}").alias(f"{c}_h") for c in HUB]


def _pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``node`` and ``node_h``, if they can be linked and aren't yet."""
    can = members.filter((F.col("node") != F.col("node_h")) & (F.col("root") != F.col("root_h")) & _can_reach(threshold))
    return can.select(F.least("node", "node_h").alias("a"), F.greatest("node", "node_h").alias("b"))


class _Linker:
    """Compares members of buckets and keeps the links found."""

    def __init__(self, vecs: DataFrame, threshold: float, hub_members: int):
        self.vecs, self.threshold, self.hub_members = vecs, threshold, hub_members
        self.links = self.roots = None

    def rooted(self, members: DataFrame) -> DataFrame:
        if self.roots is None:
            return members.withColumn("root", F.col("node"))
        return members.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def members(self, spread: DataFrame) -> DataFrame | None:
        """The members that can reach the threshold in a bucket of two classes or more, with its hub and size ``n``; None if there is no bucket."""
        rooted = self.rooted(spread)
        # The largest shared and the least whole weights of a bucket bound what a member can reach there.
        ends = [F.max(c).alias(f"{c}_h") if c.startswith("own") else F.min(c).alias(f"{c}_h") for c in SIZES]
        buckets = rooted.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), _hub(), *ends)
        # Saved, so that the join reads both sides straight from a shuffle: only then can Spark split a hot bucket.
        buckets = saved(buckets.filter("low < high").drop("low", "high"), let_go=False)
        if buckets.isEmpty():
            return None
        return saved(rooted.join(buckets, "band").filter(_can_reach(self.threshold)).select("band", "n", "hub", *HUB), let_go=False)

    def hub_pairs(self, members: DataFrame) -> DataFrame:
        to_hub = members.select("node", "root", *SIZES, *_against("hub"))
        # A power of two, so that buckets of like size are cut alike and share hubs.
        chunks = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / self.hub_members))).cast("long")
        cut = members.filter(F.col("n") > self.hub_members).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).drop("hub")
        to_chunk = cut.join(cut.groupBy("band", "chunk").agg(_hub()), ["band", "chunk"]).select("node", "root", *SIZES, *_against("hub"))
        return _pairs(to_hub, self.threshold).union(_pairs(to_chunk, self.threshold))

    def all_pairs(self, members: DataFrame) -> DataFrame:
        own = members.select("band", *HUB)
        other = own.select(*(F.col(c).alias(f"{c}_h") for c in own.columns))
        return _pairs(own.join(other, (F.col("band") == F.col("band_h")) & (F.col("node") < F.col("node_h"))), self.threshold)

    def compare(self, pairs: DataFrame) -> None:
        pairs = saved(pairs.distinct(), let_go=False)
        self.add(_verified(pairs, self.vecs, self.threshold))

    def add(self, links: DataFrame) -> None:
        found = saved(links, let_go=False)
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)


def linked(vecs: DataFrame, threshold: float = THRESHOLD, hub_members: int = HUB_MEMBERS, small: int = SMALL) -> DataFrame:
    """``(node, root)`` of the nodes that have a near copy of other words."""
    linker = _Linker(vecs, threshold, hub_members)
    none = vecs.select("node", F.col("node").alias("root")).limit(0)
    members = linker.members(_spread(vecs))
    if members is None:
        return none
    linker.compare(linker.hub_pairs(members))
    if linker.links is not None:
        linker.roots = components(linker.links)
    now = linker.rooted(members.drop("root", "hub"))
    mixed = saved(now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band"), let_go=False)
    now = saved(now.join(mixed, "band"), let_go=False)
    linker.compare(linker.all_pairs(now.filter(F.col("n") <= small)))
    large = now.filter(F.col("n") > small)
    if not large.isEmpty():
        linker.add(class_links(large, vecs, threshold))
    return none if linker.links is None else components(linker.links)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, **linking) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (the least id of its class), ``class_size, exact_copies, kept``."""
    d = docs.select(F.coalesce(F.col(doc_id).try_cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("binary").alias("text"))
    d = d.withColumn("row", F.xxhash64("id", "text"))
    rows = saved(nodes(d, "text", "node").select("id", "row", "node"), let_go=False)
    owners = saved(rows.groupBy("node").agg(F.min(F.struct("id", "row")).alias("o"), F.count("*").alias("n")).select("node", "o.id", "o.row", "n"), let_go=False)
    total = owners.agg(F.sum("n").alias("n")).first()["n"] or 0
    vecs = saved(vectors(d.select("row", "text"), owners, total, threshold, text_bytes(d, "text"), block_bytes, bucket_bytes))
    roots = linked(vecs, threshold, **linking)
    of_node = owners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_class = of_node.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least"), F.sum("n").alias("class_size"))
    told = of_node.join(of_class, "root").select("node", "n", F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node"), "class_size")
    return rows.join(told, "node").select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("class_id", F.lit(NO_ID)).alias("class_id"),
        "class_size",
        F.col("n").alias("exact_copies"),
        ((F.col("id") == F.col("class_id")) & (F.col("node") == F.col("class_node"))).alias("kept"),
        F.col("node").alias("text_node"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one with the least id; all columns as they were."""
    plain, (key, node) = docs.columns, fresh(docs, "_keep_id", "_keep_node")
    keep = classes(docs, doc_id, text, **options).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_node").alias(node)).distinct()
    marked = nodes(docs, text, node).withColumn(key, F.coalesce(F.col(doc_id).try_cast("long"), F.lit(NO_ID)))
    return marked.join(keep, [key, node], "left_semi").dropDuplicates([key, node]).select(*plain)
