"""Tokens of two tokenizers aligned by the bytes they cover.

Exact-text deduplication: the documents are shuffled by their full text (rows alike in text are
counted in each task beforehand, so a text of a third of all rows arrives once a task), and each
distinct text is tokenised and aligned once. Both token sequences cover the bytes of a space and
the text; offsets where tokens of both end cut them into groups, and every A token of a group is
linked with every B token of it. Texts are taken in blocks of bounded bytes. A block is one row:
what its texts measure, its distinct id pairs with the number of documents that hold them (each
text counts as often as it stands in the table), and each text's pairs as places among those.

Pair counts of the corpus are a plain aggregate over the blocks' distinct pairs, the highest
count of an A id another; both come back to the blocks by one join on the pair and meet the
blocks' rows again by block. A pair in every document is one row per block. The measures of a text
are joined to the documents by the text's SHA-256; only that digest and the id are shuffled there.

A is a byte-level BPE read from its JSON file: its vocabulary is in the order of the merges, so the
ids are the ranks of a rank-based encoder, which gives the same ids (a test compares them). B is a
sentencepiece model with byte fallback. Both files are read on the driver and broadcast (2 MB).

Cases. A null or empty text, or one whose joined token bytes differ from space and text for A
or B (a text with U+2581, which B takes for a space), has no tokens: zeros and an empty string.
Repeated rows are documents of their own, with the same measures; each counts in the pair counts.
An id that is no number is returned as null. Special tokens' strings are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, saved
from .words import pack, pack_sorted, unpack, unpack_sorted

#: Where the vocabulary files are; a parameter of every function here.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of distinct text in a block and of those that are aligned at once, and links of one group from which on its ids are counted before they are paired.
BLOCK_BYTES, SLICE_BYTES, LARGE_GROUP = 8 << 20, 1 << 18, 1 << 12
#: How a byte-level BPE cuts a text beforehand, and the bytes that stand for themselves in its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))
#: The space that a sentencepiece vocabulary writes.
LOW_LINE = "▁"
WIDTH = np.uint64(1 << 16)


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        others = (b for b in range(256) if b not in PRINTED)
        byte_of = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in json.loads(byte_bpe)["model"]["vocab"].items() if all(c in byte_of for c in token)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        p = self.pieces
        self.bytes_b = [bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(LOW_LINE, " ").encode() for i in range(p.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: An id's decimal with what follows it: "," or "|" after A, "," or ";" after B.
        self.written = [f"{i}{mark}".encode() for mark in ",|;" for i in range(int(WIDTH))]

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each text under both; none under either where the tokens' bytes aren't the space and the text."""
        a = [self.bpe.encode_ordinary(" " + t) for t in texts]
        b = self.pieces.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(self.bytes_a.__getitem__, a[k])) != whole or b"".join(map(self.bytes_b.__getitem__, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b


@functools.lru_cache(2)
def tokenizers(byte_bpe: bytes, piece_bpe: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


class Aligned:
    """The groups of many texts: per token its id and its group, per group its text and its sizes."""

    def __init__(self, t: Tokenizers, texts: list[str]):
        a, b = t.encoded(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((a, self.n_a), (b, self.n_b)))
        end_a, end_b = np.cumsum(t.length_a[self.a]), np.cumsum(t.length_b[self.b])
        ends = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), bool)
        ends[0, end_a], ends[1, end_b] = True, True
        self.last_a, self.last_b = ends[1, end_a], ends[0, end_b]
        self.group_a, self.group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        groups = int(self.last_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.text = np.repeat(np.arange(len(texts)), self.n_a)[np.flatnonzero(self.last_a)]
        self.n_groups = np.bincount(self.text, minlength=len(texts))
        self.n_links = np.bincount(self.text, self.size_a * self.size_b, len(texts)).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (A's id times 2^16 plus B's) and how often the text links it, in this order."""
        first_b = np.cumsum(self.size_b) - self.size_b
        large = self.size_a * self.size_b > LARGE_GROUP
        own = np.flatnonzero(~large[self.group_a])
        g = self.group_a[own]
        each = self.size_b[g]
        at = np.repeat(first_b[g] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        head = (self.text[g].astype(np.uint64) * WIDTH + self.a[own].astype(np.uint64)) * WIDTH
        keys, times = np.unique(np.repeat(head, each) + self.b[at].astype(np.uint64), return_counts=True)
        if large.any():
            keys, times = [keys], [times]
            for k in np.flatnonzero(large).tolist():
                a, n = np.unique(self.a[np.searchsorted(self.group_a, k) : np.searchsorted(self.group_a, k, "right")], return_counts=True)
                b, m = np.unique(self.b[first_b[k] : first_b[k] + self.size_b[k]], return_counts=True)
                keys.append((((np.uint64(self.text[k]) * WIDTH + a.astype(np.uint64)) * WIDTH)[:, None] + b.astype(np.uint64)).reshape(-1))
                times.append(np.outer(n, m).reshape(-1))
            keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(place, np.concatenate(times), len(keys)).astype(np.int64)
        return (keys // (WIDTH * WIDTH)).astype(np.int64), keys % (WIDTH * WIDTH), times

    def written(self, t: Tokenizers) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        before_b, up_to_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + self.last_a * int(WIDTH)
        codes[np.arange(len(self.b)) + up_to_a[self.group_b]] = self.b + self.last_b * 2 * int(WIDTH)
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return [b"".join(map(t.written.__getitem__, codes[x:y].tolist()))[:-1] for x, y in zip(cuts, cuts[1:])]


def _slices(batches, slice_bytes: int = SLICE_BYTES):
    """Texts and their copies, in lists of about so many bytes."""
    texts, copies, size = [], [], 0
    for b in batches:
        for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if size and size + len(t) > slice_bytes:
                yield texts, copies, size
                texts, copies, size = [], [], 0
            texts.append(t)
            copies.append(n)
            size += len(t)
    if texts:
        yield texts, copies, size


class Block:
    """What the texts of a block measure and link, gathered slice by slice; tokens go with their slice."""

    def __init__(self):
        self.bytes, self.digests, self.hashes, self.copies, self.counts = 0, [], [], [], []
        self.links = []  # per slice: text, pair, times

    def add(self, t: Tokenizers, texts: list[str], copies: list[int], size: int) -> None:
        own = Aligned(t, texts)
        of, pairs, times = own.links()
        self.links.append(((of + len(self.digests)).astype(np.int32), pairs.astype(np.uint32), times))
        self.counts.append(np.stack([own.n_a, own.n_b, own.n_groups, own.n_links]))
        self.hashes += [hashlib.sha256(w).hexdigest() if w else "" for w in own.written(t)]
        self.digests += [hashlib.sha256(x.encode()).digest() for x in texts]
        self.copies += copies
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        of, pairs, times = (np.concatenate(x) for x in zip(*self.links))
        distinct = np.unique(pairs)
        at = np.searchsorted(distinct, pairs)
        held = np.bincount(at, np.array(self.copies)[of], len(distinct)).astype(np.int64)
        ends = np.searchsorted(of, np.arange(len(self.digests)), "right")
        steps = np.diff(at, prepend=0)
        begins = ends[:-1][ends[:-1] < len(at)]
        steps[begins] = at[begins]  # each text starts anew: small numbers
        packed = pack_sorted(distinct.astype(np.uint64)), pack(held), pack(ends), pack(steps.astype(np.int32)), pack(times.astype(np.int64))
        row = [int.from_bytes(self.digests[0][:8], "little", signed=True), self.digests, pack(np.concatenate(self.counts, 1)), self.hashes, *packed]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)


#: A block's row. ``pairs`` are its distinct pairs in order and ``held`` the documents with each; ``at`` are the texts' pairs as places there, one text after the other.
BLOCK = "block long, digests array<binary>, counts binary, groups_sha256 array<string>, pairs binary, held binary, ends binary, at binary, times binary"
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BLOCK = pa.schema([("block", pa.int64()), ("digests", pa.list_(pa.binary())), ("counts", pa.binary()), ("groups_sha256", pa.list_(pa.string())), *((c, pa.binary()) for c in ("pairs", "held", "ends", "at", "times"))])


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text, copies``: each text that isn't null or empty once."""
    return docs.filter(F.octet_length(F.col(f"`{text}`").cast("string")) > 0).groupBy(F.col(f"`{text}`").cast("string").alias("text")).agg(F.count("*").alias("copies"))


def _vocabulary(docs: DataFrame, byte_bpe: str, piece_bpe: str):
    def content(path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    return docs.sparkSession.sparkContext.broadcast((content(byte_bpe), content(piece_bpe)))


def blocks_of(docs: DataFrame, text: str, vocabulary, block_bytes: int) -> DataFrame:
    def aligned(batches):
        t, block = tokenizers(*vocabulary.value), Block()
        for texts, copies, size in _slices(batches, min(SLICE_BYTES, block_bytes)):
            block.add(t, texts, copies, size)
            if block.bytes >= block_bytes:
                yield block.row()
                block = Block()
        if block.digests:
            yield block.row()

    return distinct_texts(docs, text).mapInArrow(aligned, BLOCK)


def sent_pairs(blocks: DataFrame) -> DataFrame:
    """``block, pair, held``: each block's distinct pairs and how many documents of it hold them."""

    def listed(batches):
        for b in batches:
            for block, pairs, held in zip(*(b.column(c).to_pylist() for c in range(3))):
                pairs, held = unpack_sorted(pairs).astype(np.int64), unpack(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(held)], names=["block", "pair", "held"])

    return blocks.select("block", "pairs", "held").mapInArrow(listed, "block long, pair long, held long")


def counted(sent: DataFrame) -> DataFrame:
    """``pair, docs, best``: in how many documents each pair is linked, and whether no other pair of its A id has more."""
    docs = sent.groupBy("pair").agg(F.sum("held").alias("docs"))
    most = docs.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("docs").alias("most"))
    return docs.withColumn("a", F.shiftright("pair", 16)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``a, b, docs, best``: the lexicon of the two vocabularies, by how many documents link the ids."""
    blocks = saved(blocks_of(docs, text, _vocabulary(docs, byte_bpe, piece_bpe), block_bytes))
    return counted(sent_pairs(blocks)).select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "docs", "best")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """``doc_id, groups``: the alignment itself, written ``a1,a2|b1;a3|b2,b3``; empty without tokens. Each distinct text is aligned once."""
    vocabulary = _vocabulary(docs, byte_bpe, piece_bpe)

    def aligned(batches):
        t = tokenizers(*vocabulary.value)
        for texts, _, _ in _slices(batches):
            yield pa.RecordBatch.from_pydict({"digest": [hashlib.sha256(x.encode()).digest() for x in texts], "groups": [w.decode() for w in Aligned(t, texts).written(t)]})

    return _joined(docs, distinct_texts(docs, text).mapInArrow(aligned, "digest binary, groups string"), doc_id, text, ["groups"])


def _joined(docs: DataFrame, of_text: DataFrame, doc_id: str, text: str, columns: list[str]) -> DataFrame:
    (out,) = fresh(of_text, "doc_id")
    ids = docs.select(F.col(f"`{doc_id}`").try_cast("long").alias(out), F.unhex(F.sha2(F.col(f"`{text}`").cast("string").cast("binary"), 256)).alias("digest"))
    empty = {"string": F.lit(""), "bigint": F.lit(0).cast("long")}
    return ids.join(of_text, "digest", "left").select(out, *(F.coalesce(c, empty[dict(of_text.dtypes)[c]]).alias(c) for c in columns))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document its tokens, groups and links, how many links are the best of their A id, the sum of the links' counts, and the digest of its groups."""
    blocks = saved(blocks_of(docs, text, _vocabulary(docs, byte_bpe, piece_bpe), block_bytes))
    sent = sent_pairs(blocks)
    told = sent.select("block", "pair").join(counted(sent), "pair").select(F.col("block").alias("of"), "pair", "docs", "best")

    def measure(block, answers):
        if not block.num_rows:
            return pa.table([[]] * len(names), names=names).cast(schema)
        row = {c: block[c][0].as_py() for c in block.column_names}
        order = np.argsort(answers["pair"].to_numpy())
        docs_of, best = answers["docs"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order]
        ends, steps, times = unpack(row["ends"]), unpack(row["at"]).astype(np.int64), unpack(row["times"])
        sizes = np.diff(ends, prepend=0)
        run = np.concatenate([[0], np.cumsum(steps)])
        at = run[1:] - np.repeat(run[ends - sizes], sizes)
        sums = []
        for x in (times * best[at], times * docs_of[at]):
            total = np.concatenate([[0], np.cumsum(x)])  # whole numbers, whatever their size
            sums.append(total[ends] - total[ends - sizes])
        counts = unpack(row["counts"]).reshape(4, -1)
        return pa.table([row["digests"], *counts, *sums, row["groups_sha256"]], names=names).cast(schema)

    names = ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = pa.schema([("digest", pa.binary()), *((c, pa.int64()) for c in names[1:-1]), ("groups_sha256", pa.string())])
    of_text = blocks.drop("pairs", "held").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(measure, MEASURES)
    return _joined(docs, of_text, doc_id, text, names[1:])
