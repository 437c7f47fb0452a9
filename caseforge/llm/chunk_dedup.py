"""Passages that repeat across documents, by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends after white space where the hash's upper bits
are zero (one place in four), not before 16 bytes, and at 1,024 bytes at the latest (at a
character's end). The hash sees the last 16 bytes only, so chunks fall back in step soon after
an insertion. Chunks are deduplicated by digest over the whole corpus (``words``: blocks of
documents send each digest once and get the number of documents with it, the first of them and
the chunk's place there).

A row with chunks that a document before it holds is a later copy of them. Such chunks make a
stretch while they stand in one document in the same order, at the same distance: first
document and place minus place agree. Between two stretches of one document and distance, fewer
than ``min_words`` words of repeated chunks are bridged (another document may hold one of them
still earlier). Of a chunk that no document before has, the row's own copy is the first, so each
text stays in its first document. Stretches of ``min_words`` words or more are reported, the
others stay as they are. The default, 20, finds a common passage of 50 words whose first and
last chunks also hold words around it.

Cases. Null and empty texts have no chunk. A chunk repeated within one document only isn't
shared. Each row is a document of its own, also where ids repeat or are null, but rows alike in
id and text are one. Documents are in order of id, null last, then of a hash of the row. An id
that is no number reads as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh
from .words import BLOCK_BYTES, BUCKET_BYTES, REQUEST, answered, answers, answers_of, block_of, collapsed, requests, shares, text_bytes

NO_ID = (1 << 63) - 1
LEAST, MOST, MIN_WORDS = 16, 1024, 20
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SPANS = "row long, start long, n_chars long, n_words long, n_chunks long, first_doc_id long, removed boolean, passage_sha string, doc_id long, n long"
_SPANS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("n_chars", pa.int64()), ("n_words", pa.int64()), ("n_chunks", pa.int64()), ("first_doc_id", pa.int64()), ("removed", pa.bool_()), ("passage_sha", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64())])


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return []
    h = _GEAR[b]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(_SPACE[b] & (h >> np.uint32(30) == 0)) + 1
    out, last = [], 0
    for m in [*marks.tolist(), len(b)]:
        while m - last > MOST:
            end = last + MOST
            while b[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            last = end
        if m - last >= LEAST:
            out.append(m)
            last = m
    if last < len(b):
        out.append(len(b))
    return out


class _Chunks:
    """The chunks of a block: ``keys`` (distinct, sorted), ``place`` of each chunk's key among them, ``ends`` in each text."""

    def __init__(self, docs: pa.Table):
        docs = docs.sort_by([("id", "ascending"), ("row", "ascending")])
        self.ids, self.rows, self.n = (docs[c].to_pylist() for c in ("id", "row", "n"))
        self.texts = docs["text"]
        self.ends, keys = [], []
        for t in self.texts:
            text = t.as_py() or b""
            ends = cuts(text)
            self.ends.append(ends)
            keys.extend(xxhash.xxh3_64_intdigest(text[a:e].strip()) for a, e in zip([0, *ends], ends))
        self.keys, self.place = np.unique(np.array(keys, np.uint64), return_inverse=True)

    def sent(self) -> np.ndarray:
        """Per key the documents with it, and of the first of them its id, row and the chunk's place in it."""
        sizes = [len(e) for e in self.ends]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code, first = np.unique(self.place * max(1, len(sizes)) + doc, return_index=True)
        key = code // max(1, len(sizes))
        n = np.bincount(key, minlength=len(self.keys))
        first = first[np.flatnonzero(np.diff(key, prepend=-1))]
        return np.stack([n, np.array(self.ids, np.int64)[doc[first]], np.array(self.rows, np.int64)[doc[first]], inside[first]], 1)


def _shared(place, sent):
    """Documents that hold the chunk, and the first one's id, row and place; nothing of a chunk in one document only."""
    n, ids, rows, inside = sent.T
    total = np.bincount(place, n).astype(np.int64)
    order = np.lexsort((rows, ids, place))
    first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
    out = np.stack([total, ids[first], rows[first], inside[first]], 1)
    out[total < 2] = 0
    return out, np.zeros(1, np.int64)


def stretches(labels: list, words: list[int], min_words: int) -> list[tuple[int, int, object]]:
    """``(from, to, label)`` of a row's later copies.

    ``labels`` has for each chunk the document before with it and its distance there, None if no document before has
    it, and ``words`` how many words the chunk has.
    """
    runs: list[list] = []
    for k, label in enumerate(labels):
        if runs and runs[-1][2] == label:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1, label])
    out: list[list] = []
    for a, b, label in runs:
        if label is None:
            continue
        back, between = None, 0
        # The last stretch of this document and distance, if only few repeated words are between.
        for j in range(len(out) - 1, -1, -1):
            end = out[j + 1][0] if j + 1 < len(out) else a
            if out[j][1] != end or between >= min_words:
                break
            if out[j][2] == label:
                back = j
                break
            between += sum(words[out[j][0] : out[j][1]])
        if back is not None:
            out[back][1] = b
            del out[back + 1 :]
        else:
            out.append([a, b, label])
    return [(a, b, label) for a, b, label in out if sum(words[a:b]) >= min_words]


def _report(ends: list[int], text: bytes, own: int, found: np.ndarray, min_words: int) -> list[tuple[int, int, int, bool]]:
    """The passages of a row, as chunks, the first document's id and whether this one is a later copy."""
    at = [0, *ends]
    words = [len(text[a:b].split()) for a, b in zip(at, at[1:])]
    n, ids, rows, inside = found.T
    copy = (n > 1) & (rows != own)
    distance = (inside - np.arange(len(n))).tolist()
    label = [(r, d, i) if c else None for r, d, i, c in zip(rows.tolist(), distance, ids.tolist(), copy.tolist())]
    out = [(a, b, x[2], True) for a, b, x in stretches(label, words, min_words)]
    first = [0 if m > 1 and not c else None for m, c in zip(n.tolist(), copy.tolist())]
    out += [(a, b, NO_ID, False) for a, b, _ in stretches(first, words, min_words)]
    return sorted(out)


def _passages(docs: DataFrame, text: str, id_: str, row: str, min_words: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    size = text_bytes(docs, text)
    blocks, buckets = shares(size, block_bytes), shares(size, bucket_bytes)
    d = docs.select(F.coalesce(F.col(id_), F.lit(NO_ID)).alias("id"), F.col(text).cast("binary").alias("text"), F.col(row).alias("row"))
    by_block = collapsed(d, "text").withColumn("block", block_of(blocks, "row")).groupBy("block")

    def ask(key, docs_):
        c = _Chunks(docs_)
        return requests(key[0].as_py(), c.keys, c.sent(), buckets)

    def report(docs_, told):
        c, out, at = _Chunks(docs_), [], 0
        found = answers(told).reshape(-1, 4)[c.place]
        for i, row_, n, t, ends in zip(c.ids, c.rows, c.n, c.texts, c.ends):
            own = found[at : at + len(ends)]
            at += len(ends)
            if not (own[:, 0] > 1).any():
                continue
            text_ = t.as_py()
            for a, b, f, later in _report(ends, text_, row_, own, min_words):
                start, end = ends[a - 1] if a else 0, ends[b - 1]
                passage = text_[start:end]
                first = f if later else i
                out.append((row_, len(text_[:start].decode()), len(passage.decode()), len(passage.split()), b - a, None if first == NO_ID else first, later, xxhash.xxh3_128_hexdigest(passage.strip()), None if i == NO_ID else i, n))
        return pa.table([list(x) for x in zip(*out)] if out else [[]] * len(_SPANS), schema=_SPANS)

    told = answers_of(answered(by_block.applyInArrow(ask, REQUEST), _shared))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(report, SPANS)


def _rows(docs: DataFrame, doc_id: str, text: str, id_: str, row: str) -> DataFrame:
    """``docs`` with its ids as numbers and a hash of id and text."""
    return docs.withColumn(id_, F.col(doc_id).try_cast("long")).withColumn(row, F.xxhash64(id_, text))


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per repeated passage of a row: place (code points), size, the first document with it and whether this one is a later copy."""
    d = _rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "_id", "row")
    found = _passages(d, "text", "_id", "row", min_words, block_bytes, bucket_bytes)
    each = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", "start", "n_chars", "n_words", "n_chunks", "first_doc_id", "removed", "passage_sha")


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without their later copies of repeated passages; all columns as they were. A row loses its own places, whatever rows share its id."""
    id_, row, gone = fresh(docs, "_cut_id", "_cut_row", "_cut_places")
    d = _rows(docs, doc_id, text, id_, row)
    later = _passages(d, text, id_, row, min_words, block_bytes, bucket_bytes).filter("removed")
    later = later.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_set(F.struct("start", "n_chars"))).alias(gone))
    body = F.aggregate(
        F.coalesce(F.col(gone), F.array()),
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda acc, p: F.struct(F.concat(acc["kept"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.greatest(p["start"] - acc["at"], F.lit(0)).cast("int"))).alias("kept"), F.greatest(acc["at"], p["start"] + p["n_chars"]).alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))),
    )
    joined = d.join(later, row, "left")
    return joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(body)).select(*docs.columns)
