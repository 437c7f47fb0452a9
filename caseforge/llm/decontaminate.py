"""Benchmark decontamination by size-partitioned MinHash containment search.

Each benchmark item's five-word shingles are sketched by their 32 least hashes (all, if it
has fewer); items fall in partitions by the binary logarithm of their size. A document is
looked up against a partition only if it is large enough for the least item in it. It is a
candidate for an item if it holds 0.4 or more of the item's sketch: a document that holds 0.8
of the item misses that about once in ten million pairs, and never where the sketch is the
whole item. A candidate is verified by exact containment: shingles of the item that the
document has, over all of the item's, ``threshold`` or more.

Long documents aren't cut: their shingles are looked up as they stand, so an item of forty
words is found in a text of a million. The benchmark is taken in passes of bounded bytes; one
pass's sketches and shingles are all that is broadcast, and they go before the next pass. No row
of the documents is shuffled.

Cases. An item or document under five words has no shingle: it matches nothing. Null texts are
empty ones. Rows that repeat an id are rows of their own, in either table.
An id that is no number is returned as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, row_number, saved
from .words import SHINGLE_WORDS, by_text, shares, shingle_hashes

THRESHOLD = 0.8
SKETCH, SKETCH_SHARE = 32, 0.4
#: Bytes of benchmark text that one pass collects and broadcasts.
PASS_BYTES = 16 << 20
FOUND = "doc_id long, item_id long, containment double, shared long, item_shingles long, doc_words long"


def _shingles(words: np.ndarray) -> np.ndarray:
    return shingle_hashes(words) if len(words) >= SHINGLE_WORDS else np.zeros(0, np.uint64)


class Sketches:
    """One pass of the benchmark, by partition: sorted sketch keys and the items that have them."""

    def __init__(self, ids: list, texts: list[bytes | None]):
        found = [(i, s) for i, w in zip(ids, by_text(pa.array(texts, pa.binary()))) if len(s := np.unique(_shingles(w)))]
        self.ids, self.shingles = [i for i, _ in found], [s for _, s in found]
        self.sketch_sizes = np.array([min(SKETCH, len(s)) for s in self.shingles])
        partition = np.array([len(s).bit_length() for s in self.shingles])
        self.partitions = []
        for p in np.unique(partition):
            own = np.flatnonzero(partition == p)
            item = np.repeat(own, self.sketch_sizes[own])
            keys = np.concatenate([self.shingles[i][: SKETCH] for i in own])
            order = np.argsort(keys, kind="stable")
            distinct, start = np.unique(keys[order], return_index=True)
            self.partitions.append((min(len(self.shingles[i]) for i in own), distinct, np.append(start, len(keys)), item[order]))

    def candidates(self, shingles: np.ndarray, threshold: float) -> list[int]:
        out = []
        for least, keys, start, items in self.partitions:
            if len(shingles) < threshold * least:
                continue
            at = np.searchsorted(keys, shingles)
            at[at == len(keys)] = 0
            hits = np.unique(at[keys[at] == shingles])
            if len(hits):
                which, n = np.unique(np.concatenate([items[start[k] : start[k + 1]] for k in hits.tolist()]), return_counts=True)
                out.extend(which[n >= SKETCH_SHARE * self.sketch_sizes[which]].tolist())
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs of a document and a test item that it holds to ``threshold`` or more."""
    spark = docs.sparkSession
    b = benchmark.select(F.col(item_id).try_cast("long").alias("item"), F.col(item_text).cast("binary").alias("text"))
    passes = shares(b.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0, pass_bytes)
    d = docs.select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64()), ("shared", pa.int64()), ("item_shingles", pa.int64()), ("doc_words", pa.int64())])
    found = None
    for k in range(passes):
        items = b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        sketches = spark.sparkContext.broadcast(Sketches([r["item"] for r in items], [bytes(r["text"] or b"") for r in items]))

        def search(batches, sketches=sketches):
            s = sketches.value
            for batch in batches:
                out = []
                for i, words in zip(batch.column(0).to_pylist(), by_text(batch.column(1))):
                    own = _shingles(words)
                    for item in s.candidates(own, threshold):
                        whole = s.shingles[item]
                        shared = int(np.isin(whole, own).sum())
                        if shared >= threshold * len(whole) - 1e-9:
                            out.append((i, s.ids[item], shared / len(whole), shared, len(whole), len(words)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) if out else [[]] * len(schema), schema)], schema=schema)

        # The pairs are saved, so that the next pass needn't hold this one's sketches.
        part = saved(d.mapInArrow(search, FOUND), let_go=False)
        sketches.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns as they were. Rows that share an id, or have none, are judged each by its own text: ``doc_id`` decides nothing."""
    (row,) = fresh(docs, "_held_row")
    numbered = docs.withColumn(row, row_number(docs))
    held = contaminated(numbered, benchmark, row, text, **options).select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(held, row, "left_anti").select(*docs.columns)
