"""Words as 64-bit hashes, and keys that blocks of documents look up in the whole corpus.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, A-Z lower-cased. The
words of many texts are hashed at once, by tabulation: each byte picks a random number by its
value and its place in the word, and the word's hash is their sum, finalised.

Looking up corpus counts. A block is a bounded share of the documents, by a hash of the row's
id and text, so ids that are null or shared don't meet in one block; rows alike in both are
counted once beforehand (``collapsed``). A block sends each of its distinct keys once, sorted,
packed by ranges of the key ("buckets"), so a key of a third of all rows arrives at most once
per block. Only ranges with a key are sent: messages never outnumber the keys, whatever the
number of blocks and buckets. A bucket adds up what all blocks sent and answers each block with
one value per key, in the order the block sent them; what it knows of all its keys together
goes in one row of its own. So a block holds what its own texts can touch and nothing is
broadcast, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Odd multipliers and shifts of a 64-bit finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_WORDS = 5
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 20 << 20
#: Bytes that the hasher takes at once, and places in a word with numbers of their own.
SLICE_BYTES, PLACES = 1 << 18, 64


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are one of ``[\\x20\\x09-\\x0D]``."""
    return (data == 32) | (data - np.uint8(9) < 5)


def _byte_numbers(seed: int = 23) -> np.ndarray:
    """A random number for each place and byte; none for white space, one for both cases of A-Z."""
    t = np.random.default_rng(seed).integers(1, 1 << 63, (PLACES, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[:, 65:91] = t[:, 97:123]
    t[:, is_space(np.arange(256, dtype=np.uint8))] = 0
    return t.reshape(-1)


_NUMBERS = _byte_numbers()


def _slice_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the bytes ``data`` and their places; a word ends at white space and where a text begins."""
    space = is_space(data)
    first = ~space
    first[1:] &= space[:-1]
    at = begins[begins < len(data)]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    data = data[starts[0] :]
    lengths = np.diff(starts, append=starts[0] + len(data))
    place = np.repeat(starts[0] - starts, lengths)
    place += np.arange(len(data))
    far = np.flatnonzero(place >= PLACES) if lengths.max() > PLACES else None
    turn = None if far is None else (mix((place[far] // PLACES).astype(np.uint64)) << np.uint64(1)) | np.uint64(1)
    place &= PLACES - 1
    place <<= 8
    place |= data
    numbers = _NUMBERS[place]
    if far is not None:
        numbers[far] *= turn
    sums = np.cumsum(numbers, out=numbers)[starts[1:] - starts[0] - 1]
    return mix(np.diff(np.append(sums, numbers[-1]), prepend=np.uint64(0))), starts


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the (binary) ``texts``, and how many words each text has; a null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    hashes, starts, a = [], [], int(ends[0])
    while a < ends[-1]:
        b = int(min(a + SLICE_BYTES, ends[-1]))
        while b < ends[-1] and not is_space(data[b - 1 : b])[0] and b != ends[np.searchsorted(ends, b)]:
            # Not within a word: on to its end.
            more = np.flatnonzero(is_space(data[b : b + SLICE_BYTES]))
            b = int(min(ends[np.searchsorted(ends, b)], b + more[0] + 1 if len(more) else b + SLICE_BYTES))
        inside = ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a
        h, s = _slice_hashes(data[a:b], inside)
        hashes.append(h), starts.append(s + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends))


def by_text(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    hashes, sizes = word_hashes(texts)
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    for a, b in zip(at, at[1:]):
        yield hashes[a:b]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first + _GOLD) * _GOLD + second)


def shingle_hashes(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per window of ``width`` words; a shorter text with words has one window, all of it."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = (h + words[k : n - width + 1 + k]) * _GOLD
        h ^= h >> np.uint64(29)
    return mix(h + np.uint64(width))


def block_shingles(hashes: np.ndarray, sizes: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of many texts at once: the hashes and the text of each."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(text[: max(0, len(text) - width + 1)] == text[width - 1 :])
    parts, of = [shingle_hashes(hashes, width)[whole]] if len(whole) else [], [text[whole]]
    ends = np.cumsum(sizes)
    for k in np.flatnonzero((sizes > 0) & (sizes < width)).tolist():
        parts.append(shingle_hashes(hashes[ends[k] - sizes[k] : ends[k]], width))
        of.append(np.array([k]))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(of)


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array: byte planes, for the high bytes are alike."""
    a = np.ascontiguousarray(a).reshape(-1)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes) -> np.ndarray:
    dtype = np.dtype(b[:1].decode())
    planes = zstandard.ZstdDecompressor().decompress(b[1:])
    n = len(planes) // dtype.itemsize
    return np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def shares(total: int, each: int) -> int:
    return max(1, -(-total // each))


def collapsed(docs: DataFrame, text: str, n: str = "n") -> DataFrame:
    """``docs`` with rows that are alike in all columns made one within each batch that a task reads, and how many they were: ``n``.

    So rows without id or with one, and with one text, don't fill a block, however many they are.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(n, T.LongType())])
    others = [c for c in docs.columns if c != text]

    def merge(batches):
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in others), (hash(t.as_py()) for t in b.column(text))))
            first: dict = {}
            count = np.zeros(len(keys), np.int64)
            for i, k in enumerate(keys):
                j = first.setdefault(k, i)
                if j != i and b.column(text)[i] != b.column(text)[j]:  # two texts of one hash
                    j = i
                count[j] += 1
            kept = np.flatnonzero(count)
            out = b if len(kept) == len(keys) else b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(count[kept])], names=[*out.schema.names, n])

    return docs.mapInArrow(merge, schema)


def block_of(blocks: int, *row: Column | str) -> Column:
    return F.pmod(F.xxhash64(*row), F.lit(blocks)).cast("int")


REQUEST = "bucket int, block int, keys binary, sent binary"
#: Rows with ``stats`` hold no answer; they belong to no block.
ANSWER = "block int, bucket int, found binary, stats array<long>"
_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("sent", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("stats", pa.list_(pa.int64()))])


def requests(block: int, keys: np.ndarray, sent: np.ndarray, buckets: int) -> pa.Table:
    """``keys`` (sorted) with what the block sends for each (one number, or a row of numbers): one row per bucket that has a key."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63), append=np.uint64(1 << 63)))
    parts = list(zip(cuts.tolist(), cuts[1:].tolist()))
    return pa.table(
        [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([block] * len(parts), pa.int32()), pa.array([pack_sorted(keys[a:b]) for a, b in parts], pa.binary()), pa.array([pack(sent[a:b]) for a, b in parts], pa.binary())],
        schema=_REQUEST,
    )


def answered(rows: DataFrame, combine: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Per bucket ``combine(place, sent)`` gives the values of its distinct keys and its statistics.

    ``place`` is each received key's place among the distinct keys, ``sent`` what was sent with it.
    """

    def bucket(table):
        keys = [unpack_sorted(k.as_py()) for k in table["keys"]]
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = len(place)
        del keys, distinct
        sent = np.concatenate([unpack(s.as_py()) for s in table["sent"]]).reshape(total, -1)
        values, stats = combine(place, sent)
        del sent
        found, at = [], 0
        for n in sizes:
            found.append(pack(values[place[at : at + n]]))
            at += n
        blocks, number = table["block"].to_pylist(), table["bucket"][0].as_py()
        return pa.table([[*blocks, None], [number] * (len(blocks) + 1), [*found, None], [None] * len(blocks) + [stats.tolist()]], schema=_ANSWER)

    return rows.groupBy("bucket").applyInArrow(bucket, ANSWER)


def answers_of(told: DataFrame) -> DataFrame:
    return told.filter("block is not null").drop("stats")


def statistics_of(told: DataFrame, width: int) -> np.ndarray:
    """The buckets' statistics (``width`` numbers each), summed on the executors."""
    sums = told.filter("stats is not null").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(width, np.int64)
    for r in sums.collect():
        out[r["at"]] = r["x"]
    return out


def answers(table: pa.Table) -> np.ndarray:
    """What a block gets back: one value (or row of values, flat) per key that it sent."""
    rows = table.select(["bucket", "found"]).sort_by("bucket")
    return np.concatenate([unpack(f.as_py()) for f in rows["found"]]) if rows.num_rows else np.zeros(0, np.int64)
