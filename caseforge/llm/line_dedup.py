"""Lines that many documents share, dropped everywhere; DataFrame operations only.

Each text is split at line feeds. A line's key is the line stripped of ``[\\x20\\x09-\\x0D]``
at both ends with A-Z lower-cased; 96 bits of hash stand for it. Distinct keys of a document
are counted per key (summed in each task before the shuffle), keys found in ``min_docs``
documents or more are joined back to the documents' distinct keys (Spark splits a hot key's
partition), and each document filters its own lines in place by the keys it lost, so texts
aren't taken apart and line order needs no sort.

Cases. A null or empty text is one empty line. Keys shorter than ``min_chars`` code points
always stay. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, row_number, saved

MIN_DOCS, MIN_CHARS = 10, 1
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g"))


def marked(docs: DataFrame, text: str, row: str, lost: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``row`` (a number of the row) and ``lost``: the hashes of the row's keys that too many documents share, null if none.

    A row's number is a hash of its plain columns. Rows that share it at worst know more common
    keys than they have lines for, which changes nothing.
    """
    d = docs.withColumn(row, row_number(docs))
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars), _hash))
    spread = d.select(F.col(row).alias("row"), F.explode(keys).alias("k")).select("row", "k.h", "k.g")
    # Saved, so that the join reads both sides straight from a shuffle: only then can Spark split a hot key's rows.
    common = saved(spread.groupBy("h", "g").count().filter(F.col("count") >= min_docs).select("h", "g"), let_go=False)
    gone = spread.join(common, ["h", "g"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("h", "g")).alias(lost)).withColumnRenamed("row", row)
    return d.join(gone, row, "left")


def _stays(lost: Column, min_chars: int):
    def test(line: Column) -> Column:
        key = line_key(line)
        return lost.isNull() | (F.char_length(key) < min_chars) | ~F.array_contains(lost, _hash(key))

    return test


def dropped(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the common lines gone from ``text``; all other columns as they were."""
    row, lost = fresh(docs, "_line_row", "_line_lost")
    kept = F.array_join(F.filter(lines(F.col(text)), _stays(F.col(lost), min_chars)), "\n")
    return marked(docs, text, row, lost, min_docs, min_chars).withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: lines before, lines dropped and the digest of what stays."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    m = marked(d, "text", "row", "lost", min_docs, min_chars)
    all_lines = lines(F.col("text"))
    kept = F.when(F.col("lost").isNull(), all_lines).otherwise(F.filter(all_lines, _stays(F.col("lost"), min_chars)))
    return m.select("doc_id", F.size(all_lines).cast("long").alias("n_lines"), kept.alias("kept")).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256")
    )
