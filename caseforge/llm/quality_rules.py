"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything about a text is computed in its own row by DataFrame functions; there is no shuffle
of texts. Each rule says bad (-1), good (1) or nothing (0). The documents are counted by their
pattern of votes (at most 3 to the power of the number of rules, whatever the corpus), and on
those counts EM fits, for good and for bad documents, how often each rule says what. A
document's posterior of being good is then a sum of logarithms, written as a plain expression.

Repeated three-word windows: windows are hashed, hashes sorted with their positions in the
low bits, and neighbours compared by their full hashes, so a text of n words costs n log n.

Cases. A null or empty text has no words: it fails the base rules. Rows that repeat an id are
documents of their own. With no documents nothing is fitted and the rules' starting weights hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, row_number, saved

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
POSITION_BITS = 26
ROUNDS = 100
#: Rules whose bad vote alone marks a fault: each has a kind of bad document. The others (long with few distinct words, lists with repeated
#: lines, upper case) tell of style, so good documents get such votes too and no document is bad for one of them alone.
HARD = ("symbols", "repeats", "word_length")
#: The prior, in documents: a fixed number, which vanishes against a large corpus. Share of good documents; how often they get a bad vote
#: of a hard and of another rule; how often a bad one gets its own, another hard and another rule's.
PRIOR_DOCS, PRIOR_GOOD = 300.0, 0.85
GOOD_HARD, GOOD_SOFT, BAD_OWN, BAD_HARD, BAD_SOFT = 0.001, 0.02, 0.9, 0.03, 0.2
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_shouted", "n_ended_lines")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name: (votes bad, votes good); neither abstains."""
    words = _ratio("word_chars", "n_words")
    return {
        "symbols": (_ratio("n_symbols", "n_words") > 0.3, _ratio("n_symbols", "n_words") < 0.05),
        "repeats": (_ratio("n_repeat_words", "n_words") > 0.4, _ratio("n_repeat_words", "n_words") < 0.15),
        "dup_lines": (_ratio("n_dup_lines", "n_lines") > 0.5, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2)),
        "word_length": ((words < 2.2) | (words > 14), (words > 3) & (words < 10)),
        "shouting": (_ratio("n_shouted", "n_words") > 0.4, _ratio("n_shouted", "n_words") < 0.05),
        "vocabulary": ((F.col("n_words") >= MIN_WORDS) & (_ratio("n_distinct_words", "n_words") < 0.1), (F.col("n_words") < 3000) & (_ratio("n_distinct_words", "n_words") > 0.3)),
        "endings": (F.lit(False), _ratio("n_ended_lines", "n_lines") > 0.5),
    }


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the features of each row's text."""
    t = F.coalesce(F.col(text), F.lit(""))
    mask = (1 << POSITION_BITS) - 1
    plain = t
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    full_lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    d = docs.select(
        *keep,
        F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"),
        full_lines.alias("_l"),
        (F.char_length(t) - F.char_length(plain)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[A-Z]{2,}")).cast("long").alias("n_shouted"),
    )
    d = d.withColumn("_h", F.when(F.size("_w") >= 3, F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))")).otherwise(F.expr("array(cast(null as bigint))")))
    d = d.select(
        *keep, "n_symbols", "n_shouted", "_h",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"[.!?…:;\"'»)]\s*$"))).cast("long").alias("n_ended_lines"),
        F.expr(f"sort_array(transform(_h, (h, i) -> (h & ~{mask}L) | cast(i as bigint)))").alias("_s"),
    )
    # A window is repeated if its neighbour in the sorted order has the same hash.
    same = f"_h[cast(_s[i {{}} 1] & {mask}L as int)] = _h[cast(x & {mask}L as int)]"
    d = d.withColumn(
        "_p",
        F.expr(f"sort_array(transform(filter(_s, (x, i) -> (i > 0 and {same.format('-')}) or (i < size(_s) - 1 and {same.format('+')})), x -> x & {mask}L))"),
    )
    covered = F.aggregate("_p", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return d.withColumn("n_repeat_words", F.when(F.col("n_words") >= 3, covered).otherwise(F.lit(0).cast("long"))).select(*keep, *FEATURES)


def votes() -> dict[str, Column]:
    return {f"vote_{k}": F.when(bad, -1).when(good, 1).otherwise(0) for k, (bad, good) in rules().items()}


class Weights:
    """Good documents and kinds of bad ones by expectation-maximisation over counted patterns of votes.

    ``bad_vote[class][rule]`` is how often the rule, if it votes, says bad of a document of the
    class; class 0 is good, the others are the kinds of bad documents. An abstention says nothing.
    All shares and votes are estimated from the counts and the prior's fixed number of documents.
    With one class of bad documents, EM takes a common lone fault for a habit of good ones.
    """

    def __init__(self, counts: dict[tuple[int, ...], int], names: list[str]):
        self.names, total = names, sum(counts.values())
        plain = [n.removeprefix("vote_") for n in names]
        hard = [n in HARD or n == "endings" for n in plain]
        start = [[GOOD_HARD if h else GOOD_SOFT for h in hard]]
        start += [[BAD_OWN if n == own else BAD_HARD if h else BAD_SOFT for n, h in zip(plain, hard)] for own in HARD]
        share0 = [PRIOR_GOOD] + [(1 - PRIOR_GOOD) / len(HARD)] * len(HARD)
        self.share, self.bad_vote = share0, start
        for _ in range(ROUNDS):
            held = {p: [n * x for x in self.classes(p)] for p, n in counts.items()}
            share, votes_ = [], []
            for k, (s0, row0) in enumerate(zip(share0, start)):
                row = []
                for j, b0 in enumerate(row0):
                    bad = PRIOR_DOCS * s0 * b0 + sum(h[k] for p, h in held.items() if p[j] == -1)
                    all_ = PRIOR_DOCS * s0 + sum(h[k] for p, h in held.items() if p[j])
                    row.append(min(max(bad / all_, 1e-12), 1 - 1e-12))
                votes_.append(row)
                share.append((PRIOR_DOCS * s0 + sum(h[k] for h in held.values())) / (PRIOR_DOCS + total))
            self.share, self.bad_vote = share, votes_

    def classes(self, pattern: tuple[int, ...]) -> list[float]:
        """The posterior of each class."""
        logs = [math.log(s) + sum(math.log(b if v == -1 else 1 - b) for b, v in zip(row, pattern) if v) for s, row in zip(self.share, self.bad_vote)]
        odds = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(odds) for x in odds]

    def posterior(self) -> Column:
        good, (first, *others) = self.bad_vote[0], zip(self.share[1:], self.bad_vote[1:])

        def odds(share: float, row: list[float]) -> Column:
            out = F.lit(math.log(share / self.share[0]))
            for name, b, g in zip(self.names, row, good):
                out = out + F.when(F.col(name) == -1, F.lit(math.log(b / g))).when(F.col(name) == 1, F.lit(math.log((1 - b) / (1 - g)))).otherwise(F.lit(0.0))
            return F.exp(out)

        return 1 / (1 + sum((odds(*kind) for kind in others), odds(*first)))


def judged(docs: DataFrame, text: str, keep: list[str], least: float = 0.5) -> DataFrame:
    """``keep``, the features, the votes, the posterior and the verdict of each row."""
    d = saved(measured(docs, text, keep), let_go=False)
    for name, vote in votes().items():
        d = d.withColumn(name, vote)
    names = list(votes())
    counts = {tuple(r[n] for n in names): r["count"] for r in d.groupBy(*names).count().collect()}
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = d.withColumn("base_failed", base).withColumn("p_good", Weights(counts, names).posterior())
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its measures and verdict."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return judged(d, "text", ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *votes())


def passed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected; all columns as they were."""
    (row,) = fresh(docs, "_quality_row")
    numbered = docs.withColumn(row, row_number(docs))
    rejected = judged(numbered.select(F.col(row).alias("row"), F.col(text).alias("text")), "text", ["row"]).filter("not kept").select(F.col("row").alias(row)).distinct()
    return numbered.join(rejected, row, "left_anti").select(*docs.columns)
