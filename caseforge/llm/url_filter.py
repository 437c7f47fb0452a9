"""URL verdicts: listed rules first, else gradient-boosted trees on lexical features.

Features: length, host length and labels, path depth, digit ratio, entropy of the characters,
hyphens in the host, parameters, and of the host's last label (the suffix) its frequency and
share of blocked URLs among the labelled ones. The trees are trained by MLlib on labelled URLs:
at most ``MAX_TRAIN``, those with the least hashes, so the same URLs whatever the partitioning.
Pass ``labelled(url, label)`` where there are labels: that is the main way. Where none are given,
URLs whose host holds a word of ``SEED_WORDS`` are labelled block and the others allow, so the
verdict on unlisted URLs then follows that list. If the labels are all alike, that label is the verdict.

Cases. A null URL or one without ``://`` has an empty host and path, fits no rule and is judged
by the trees like any other. Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

MAX_TRAIN = 20_000
#: Words in host names that stand for unwanted sites.
SEED_WORDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "crack", "free", "pills", "poker", "porn", "sex", "spam", "track", "warez", "xxx")
#: (verdict, rule), host and path in one.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
NUMBERS = ("url_length", "host_length", "host_labels", "host_hyphens", "depth", "digit_ratio", "entropy", "n_params", "suffix_log_count", "suffix_block_share")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule = verdict = None
    for said, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        at, _, rest = r.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def lexical(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host, path, suffix and the features of the URL itself."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (p := (F.char_length(u) - F.char_length(F.replace(u, c, F.lit("")))) / n) * F.log2(p))
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    hyphens = F.char_length("host") - F.char_length(F.replace("host", F.lit("-")))
    return df.select(
        "*",
        F.substring_index("host", ".", -1).alias("suffix"),
        F.char_length(u).cast("double").alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        hyphens.cast("double").alias("host_hyphens"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        (F.regexp_count(u, F.lit("[0-9]")) / n).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double").alias("n_params"),
    )


def seed_label(host: Column, words=SEED_WORDS) -> Column:
    return F.coalesce(host.rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)"), F.lit(False)).cast("double")


class UrlModel:
    """Trees and suffix statistics fitted to ``labelled(url, label)``; label 1 blocks, 0 allows."""

    def __init__(self, labelled: DataFrame, max_train: int = MAX_TRAIN, rounds: int = 10, depth: int = 3):
        few = labelled.filter(F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("label")).groupBy("url").agg(F.max("label").alias("label"))
        few = saved(lexical(few.orderBy(F.xxhash64("url"), "url").limit(max_train), "url").coalesce(1), let_go=False)
        self.suffixes = saved(few.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_log_count"), ((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_block_share")), let_go=False)
        self.assembler = VectorAssembler(inputCols=list(NUMBERS), outputCol="features")
        seen = [r["label"] for r in few.select("label").distinct().collect()]
        self.only = seen[0] if len(seen) == 1 else 0.0 if not seen else None
        if self.only is None:
            train = self.assembler.transform(self.with_suffix(few)).select("features", "label")
            self.trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=5, maxBins=32).fit(train)

    def with_suffix(self, df: DataFrame) -> DataFrame:
        """Suffixes come from at most ``max_train`` URLs, so their table is bounded."""
        return df.join(F.broadcast(self.suffixes), "suffix", "left").fillna({"suffix_log_count": 0.0, "suffix_block_share": 0.5})

    def block_probability(self, df: DataFrame) -> DataFrame:
        if self.only is not None:
            return df.withColumn("p_block", F.lit(self.only))
        out = self.trees.setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_said").transform(self.assembler.transform(self.with_suffix(df)))
        return out.withColumn("p_block", vector_to_array("_p")[1])


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", labelled: DataFrame | None = None, rules=RULES, least: float = 0.5) -> DataFrame:
    """One row per page: host, path, the longest fitting rule and the verdict."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    if labelled is None:
        labelled = p.select("url", seed_label(host_of(F.col("url"))).alias("label")).filter("url is not null")
    model = UrlModel(labelled)
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    return model.block_probability(lexical(p, "url")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("p_block") >= least, "block").otherwise("allow")).alias("verdict"), "p_block"
    )
