"""Queries over features, fusion, thresholds, metrics, the evaluator, attribution and losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import attribution as AT
from ..operators import evaluator as EV
from ..operators import features as fe
from ..operators import kdm as KD
from ..operators import losses as L
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import order as O
from ..operators import pair_sums as PS
from ..operators import resampling as R
from ..operators import shapley as SH
from ..operators import trees
from ..operators import vectors as V
from ..operators.refine import Refiner
from ..operators.refine import refined as refined_by
from .registry import query, table
from .vector_queries import UNIT, P, _base, _unit

SPLIT = "o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS priority, (o_orderkey % 2)::INT AS split, (o_orderkey % 5 = 0)::INT AS role FROM orders)"


def _orders(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(k.alias("k"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 6 != 0, F.col("o_orderpriority")).alias("priority"), (k % 2).cast("int").alias("split"), (k % 5 == 0).cast("int").alias("role"))


@query("fea01_missing_indicator", f"WITH {SPLIT} SELECT k, coalesce(price, 0.0) AS price, coalesce(priority, '0') AS priority, (price IS NULL)::INT AS price__is_missing, (priority IS NULL)::INT AS priority__is_missing FROM o")
def missing_indicator(spark, sf_dir):
    return fe.with_indicators(_orders(spark, sf_dir), ["price"], ["priority"]).drop("split", "role")


@query("fea02_one_hot", f"WITH {SPLIT}, f AS (SELECT k, split, role, coalesce(priority, '0') AS priority FROM o WHERE NOT (split = 1 AND role = 0 AND priority = '5-LOW')), c AS (SELECT DISTINCT split, priority AS category FROM f WHERE role = 0) SELECT f.split, k, category, (priority = category)::INT AS value FROM f JOIN c ON f.split = c.split")
def one_hot(spark, sf_dir):
    f = fe.with_indicators(_orders(spark, sf_dir), [], ["priority"]).filter("not (split = 1 and role = 0 and priority = '5-LOW')")
    return fe.one_hot(f, "split", "role", "k", "priority")


@query("fea03_one_hot_fixed", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS c_mktsegment_BUILDING, (c_mktsegment = 'ABSENT')::INT AS c_mktsegment_ABSENT FROM customer")
def one_hot_fixed(spark, sf_dir):
    return fe.one_hot_fixed(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "ABSENT"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_ABSENT")


@query("fea04_minmax_per_split", f"WITH {SPLIT}, f AS (SELECT split, min(price) AS lo, max(price) AS hi FROM o WHERE role = 0 GROUP BY split) SELECT k, o.split, round((price - lo) / (hi - lo), 6) AS price, 0.0::DOUBLE AS one FROM o JOIN f ON o.split = f.split")
def minmax_per_split(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("one", F.lit(7.0))
    return fe.minmax(o, "split", "role", ["price", "one"]).select("k", "split", F.round("price", 6).alias("price"), "one")


@query("fea05_standard_scale", "WITH l AS (SELECT vec_id % 2 AS split, (vec_id % 5 = 0)::INT AS role, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), f AS (SELECT split, dim, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE role = 0 GROUP BY ALL) SELECT l.split, vec_id, l.dim, round((x - m) / s, 5) AS z FROM l JOIN f ON l.split = f.split AND l.dim = f.dim")
def standard_scale(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("split"), (F.col("vec_id") % 5 == 0).cast("int").alias("role"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return fe.standard_scaled(e, "split", "role", "vec_id", "v").withColumn("z", F.round("z", 5))


TOKENS = "w AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\\d+', '', 'g'), '[^a-z\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term)"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_tokens_serving("text").alias("words"))


@query("fea07_tfidf", f"WITH {TOKENS}, x AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term), n) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def tfidf(spark, sf_dir):
    return fe.tfidf(_tokens(spark, sf_dir), "doc_id", "words").withColumn("weight", F.round("weight", 6))


@query("fea07_tfidf_top", f"WITH {TOKENS}, top AS (SELECT * FROM d ORDER BY total DESC, term LIMIT 500), x AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM tf JOIN top USING (term), n) SELECT doc_id, count(*) AS terms, round(max(w / l), 6) AS heaviest FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM x) GROUP BY doc_id")
def tfidf_top(spark, sf_dir):
    t = fe.tfidf(_tokens(spark, sf_dir), "doc_id", "words", 500)
    return t.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"))


@query("fea08_truncated_svd")
def truncated_svd(spark, sf_dir):
    return fe.svd(fe.tfidf(_tokens(spark, sf_dir), "doc_id", "words", 100), "doc_id", 5)


@query("fea09_association", "WITH c AS (SELECT c_custkey AS k, c_acctbal AS bal, c_nationkey::DOUBLE AS nation, (c_mktsegment = s)::INT AS seg, s FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer)), r AS (SELECT k, s, rank() OVER (PARTITION BY s ORDER BY bal) + (count(*) OVER (PARTITION BY s, bal) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY s ORDER BY nation) + (count(*) OVER (PARTITION BY s, nation) - 1) / 2.0 AS rn, rank() OVER (PARTITION BY s ORDER BY seg) + (count(*) OVER (PARTITION BY s, seg) - 1) / 2.0 AS rs FROM c), p AS (SELECT s, abs(corr(rb, rn)) AS bn, abs(corr(rb, rs)) AS bs, abs(corr(rn, rs)) AS ns FROM r GROUP BY s) SELECT 'bal' AS a, 'nation' AS b, round(max(bn), 6) AS rho FROM p UNION ALL SELECT 'bal', 'seg', round(max(bs), 6) FROM p UNION ALL SELECT 'nation', 'seg', round(max(ns), 6) FROM p")
def association(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("seg"))
    return fe.associations(c, "k", ["bal", "nation"], ["seg"]).withColumn("rho", F.round("rho", 6))


# Three modalities' probabilities, an ordinal class and a truth, from the labels.
F3 = "f AS (SELECT doc_id, quality::INT AS y, (doc_id * 37 % 101) / 100.0::DOUBLE AS p_t, (doc_id * 53 % 97) / 96.0::DOUBLE AS p_m, (doc_id * 71 % 89) / 88.0::DOUBLE AS p_x, (doc_id * 13 % 3)::INT AS cls, (doc_id * 29 % 3)::INT AS said, (doc_id % 2)::INT AS split FROM labels)"


def _fusion(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"), (d * 37 % 101 / F.lit(100.0)).alias("p_t"), (d * 53 % 97 / F.lit(96.0)).alias("p_m"), (d * 71 % 89 / F.lit(88.0)).alias("p_x"), (d * 13 % 3).cast("int").alias("cls"), (d * 29 % 3).cast("int").alias("said"), (d % 2).cast("int").alias("split"))


@query("mod06_fusion_combos", f"WITH {F3} SELECT doc_id, unnest(['T', 'M', 'X', 'T+M', 'T+X', 'M+X', 'T+M+X']) AS combination, round(unnest([p_t, p_m, p_x, (p_t + p_m) / 2, (p_t + p_x) / 2, (p_m + p_x) / 2, (p_t + p_m + p_x) / 3]), 6) AS p FROM f")
def fusion_combos(spark, sf_dir):
    return MO.fused_combinations(_fusion(spark, sf_dir), ["doc_id"]).withColumn("p", F.round("p", 6))


@query("mod07_weight_grid", f"WITH {F3}, w AS (SELECT a, b, 20 - a - b AS c FROM range(21) x(a), range(21) y(b) WHERE a + b <= 20) SELECT printf('w_%02d_%02d_%02d', a, b, c) AS config, round(avg((a * p_t + b * p_m + c * p_x) / 20), 6) AS mean, round(avg(((a * p_t + b * p_m + c * p_x) / 20 - y) ** 2), 6) AS brier FROM f, w GROUP BY ALL")
def weight_grid(spark, sf_dir):
    p = MO.fused_weighted(_fusion(spark, sf_dir), ["doc_id", "y"], MO.weight_grid(spark))
    return p.groupBy("config").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"))


MEAN3 = "(p_t + p_m + p_x) / 3"
SD3 = f"sqrt(((p_t - {MEAN3}) ** 2 + (p_m - {MEAN3}) ** 2 + (p_x - {MEAN3}) ** 2) / 3)"


@query("mod08_ici", f"WITH {F3} SELECT doc_id, round(2 * abs({MEAN3} - 0.5) * (1 - 2 * {SD3}), 6) AS ici FROM f")
def ici(spark, sf_dir):
    return _fusion(spark, sf_dir).select("doc_id", F.round(MO.ici("p_t", "p_m", "p_x"), 6).alias("ici"))


@query("mod09_risk_grid", f"WITH {F3}, g AS (SELECT c, l FROM (VALUES (0.35::DOUBLE), (0.5), (0.65), (0.8), (0.9)) a(c), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) b(l)) SELECT doc_id, c, l, round(least(1, greatest(0, (1 - l) * least({MEAN3} * c, (1 - {MEAN3}) * (1 - c)) / (c * (1 - c)) + l * 2 * {SD3})), 6) AS risk FROM f, g")
def risk_grid(spark, sf_dir):
    g = spark.createDataFrame([(c, x) for c in (0.35, 0.5, 0.65, 0.8, 0.9) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "c double, l double")
    r = MO.decision_risk(F.col("c"), F.col("l"), "p_t", "p_m", "p_x")
    return _fusion(spark, sf_dir).crossJoin(F.broadcast(g)).select("doc_id", "c", "l", F.round(r, 6).alias("risk"))


@query("mod10_serving_risk", f"WITH {F3} SELECT doc_id, round(2 * abs(0.65::DOUBLE * p_t - 0.5), 4) AS risk FROM f")
def serving_risk(spark, sf_dir):
    return _fusion(spark, sf_dir).select("doc_id", MO.serving_risk("p_t").alias("risk"))


CAND = f"{F3}, v AS (SELECT split, p_t AS x, sum((cls = 0)::INT) AS c0, sum((cls = 1)::INT) AS c1, sum((cls = 2)::INT) AS c2 FROM f GROUP BY ALL), u AS (SELECT split, x, sum(c0) OVER w AS n0, sum(c1) OVER w AS n1, sum(c2) OVER w AS n2, lead(x) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY split ORDER BY x)), t AS (SELECT split, max(n0) AS t0, max(n1) AS t1, max(n2) AS t2 FROM u GROUP BY split), c AS (SELECT split, (x + nxt) / 2 AS tau, n0, n1, n2 FROM u WHERE nxt IS NOT NULL UNION ALL SELECT split, 0.0, 0, 0, 0 FROM t UNION ALL SELECT split, 1.0, t0, t1, t2 FROM t)"


@query("mod11_first_split", f"WITH {CAND}, g AS (SELECT c.split, tau, n0 + n1 + n2 AS l, t0 + t1 + t2 - n0 - n1 - n2 AS r, n0, n1, n2, t0, t1, t2 FROM c JOIN t ON c.split = t.split), i AS (SELECT split, tau, round((l - (n0 * n0 + n1 * n1 + n2 * n2) / l::DOUBLE + r - ((t0 - n0) ** 2 + (t1 - n1) ** 2 + (t2 - n2) ** 2) / r) / (l + r), 12) AS impurity FROM g WHERE l >= 5 AND r >= 5) SELECT split, round(tau, 6) AS tau, round(impurity, 6) AS impurity FROM i QUALIFY row_number() OVER (PARTITION BY split ORDER BY impurity, tau) = 1")
def first_split(spark, sf_dir):
    s = MO.tree_split(_fusion(spark, sf_dir), ["split"], "p_t", "cls")
    return s.select("split", F.round("tau", 6).alias("tau"), F.round("impurity", 6).alias("impurity"))


@query("mod11_tree_thresholds")
def tree_thresholds(spark, sf_dir):
    f = _fusion(spark, sf_dir)
    plain = MO.tree_thresholds(f, ["split"], "p_t", "cls").withColumn("balanced", F.lit(False))
    return plain.union(MO.tree_thresholds(f, ["split"], "p_t", "cls", balanced=True).withColumn("balanced", F.lit(True)))


# First splits of trees on three features; the weights of a class, or of a grade, make all count alike.
def _first(impurity: str, gain: str) -> str:
    return f"WITH {F3}, cw AS (SELECT split, cls, count(*) AS c, sum(count(*)) OVER (PARTITION BY split) / (3.0::DOUBLE * count(*)) AS w FROM f GROUP BY split, cls), l AS (SELECT split, f.cls, w, unnest([0, 1, 2]) AS feature, unnest([p_t, p_m, p_x]) AS v FROM f JOIN cw USING (split, cls)), g AS (SELECT split, feature, v, count(*) AS n, sum(w * (cls = 0)::INT) AS w0, sum(w * (cls = 1)::INT) AS w1, sum(w * (cls = 2)::INT) AS w2 FROM l GROUP BY ALL), u AS (SELECT split, feature, v, lead(v) OVER d AS nxt, sum(n) OVER d AS n, sum(n) OVER a AS m, sum(w0) OVER d AS l0, sum(w1) OVER d AS l1, sum(w2) OVER d AS l2, sum(w0) OVER a AS t0, sum(w1) OVER a AS t1, sum(w2) OVER a AS t2 FROM g WINDOW d AS (PARTITION BY split, feature ORDER BY v), a AS (PARTITION BY split, feature)), i AS (SELECT split, feature, (v + nxt) / 2 AS tau, {impurity} FROM u WHERE nxt IS NOT NULL AND n >= 5 AND m - n >= 5), k AS (SELECT split, feature, tau, round({gain}, 9) AS gain FROM i) SELECT split, feature, round(tau, 6) AS tau, round(gain, 5) AS gain FROM k WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY split ORDER BY gain DESC, feature, tau) = 1"


def _sides(form: str) -> str:
    """The impurity's form for all, the left and the right rows."""
    return ", ".join(f"{form.format(*x)} AS {name}" for name, x in (("whole", ("t0", "t1", "t2")), ("lft", ("l0", "l1", "l2")), ("rgt", ("(t0 - l0)", "(t1 - l1)", "(t2 - l2)"))))


GAIN = "whole - lft - rgt"
GINI = _sides("({0} + {1} + {2}) - ({0} ** 2 + {1} ** 2 + {2} ** 2) / ({0} + {1} + {2})")
SQUARED = _sides("({1} * 0.25 + {2}) - ({1} * 0.5 + {2}) ** 2 / ({0} + {1} + {2})")
ABSOLUTE = _sides("least({1} * 0.5 + {2}, {0} * 0.5 + {2} * 0.5, {0} + {1} * 0.5)")
P3, GRADES = ["p_t", "p_m", "p_x"], [0.0, 0.5, 1.0]


def _first_split(spark, sf_dir, criterion):
    rows = trees.weighted(_fusion(spark, sf_dir), ["split"], "cls", True, 3).withColumn("node", F.lit(1).cast("long"))
    best = trees.best_splits(rows, ["split"], P3, "cls", GRADES, criterion, 5)
    return best.select("split", "feature", F.round("tau", 6).alias("tau"), F.round("gain", 5).alias("gain"))


@query("mod12_first_split", _first(GINI, GAIN))
def multi_first_split(spark, sf_dir):
    return _first_split(spark, sf_dir, "gini")


@query("mod13_first_split_squared", _first(SQUARED, GAIN))
def squared_first_split(spark, sf_dir):
    return _first_split(spark, sf_dir, "squared")


@query("mod13_first_split_absolute", _first(ABSOLUTE, GAIN))
def absolute_first_split(spark, sf_dir):
    return _first_split(spark, sf_dir, "absolute")


@query("mod12_multi_feature_tree")
def multi_feature_tree(spark, sf_dir):
    f = _fusion(spark, sf_dir)
    splits = trees.grown(f, ["split"], P3, "cls", GRADES, depth=3, min_leaf=5, balanced=True)
    return trees.predicted(f, f, splits, ["split"], P3, "cls", GRADES, depth=3, balanced=True).select("split", "doc_id", "predicted")


@query("mod13_regression_tree")
def regression_tree(spark, sf_dir):
    f, out = _fusion(spark, sf_dir), None
    for criterion in ("squared", "absolute"):
        splits = trees.grown(f, ["split"], ["p_t"], "cls", GRADES, criterion, max_leaves=3, min_leaf=5, balanced=True)
        one = trees.predicted(f, f, splits, ["split"], ["p_t"], "cls", GRADES, criterion, balanced=True).select(F.lit(criterion).alias("criterion"), "doc_id", "predicted")
        out = one if out is None else out.union(one)
    return out.withColumn("class", F.least(F.lit(2), F.greatest(F.lit(0), F.floor(2 * F.col("predicted") + 0.5))).cast("int"))


PAIRS = f"{CAND}, j AS (SELECT a.split, a.tau AS tau1, b.tau AS tau2, a.n0 + a.n1 + a.n2 AS below, b.n0 + b.n1 + b.n2 - a.n0 - a.n1 - a.n2 AS between, t0 + t1 + t2 - b.n0 - b.n1 - b.n2 AS above, (2 * a.n0 + (b.n0 - a.n0)) / t0::DOUBLE AS e0, (a.n1 + (t1 - b.n1)) / t1::DOUBLE AS e1, ((b.n2 - a.n2) + 2 * (t2 - b.n2)) / t2::DOUBLE AS e2 FROM c a JOIN c b ON a.split = b.split AND a.tau < b.tau JOIN t ON t.split = a.split), m AS (SELECT *, round((e0 + e1 + e2) / 2 / 3, 10) AS moe FROM j)"
FIRST = "SELECT split, round(tau1, 6) AS tau1, round(tau2, 6) AS tau2, round(moe, 6) AS moe FROM m {} QUALIFY row_number() OVER (PARTITION BY split ORDER BY moe, tau1, tau2) = 1"


def _threshold_pairs(spark, sf_dir, least):
    s = MO.threshold_search(_fusion(spark, sf_dir), ["split"], "p_t", "cls", descending=True, min_per_class=least)
    return s.select("split", *(F.round(c, 6).alias(c) for c in ("tau1", "tau2", "moe")))


@query("mod14_threshold_pairs", f"WITH {PAIRS} {FIRST.format('')}")
def threshold_pairs(spark, sf_dir):
    return _threshold_pairs(spark, sf_dir, 0)


@query("mod14_balanced_pairs", f"WITH {PAIRS} {FIRST.format('WHERE below >= 3 AND between >= 3 AND above >= 3')}")
def balanced_pairs(spark, sf_dir):
    return _threshold_pairs(spark, sf_dir, 3)


TRIPLES = f"{F3}, v AS (SELECT p_t AS x, sum((doc_id * 7 % 4 = 0)::INT) AS c0, sum((doc_id * 7 % 4 = 1)::INT) AS c1, sum((doc_id * 7 % 4 = 2)::INT) AS c2, sum((doc_id * 7 % 4 = 3)::INT) AS c3 FROM f GROUP BY ALL), u AS (SELECT x, sum(c0) OVER w AS n0, sum(c1) OVER w AS n1, sum(c2) OVER w AS n2, sum(c3) OVER w AS n3, lead(x) OVER w AS nxt FROM v WINDOW w AS (ORDER BY x)), t AS (SELECT max(n0) AS t0, max(n1) AS t1, max(n2) AS t2, max(n3) AS t3 FROM u), c AS (SELECT (x + nxt) / 2 AS tau, n0, n1, n2, n3 FROM u WHERE nxt IS NOT NULL UNION ALL SELECT 0.0, 0, 0, 0, 0 UNION ALL SELECT 1.0, t0, t1, t2, t3 FROM t), m AS (SELECT a.tau AS tau1, b.tau AS tau2, d.tau AS tau3, round(((b.n0 - a.n0 + 2 * (d.n0 - b.n0) + 3 * (t0 - d.n0)) / t0::DOUBLE + (a.n1 + d.n1 - b.n1 + 2 * (t1 - d.n1)) / t1 + (2 * a.n2 + b.n2 - a.n2 + t2 - d.n2) / t2 + (3 * a.n3 + 2 * (b.n3 - a.n3) + d.n3 - b.n3) / t3) / 3 / 4, 10) AS moe FROM c a JOIN c b ON a.tau < b.tau JOIN c d ON b.tau < d.tau, t)"


@query("mod15_threshold_triples", f"WITH {TRIPLES} SELECT round(tau1, 6) AS tau1, round(tau2, 6) AS tau2, round(tau3, 6) AS tau3, round(moe, 6) AS moe FROM m ORDER BY m.moe, m.tau1, m.tau2, m.tau3 LIMIT 1")
def threshold_triples(spark, sf_dir):
    f = _fusion(spark, sf_dir).withColumn("cls4", (F.col("doc_id") * 7 % 4).cast("int"))
    s = MO.threshold_search(f, [], "p_t", "cls4", n_classes=4, absent="skip")
    return s.select(*(F.round(c, 6).alias(c) for c in ("tau1", "tau2", "tau3", "moe")))


def _ten_splits(spark, sf_dir):
    f = _fusion(spark, sf_dir).drop("split")
    return R.stratified_splits(f, "doc_id", "cls", 10).select("split", "doc_id", "role").join(f, "doc_id")


@query("mod16_meta_threshold")
def meta_threshold(spark, sf_dir):
    return trees.meta_thresholds(_ten_splits(spark, sf_dir), "split", "role", "p_t", "cls")


@query("mod17_out_of_bag_vote")
def out_of_bag_vote(spark, sf_dir):
    return trees.out_of_bag_votes(_ten_splits(spark, sf_dir), "split", "role", "doc_id", P3, "cls")


@query("fea13_family", f"WITH {F3}, i AS (SELECT *, 2 * abs({MEAN3} - 0.5) * (1 - 2 * {SD3}) AS ici FROM f) SELECT doc_id, round(ici, 6) AS ici_only, round(p_t + p_m + p_x, 6) AS p_only, round(ici + p_t + p_m + p_x, 6) AS ici_plus_p FROM i")
def family(spark, sf_dir):
    f = _fusion(spark, sf_dir).withColumn("ici", MO.ici("p_t", "p_m", "p_x"))
    for name in fe.FAMILIES:
        f = fe.family(f, name, name)
    return f.select("doc_id", *(F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias(n) for n in fe.FAMILIES))


@query("win05_gated_selection", f"WITH {F3}, g AS (SELECT (doc_id % 7)::INT AS config, avg(abs(cls - said))::DOUBLE AS moe_abs, avg((cls = said)::INT) AS f1, 1.0 AS valid, false AS any_zero FROM f GROUP BY 1) SELECT config, round(moe_abs, 6) AS moe_abs, CASE WHEN moe_abs < 0.9 THEN 0 ELSE 2 END AS tier FROM g ORDER BY tier, moe_abs, f1 DESC, config LIMIT 1")
def gated_selection(spark, sf_dir):
    g = _fusion(spark, sf_dir).groupBy((F.col("doc_id") % 7).cast("int").alias("config")).agg(F.avg(F.abs(F.col("cls") - F.col("said"))).alias("moe_abs"), F.avg((F.col("cls") == F.col("said")).cast("int")).alias("f1"))
    return MO.selected_gated(g.withColumn("valid", F.lit(1.0)).withColumn("any_zero", F.lit(False)), 0.9).select("config", F.round("moe_abs", 6).alias("moe_abs"), "tier")


N4 = "sum((y = 1 AND p_t >= 0.5)::INT) AS tp, sum((y = 0 AND p_t >= 0.5)::INT) AS fp, sum((y = 1 AND p_t < 0.5)::INT) AS fn, sum((y = 0 AND p_t < 0.5)::INT) AS tn"


@query("met01_classification", f"WITH {F3}, n AS (SELECT split, {N4} FROM f GROUP BY split) SELECT split, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_yes, round(2.0 * tn / (2 * tn + fp + fn), 6) AS f1_no, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM n")
def classification(spark, sf_dir):
    m = M.classification(_fusion(spark, sf_dir), ["split"], "y", "p_t")
    return m.select("split", *(F.round(c, 6).alias(c) for c in ("f1_yes", "f1_no", "precision", "recall", "specificity", "accuracy", "mcc")))


@query("met02_roc_auc", f"WITH {F3}, r AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p_t) + (count(*) OVER (PARTITION BY split, p_t) - 1) / 2.0::DOUBLE AS r FROM f), s AS (SELECT split, sum(r) FILTER (y = 1) AS r1, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY split) SELECT split, round((r1 - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s")
def roc_auc(spark, sf_dir):
    return M.roc_auc(_fusion(spark, sf_dir), ["split"], "y", "p_t").withColumn("auc", F.round("auc", 6))


@query("vec17_roc_points", f"WITH {F3}, s AS (SELECT split, p_t AS score, sum(y) AS pos, sum(1 - y) AS neg FROM f GROUP BY ALL) SELECT split, score, round(sum(neg) OVER d / sum(neg) OVER e, 6) AS fpr, round(sum(pos) OVER d / sum(pos) OVER e, 6) AS tpr FROM s WINDOW d AS (PARTITION BY split ORDER BY score DESC), e AS (PARTITION BY split)")
def roc_points(spark, sf_dir):
    r = M.roc_points(_fusion(spark, sf_dir), ["split"], "y", "p_t")
    return r.withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query("met03_average_precision", f"WITH {F3}, s AS (SELECT split, p_t, sum(y) AS pos, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT split, pos, sum(pos) OVER w / sum(n) OVER w AS prec FROM s WINDOW w AS (PARTITION BY split ORDER BY p_t DESC)) SELECT split, round(sum(pos * prec) / sum(pos), 6) AS average_precision FROM c GROUP BY split")
def average_precision(spark, sf_dir):
    return M.average_precision(_fusion(spark, sf_dir), ["split"], "y", "p_t").withColumn("average_precision", F.round("average_precision", 6))


@query("met04_brier", f"WITH {F3} SELECT split, round(avg((p_t - y) ** 2), 6) AS brier, round(1 - avg((p_t - y) ** 2), 6) AS one_minus_brier FROM f GROUP BY split")
def brier(spark, sf_dir):
    m = M.classification(_fusion(spark, sf_dir), ["split"], "y", "p_t")
    return m.select("split", F.round("brier", 6).alias("brier"), F.round("one_minus_brier", 6).alias("one_minus_brier"))


BINS = " + ".join(f"(p_t >= {k * 0.1!r}::DOUBLE)::INT" for k in range(1, 10))


@query("met05_ece", f"WITH {F3}, b AS (SELECT split, {BINS} AS bin, count(*) AS n, avg(p_t) AS said, avg(y) AS was FROM f GROUP BY ALL) SELECT split, round(sum(n * abs(said - was)) / sum(n), 6) AS ece FROM b GROUP BY split")
def ece(spark, sf_dir):
    return M.ece(_fusion(spark, sf_dir), ["split"], "y", "p_t").withColumn("ece", F.round("ece", 6))


@query("met06_moe_abs", f"WITH {F3}, e AS (SELECT split, cls, avg(abs(cls - said)) AS e FROM f WHERE cls < 2 OR split = 0 GROUP BY ALL) SELECT split, round(avg(e), 6) AS skip, round(sum(e) / 3, 6) AS zero, round(avg(e / 3), 6) AS scaled FROM e GROUP BY split")
def moe_abs(spark, sf_dir):
    f = _fusion(spark, sf_dir).filter("cls < 2 or split = 0")
    one = lambda a: M.moe_abs(f, ["split"], "cls", "said", a).select("split", F.round("moe_abs", 6).alias(a))
    return one("skip").join(one("zero"), "split").join(one("scaled"), "split")


@query("met07_class_recalls", f"WITH {F3}, r AS (SELECT split, cls AS class, avg((cls = said)::INT) AS recall FROM f GROUP BY ALL) SELECT split, class, round(recall, 6) AS recall, bool_or(recall = 0) OVER (PARTITION BY split) AS any_zero FROM r")
def class_recalls(spark, sf_dir):
    return M.class_recalls(_fusion(spark, sf_dir), ["split"], "cls", "said").withColumn("recall", F.round("recall", 6))


@query("met08_mcnemar_counts", f"WITH {F3} SELECT split, sum(((p_t >= 0.5)::INT = y AND (p_m >= 0.5)::INT <> y)::INT)::BIGINT AS only_a, sum(((p_t >= 0.5)::INT <> y AND (p_m >= 0.5)::INT = y)::INT)::BIGINT AS only_b FROM f GROUP BY split")
def mcnemar_counts(spark, sf_dir):
    f = _fusion(spark, sf_dir).withColumn("a", (F.col("p_t") >= 0.5).cast("int")).withColumn("b", (F.col("p_m") >= 0.5).cast("int"))
    return M.mcnemar(f, ["split"], "y", "a", "b").select("split", "only_a", "only_b")


@query("met08_mcnemar_p", f"WITH {F3}, n AS (SELECT split, sum(((p_t >= 0.5)::INT = y AND (p_m >= 0.5)::INT <> y)::INT)::BIGINT AS only_a, sum(((p_t >= 0.5)::INT <> y AND (p_m >= 0.5)::INT = y)::INT)::BIGINT AS only_b FROM f GROUP BY split), i AS (SELECT split, only_a, only_b, only_a + only_b AS n, unnest(range(least(only_a, only_b) + 1)) AS i FROM n) SELECT split, only_a, only_b, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_value FROM i GROUP BY split, only_a, only_b")
def mcnemar_p(spark, sf_dir):
    f = _fusion(spark, sf_dir).withColumn("a", (F.col("p_t") >= 0.5).cast("int")).withColumn("b", (F.col("p_m") >= 0.5).cast("int"))
    return M.mcnemar(f, ["split"], "y", "a", "b").withColumn("p_value", F.round("p_value", 6))


@query("met09_spearman", f"WITH {F3}, r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY p_t) + (count(*) OVER (PARTITION BY split, p_t) - 1) / 2.0 AS a, rank() OVER (PARTITION BY split ORDER BY cls) + (count(*) OVER (PARTITION BY split, cls) - 1) / 2.0 AS b FROM f) SELECT split, round(corr(a, b), 6) AS rho FROM r GROUP BY split")
def spearman(spark, sf_dir):
    return M.spearman(_fusion(spark, sf_dir), ["split"], "p_t", "cls").withColumn("rho", F.round("rho", 6))


KINDS = ("click", "error", "purchase", "signup", "view")
LISTS = "l AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (event_id % 17 = 0), []) AS t, coalesce(list(DISTINCT event_type) FILTER (event_id % 19 = 0), []) AS p FROM events GROUP BY user_id)"


def _lists(spark, sf_dir):
    pick = lambda k: F.collect_set(F.when(F.col("event_id") % k == 0, F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(pick(17).alias("t"), pick(19).alias("p"))


@query("met10_section_f1", f"WITH {LISTS}, s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS section), x AS (SELECT section, list_contains(t, section) AS t, list_contains(p, section) AS p FROM l, s) SELECT section, round(2.0 * sum((t AND p)::INT) / (2 * sum((t AND p)::INT) + sum((t <> p)::INT)), 6) AS f1 FROM x GROUP BY section")
def section_f1(spark, sf_dir):
    return M.section_f1(_lists(spark, sf_dir), "t", "p", list(KINDS)).withColumn("f1", F.round("f1", 6))


@query("met11_qwk", f"WITH {F3}, n AS (SELECT split, count(*) AS n FROM f GROUP BY split), a AS (SELECT split, cls, count(*) AS c FROM f GROUP BY ALL), b AS (SELECT split, said, count(*) AS c FROM f GROUP BY ALL), e AS (SELECT a.split, sum((cls - said) ** 2 * a.c * b.c) AS e FROM a JOIN b ON a.split = b.split GROUP BY a.split), o AS (SELECT split, sum((cls - said) ** 2) AS o FROM f GROUP BY split) SELECT split, round(1 - o / (e / n), 6) AS kappa FROM o JOIN e USING (split) JOIN n USING (split)")
def qwk(spark, sf_dir):
    return M.quadratic_kappa(_fusion(spark, sf_dir), ["split"], "cls", "said").withColumn("kappa", F.round("kappa", 6))


@query("met12_weighted_f1", f"WITH {F3}, g AS (SELECT split, cls::VARCHAR AS t, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE said::VARCHAR END AS p FROM f), s AS (SELECT split, l, t = l AS t, coalesce(p, '__missing__') = l AS p FROM g, (VALUES ('0'), ('1'), ('2')) x(l)), c AS (SELECT split, l, 2.0::DOUBLE * sum((t AND p)::INT) / (2 * sum((t AND p)::INT) + sum((t <> p)::INT)) AS f1, sum(t::INT) AS support FROM s GROUP BY ALL) SELECT split, round(sum(support * f1) / sum(support), 6) AS weighted_f1 FROM c GROUP BY split")
def weighted_f1(spark, sf_dir):
    f = _fusion(spark, sf_dir).select("split", F.col("cls").cast("string").alias("t"), F.when(F.col("doc_id") % 11 != 0, F.col("said").cast("string")).alias("p"))
    return M.weighted_f1(f, ["split"], "t", "p", ["0", "1", "2"]).withColumn("weighted_f1", F.round("weighted_f1", 6))


@query("eva01_gate", f"WITH {F3} SELECT doc_id, CASE WHEN cls = said THEN 1.0::DOUBLE ELSE 0.0 END AS gate, CASE WHEN cls = said THEN round(p_t, 6) ELSE 0.0 END AS score FROM f")
def gate(spark, sf_dir):
    g = EV.decision_gate(F.col("cls"), F.col("said"))
    return _fusion(spark, sf_dir).select("doc_id", g.alias("gate"), F.when(g == 1, F.round("p_t", 6)).otherwise(0.0).alias("score"))


NAMES = "['uncertain', 'borderline', 'clear']"


@query("eva02_confidence", f"WITH {F3} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 1 - abs(cls - said) / 2.0::DOUBLE END AS score FROM f")
def confidence(spark, sf_dir):
    name = lambda c: F.get(F.array(F.lit(" Uncertain"), F.lit("borderline"), F.lit("CLEAR ")), F.col(c))
    f = _fusion(spark, sf_dir).withColumn("g", name("cls")).withColumn("s", F.when(F.col("doc_id") % 9 == 0, "sure").otherwise(name("said")))
    return f.select("doc_id", EV.confidence_score(F.col("g"), F.col("s")).alias("score"))


def _maps(spark, sf_dir):
    """Per document weights of three variables, as maps."""
    level = lambda m: F.get(F.array(*map(F.lit, ("not_used", "noted", "important", "decisive", "not_revealed", "bad"))), (F.col("doc_id") * m % 6).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("psa"), level(5), F.lit("vol"), level(7), F.lit("age"), level(11)).alias("g"), F.create_map(F.lit("psa"), level(13), F.lit("vol"), level(17)).alias("p"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s2"), F.lit("s2"))).alias("revealed"))


MAPS = "m AS (SELECT doc_id, unnest(['psa', 'vol', 'age']) AS v, unnest([doc_id * 5 % 6, doc_id * 7 % 6, doc_id * 11 % 6]) AS g, unnest([doc_id * 13 % 6, doc_id * 17 % 6, NULL]) AS p FROM labels), c AS (SELECT doc_id, v, CASE WHEN g <= 3 THEN g WHEN g = 4 THEN 0 END AS g, CASE WHEN p <= 3 THEN p ELSE 0 END AS p, p AS raw FROM m)"


@query("eva03_weight_score", f"WITH {MAPS} SELECT doc_id, round(1 - avg(abs(g - p) / 3.0::DOUBLE), 6) AS weight_score FROM c GROUP BY doc_id")
def weight_score(spark, sf_dir):
    return EV.weight_score(_maps(spark, sf_dir), ["doc_id"], "g", "p").withColumn("weight_score", F.round("weight_score", 6))


@query("eva04_factor_f1", f"WITH {MAPS}, s AS (SELECT doc_id, coalesce(sum((g >= 2)::INT), 0) AS a, sum((p >= 2)::INT) AS b, coalesce(sum((g >= 2 AND p >= 2)::INT), 0) AS i FROM c GROUP BY doc_id) SELECT doc_id, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN i = 0 THEN 0.0 ELSE 2.0 * i / (a + b) END::DOUBLE, 6) AS f1 FROM s")
def factor_f1(spark, sf_dir):
    return _maps(spark, sf_dir).select("doc_id", F.round(EV.factor_score("g", "p"), 6).alias("f1"))


@query("eva05_tool_precision", f"WITH {LISTS} SELECT user_id, round(CASE WHEN len(p) = 0 THEN 1.0 ELSE len(list_intersect(p, t)) / len(p) END::DOUBLE, 6) AS score FROM l")
def tool_precision(spark, sf_dir):
    return _lists(spark, sf_dir).select("user_id", F.round(EV.tool_precision("t", "p"), 6).alias("score"))


@query("eva06_grounding", f"WITH {MAPS}, u AS (SELECT doc_id, v, CASE v WHEN 'psa' THEN 1.0 WHEN 'vol' THEN (doc_id % 2 = 0)::INT::DOUBLE ELSE NULL END AS state FROM c WHERE raw BETWEEN 1 AND 3) SELECT doc_id, round(avg(state), 6) AS grounding FROM u GROUP BY doc_id")
def grounding(spark, sf_dir):
    sections = spark.createDataFrame([("psa", [], True), ("vol", ["s1", "zz"], False), ("age", ["zz"], False)], "variable string, primary array<string>, always boolean")
    return EV.grounding(_maps(spark, sf_dir), ["doc_id"], "p", "revealed", sections, ["s1", "s2"]).withColumn("grounding", F.round("grounding", 6))


@query("eva07_composite", f"WITH {F3} SELECT doc_id, round(0.225 * p_t + 0.275 * p_m + 0.175 * p_x + 0.150 * (cls / 2.0::DOUBLE), 6) AS plain, round(0.20 * p_t + 0.25 * p_m + 0.15 * p_x + 0.15 * (cls / 2.0::DOUBLE) + 0.10 * p_t, 6) AS judged FROM f")
def composite(spark, sf_dir):
    parts = {"confidence": F.col("p_t"), "weights": F.col("p_m"), "factors": F.col("p_x"), "tools": F.col("cls") / 2, "rationale": F.col("p_t")}
    return _fusion(spark, sf_dir).select("doc_id", F.round(EV.composite(parts), 6).alias("plain"), F.round(EV.composite(parts, True), 6).alias("judged"))


# Survival: months from order to shipment of a line, returned lines have the event; the prediction follows the quantity.
SURV = "s AS (SELECT l_orderkey AS k, l_linenumber, (date_diff('day', o_orderdate, l_shipdate) % 70 + 70) % 70 * 1.0::DOUBLE AS t, (l_quantity * 7 % 60) AS p, (l_returnflag = 'R')::INT AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


COUNTED = "g AS (SELECT t, p, e, count(*) AS n FROM s GROUP BY ALL)"


def _survival(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return li.select(F.col("l_orderkey").alias("k"), "l_linenumber", F.pmod(F.date_diff("l_shipdate", "o_orderdate"), F.lit(70)).cast("double").alias("t"), (F.col("l_quantity") * 7 % 60).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("e"))


@query("eva08_recurrence_scores", f"WITH {SURV} SELECT k, l_linenumber, t, p, e, round(CASE WHEN e <> 1 AND p >= t THEN 1.0 ELSE greatest(0, 1 - abs(p - t) / greatest(t, 1.0)) END, 6) AS time_score FROM s")
def recurrence_scores(spark, sf_dir):
    return _survival(spark, sf_dir).withColumn("time_score", F.round(EV.recurrence_time_score(F.col("e"), F.col("t"), F.col("p")), 6))


@query("eva09_c_index", f"WITH {SURV}, {COUNTED} SELECT round(sum(a.n * b.n * CASE WHEN a.p < b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6) AS c_index, sum(a.n * b.n)::DOUBLE AS pairs FROM g a JOIN g b ON a.t < b.t AND a.e = 1")
def c_index(spark, sf_dir):
    return EV.c_index(_survival(spark, sf_dir), "t", "p", "e").withColumn("c_index", F.round("c_index", 6))


@query("joi09_comparable_pairs", f"WITH {SURV}, {COUNTED} SELECT a.t, sum(a.n * b.n)::BIGINT AS pairs FROM g a JOIN g b ON a.t < b.t AND a.e = 1 GROUP BY a.t")
def comparable_pairs(spark, sf_dir):
    return EV.comparable_pairs(_survival(spark, sf_dir), "t", "e")


KM = f"{SURV}, steps AS (SELECT t, count(*) AS n, sum((e = 0)::INT) AS c FROM s GROUP BY t), r AS (SELECT t, 1 - c / sum(n) OVER (ORDER BY t DESC)::DOUBLE AS f FROM steps), km AS (SELECT t, CASE WHEN max((f <= 0)::INT) OVER (ORDER BY t) = 1 THEN 0.0 ELSE exp(sum(CASE WHEN f > 0 THEN ln(f) ELSE 0 END) OVER (ORDER BY t)) END AS g FROM r)"


@query("eva10_km", f"WITH {KM} SELECT t, round(g, 6) AS g FROM km")
def km(spark, sf_dir):
    return EV.censoring_km(_survival(spark, sf_dir), "t", "e").withColumn("g", F.round("g", 6))


@query("joi10_as_of", f"WITH {KM}, h AS (SELECT unnest([0.5, 12.0, 24.0, 36.0, 60.0]::DOUBLE[]) AS h) SELECT h, round(coalesce(arg_max(g, t), 1.0), 6) AS g FROM h LEFT JOIN km ON t <= h GROUP BY h")
def as_of(spark, sf_dir):
    hs = spark.createDataFrame([(0.5,), (12.0,), (24.0,), (36.0,), (60.0,)], "h double")
    return EV.km_at(hs, EV.censoring_km(_survival(spark, sf_dir), "t", "e"), "h").withColumn("g", F.round("g", 6))


@query("eva11_td_auc", f"WITH {KM}, h AS (SELECT unnest([12.0, 24.0, 36.0, 60.0]::DOUBLE[]) AS h), gh AS (SELECT h, coalesce(arg_max(g, t), 1.0) AS gh FROM h LEFT JOIN km ON t <= h GROUP BY h), a AS (SELECT h, p, sum(1 / g) AS w FROM s JOIN km USING (t), h WHERE e = 1 AND t <= h AND g > 0 GROUP BY ALL), b AS (SELECT gh.h, p, sum(1 / gh) AS w FROM s, gh WHERE t > gh.h AND gh > 0 GROUP BY ALL) SELECT a.h AS horizon, round(sum(a.w * b.w * CASE WHEN a.p < b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / sum(a.w * b.w), 6) AS auc FROM a JOIN b ON a.h = b.h GROUP BY a.h")
def td_auc(spark, sf_dir):
    return EV.time_dependent_auc(_survival(spark, sf_dir), "t", "p", "e").withColumn("auc", F.round("auc", 6))


@query("eva12_aggregate", f"WITH {F3}, n AS (SELECT {N4}, avg((cls = said)::INT) AS gate_rate, avg(CASE WHEN cls = said THEN p_t ELSE 0 END) AS mean_score, avg(CASE WHEN doc_id % 9 <> 0 THEN p_x END) AS mean_part, avg((cls = said)::INT) AS accuracy, sum((cls - said) ** 2) AS o, count(*) AS n FROM f), e AS (SELECT sum((a.cls - b.said) ** 2 * a.c * b.c) AS e FROM (SELECT cls, count(*) AS c FROM f GROUP BY cls) a, (SELECT said, count(*) AS c FROM f GROUP BY said) b) SELECT round(gate_rate, 6) AS gate_rate, round(mean_score, 6) AS mean_score, round(mean_part, 6) AS mean_part, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / n, 6) AS accuracy, round(1 - o / (e / n), 6) AS kappa, round((mean_score + 2.0 * tp / (2 * tp + fp + fn)) / 2, 6) AS ranking FROM n, e")
def aggregate(spark, sf_dir):
    f = _fusion(spark, sf_dir)
    g = EV.decision_gate(F.col("cls"), F.col("said"))
    one = f.agg(F.avg(g).alias("gate_rate"), F.avg(F.when(g == 1, F.col("p_t")).otherwise(0.0)).alias("mean_score"), F.avg(F.when(F.col("doc_id") % 9 != 0, F.col("p_x"))).alias("mean_part"))
    one = one.crossJoin(M.classification(f, [], "y", "p_t").select(F.col("f1_yes").alias("f1"), "accuracy")).crossJoin(M.quadratic_kappa(f, [], "cls", "said"))
    return one.withColumn("ranking", (F.col("mean_score") + F.col("f1")) / 2).select(*(F.round(c, 6).alias(c) for c in ("gate_rate", "mean_score", "mean_part", "f1", "accuracy", "kappa", "ranking")))


@query("eva12_survival", f"WITH {SURV}, {COUNTED}, c AS (SELECT sum(a.n * b.n * CASE WHEN a.p < b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / sum(a.n * b.n) AS c FROM g a JOIN g b ON a.t < b.t AND a.e = 1) SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(0.5 * (e = (p < 30)::INT)::INT + 0.5 * CASE WHEN e <> 1 AND p >= t THEN 1.0 ELSE greatest(0, 1 - abs(p - t) / greatest(t, 1.0)) END) FROM s), 5) AS mean_score, round(c, 6) AS ranking FROM c")
def survival_aggregate(spark, sf_dir):
    """The third task: mean recurrence score; it ranks by the concordance index."""
    s = _survival(spark, sf_dir)
    score = EV.recurrence_score(F.col("e"), (F.col("p") < 30).cast("int"), F.col("t"), F.col("p"))
    one = s.agg(F.count("*").alias("n"), F.round(F.avg(score), 5).alias("mean_score"))
    return one.crossJoin(EV.c_index(s, "t", "p", "e").select(F.round("c_index", 6).alias("ranking")))


NEAR = "near AS (SELECT i AS q, j AS n, dist FROM p UNION ALL SELECT j, i, dist FROM p), first AS (SELECT q, n FROM near QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, n) = 1)"


@query("att01_distance_attribution", f"WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.id < b.id), {NEAR} SELECT q, unnest(['psa', 'vol']) AS \"column\", round(unnest([(abs(a.v[1] - b.v[1]) + abs(a.v[2] - b.v[2])) / 2, abs(a.v[3] - b.v[3])]), 6) AS value FROM first JOIN e a ON a.id = q JOIN e b ON b.id = n")
def distance_attribution(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get(F.col("embedding").cast("array<double>"), i).alias(c) for i, c in enumerate(("psa", "psa__is_missing", "vol"))))
    return AT.distance_attribution(V.knn(_base(spark, sf_dir), 1), e, "id", ["psa", "psa__is_missing", "vol"]).withColumn("value", F.round("value", 6))


@query("att02_exact_shapley")
def exact_shapley(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("v"), (F.col("label") < 5).cast("int").alias("y"))
    mem = e.orderBy(R.hash_order(42, "id"), "id").limit(60).collect()
    x, q = np.array([r["v"] for r in mem]), np.array([float(r["y"]) for r in mem])
    return AT.exact_shapley(e.select("id", "v"), x, q, x[:5])


@query("att02_kernel_shap")
def kernel_shap(spark, sf_dir):
    """All rows, all dimensions: 20 coalitions, 10 features, 5 background rows; the model keeps at most ``SH.MAX_MEMORY`` rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("double").alias("y"))
    memory, labels = SH.fitted_memory(e)
    return SH.kernel_shap(e, memory, labels, memory[: SH.BACKGROUND])


@query("att03_max_normalised", "SELECT event_id, event_type, round(value / max(value) OVER (PARTITION BY event_type), 6) AS value FROM events")
def max_normalised(spark, sf_dir):
    return AT.max_normalised(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value").withColumn("value", F.round("value", 6))


PVAL = "q AS (SELECT event_id, event_type, value, (1 + 500 * count(*) OVER (PARTITION BY event_type ORDER BY value DESC)) / (1 + 500 * count(*) OVER (PARTITION BY event_type))::DOUBLE AS p_value, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events)"


@query("att04_permutation_p", f"WITH {PVAL} SELECT event_id, round(p_value, 6) AS p_value, round(z, 6) AS z FROM q")
def permutation_p(spark, sf_dir):
    p = AT.permutation_p(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return p.select("event_id", F.round("p_value", 6).alias("p_value"), F.round("z", 6).alias("z"))


@query("att05_conditions", f"WITH {PVAL} SELECT event_id, unnest(['raw', 'z', 'z_gated', 'p', 'p_gated']) AS condition, round(unnest([value, z, CASE WHEN p_value < 0.05 THEN z ELSE 0 END, 1 - p_value, CASE WHEN p_value < 0.05 THEN 1 - p_value ELSE 0 END]), 6) AS value FROM q")
def conditions(spark, sf_dir):
    p = AT.permutation_p(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return p.select("event_id", F.explode(AT.conditions(F.col("value"), F.col("z"), F.col("p_value"))).alias("c")).select("event_id", "c.condition", F.round("c.value", 6).alias("value"))


# Kernel density: every row with every prototype, itself too; labels soft by certainty, prior weights by the id.
KDM = f"{P}, pr AS (SELECT id, (id % 7 + 1)::DOUBLE AS w, 0.5 + CASE WHEN label < 5 THEN 0.5 ELSE -0.5 END * CASE id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0.25 END AS y FROM e), two AS (SELECT i AS q, j AS n, dist FROM p UNION ALL SELECT j, i, dist FROM p UNION ALL SELECT id, id, 0.0 FROM e), k AS (SELECT q, n, y, CASE WHEN y IN (0, 1) THEN 0 ELSE -y * ln(y) - (1 - y) * ln(1 - y) END AS h, w * exp(-(dist ** 2) / (2 * 5.0 ** 2)) ** 2 AS k FROM two JOIN pr ON pr.id = n), g AS (SELECT q, sum(k * y) / sum(k) AS p, sum(k * h) / sum(k) AS aleatoric, max(k) / sum(k) AS max_weight, ln(sum(k) ** 2 / sum(k * k)) AS log_ess, ln(sum(k)) AS log_marginal, ln(sum(k)) - sum(CASE WHEN k > 0 THEN k * ln(k) ELSE 0 END) / sum(k) AS weight_entropy FROM k GROUP BY q), t AS (SELECT *, CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * ln(1 - p) ELSE 0 END AS total FROM g)"


def _prototypes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = F.when(F.col("vec_id") % 3 == 0, 1.0).when(F.col("vec_id") % 3 == 1, 0.5).otherwise(0.25)
    return e.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 7 + 1).cast("double").alias("w"), S.soft_target((F.col("label") < 5).cast("int"), c).alias("y"))


def _kdm(spark, sf_dir):
    return AT.kdm_signals(V.kernel_sums(_base(spark, sf_dir), _prototypes(spark, sf_dir), 5.0))


@query("kdm01_forward", f"WITH {KDM} SELECT q, round(p, 6) AS p, round(max_weight, 6) AS max_weight, round(log_ess, 6) AS log_ess, round(log_marginal, 6) AS log_marginal, round(weight_entropy, 6) AS weight_entropy FROM t")
def kdm_forward(spark, sf_dir):
    return _kdm(spark, sf_dir).select("q", *(F.round(c, 6).alias(c) for c in ("p", "max_weight", "log_ess", "log_marginal", "weight_entropy")))


@query("kdm02_entropy", f"WITH {KDM} SELECT q, round(total, 5) AS total_entropy, round(aleatoric, 5) AS aleatoric, round(total - aleatoric, 5) AS epistemic FROM t")
def kdm_entropy(spark, sf_dir):
    return _kdm(spark, sf_dir).select("q", *(F.round(c, 5).alias(c) for c in ("total_entropy", "aleatoric", "epistemic")))


def _kdm_rows(spark, sf_dir, splits=None):
    """Vectors, hard labels and roles: all rows train, or the stratified ``splits``."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("int").alias("y"))
    if splits is None:
        return e.withColumn("roles", F.array(F.lit(0)))
    return e.join(R.fold_roles(R.stratified_splits(e.select("id", "y"), "id", "y", splits), "id"), "id")


@query("kdm01_train")
def kdm_train(spark, sf_dir):
    """All rows train and are scored; the prototypes are a bounded sample, and one doesn't vote on itself."""
    t = KD.fit(_kdm_rows(spark, sf_dir), [KD.Config()], epochs=30, rate=0.02)
    return AT.kdm_signals(V.kernel_sums(_base(spark, sf_dir), t.prototypes(spark), t.sigma(), leave_self_out=True)).select("q", "p", "total_entropy")


@query("kdm01_grid")
def kdm_grid(spark, sf_dir):
    """The 32 configurations on three stratified splits, trained together: one job an epoch."""
    return KD.grid(_kdm_rows(spark, sf_dir, 3), epochs=10, rate=0.02, prototypes=100)


@query("kdm03_drift")
def kdm_drift(spark, sf_dir):
    """How far prototype labels move in training on all rows: hard ones not at all, smoothed ones do. One row for each prototype and smoothing."""
    eps = (0.0, 0.1)
    t = KD.fit(_kdm_rows(spark, sf_dir), [KD.Config(y_train=True, eps=x) for x in eps], epochs=10, rate=0.02)
    rows = [(x, int(i), float(d), bool(d < 1e-9)) for k, x in enumerate(eps) for i, d in zip(t.ids, t.drift(k))]
    return spark.createDataFrame(rows, "smooth double, prototype long, drift double, fixed boolean")


SEEDS = f"{P}, seed AS (SELECT unnest([1, 2, 3])::BIGINT AS seed), two AS (SELECT i AS q, j AS n, dist FROM p UNION ALL SELECT j, i, dist FROM p), k AS (SELECT seed, q, (label < 5)::INT AS y, (n * seed % 7 + 1) * exp(-(dist ** 2) / (2 * 5.0 ** 2)) ** 2 AS k FROM two JOIN e ON e.id = n, seed), r AS (SELECT seed, q, round(sum(k * y) / sum(k), 9) AS p FROM k GROUP BY ALL)"


@query("kdm04_seed_averages", f"WITH {SEEDS} SELECT q, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS deviation, (avg((p >= 0.5)::INT) > 0.5)::INT AS vote, round(greatest(avg((p >= 0.5)::INT), 1 - avg((p >= 0.5)::INT)), 6) AS agreement FROM r GROUP BY q")
def seed_averages(spark, sf_dir):
    """Leave-one-out probabilities of three models, whose prior weights differ by a seed, averaged."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("double").alias("y"))
    weights = {f"w{seed}": (F.col("id") * seed % 7 + 1).cast("double") for seed in (1, 2, 3)}
    out = V.weighted_votes(e.withColumns(weights), list(weights), "y", 5.0).select("q", F.posexplode("p").alias("seed", "p")).withColumn("p", F.round("p", 9))
    m = AT.seeds_averaged(out, ["q"])
    return m.select("q", "vote", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "agreement")))


SIM = f"{UNIT}, z AS (SELECT i, j, li = lj AS same, abs(li - lj) AS gap, 1 - dist ** 2 / 2 AS s, dist FROM p UNION ALL SELECT j, i, li = lj, abs(li - lj), 1 - dist ** 2 / 2, dist FROM p)"


def _labelled_unit(spark, sf_dir):
    return _unit(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label"), "id")


@query("los01_nt_xent", f"WITH {SIM} SELECT round(avg(ln(a) - pos), 6) AS loss FROM (SELECT i, sum(exp(s / 0.5)) AS a, max(CASE WHEN j = (i + 1) % (SELECT count(*) FROM e) THEN s / 0.5 END) AS pos FROM z GROUP BY i) WHERE pos IS NOT NULL")
def nt_xent(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    unit = _labelled_unit(spark, sf_dir).withColumn("next", (F.col("id") + 1) % n)
    return PS.nt_xent(PS.anchors(unit, label=None, positive="next", distances=False)).select(F.round("loss", 6).alias("loss"))


@query("los02_supcon", f"WITH {SIM} SELECT round(avg(ln(a) - pos), 6) AS loss FROM (SELECT i, sum(exp(s / 0.5)) AS a, avg(CASE WHEN same THEN s / 0.5 END) AS pos FROM z GROUP BY i) WHERE pos IS NOT NULL")
def supcon(spark, sf_dir):
    return PS.supcon(PS.anchors(_labelled_unit(spark, sf_dir), distances=False)).select(F.round("loss", 6).alias("loss"))


@query("los03_align_uniform", f"WITH {SIM} SELECT round(avg(CASE WHEN same THEN dist ** 2 END), 6) AS alignment, round(ln(avg(exp(-2 * dist ** 2))), 6) AS uniformity FROM z")
def align_uniform(spark, sf_dir):
    a = PS.align_uniform(_labelled_unit(spark, sf_dir))
    return a.select(F.round("alignment", 6).alias("alignment"), F.round("uniformity", 6).alias("uniformity"))


@query("los04_triplet", f"WITH {SIM}, b AS (SELECT i, max(dist) FILTER (same) AS fp, avg(dist) FILTER (same) AS mp, min(dist) FILTER (NOT same) AS nn, avg(dist) FILTER (NOT same) AS mn FROM z GROUP BY i), c AS (SELECT z.i, min(dist) AS nearest FROM z JOIN b ON z.i = b.i WHERE NOT same AND dist > fp GROUP BY z.i) SELECT round(avg(greatest(0, mp - mn + 0.2)), 6) AS easy, round(avg(greatest(0, fp - nn + 0.2)), 6) AS hard, round(avg(greatest(0, fp - coalesce(nearest, nn) + 0.2)), 6) AS semihard FROM b LEFT JOIN c ON b.i = c.i")
def triplet(spark, sf_dir):
    unit = _labelled_unit(spark, sf_dir)
    t = PS.triplet(unit, O.kept(PS.anchors(unit)))
    return t.select(*(F.round(c, 6).alias(c) for c in t.columns))


@query("los05_rank_n_contrast", f"WITH {SIM}, g AS (SELECT i, gap, sum(exp(s / 2.0)) AS e, sum(s / 2.0) AS s, count(*) AS n FROM z GROUP BY ALL), t AS (SELECT n, s, ln(sum(e) OVER (PARTITION BY i ORDER BY gap DESC)) AS tail FROM g) SELECT round(sum(n * tail - s) / sum(n), 6) AS loss FROM t")
def rank_n_contrast(spark, sf_dir):
    return PS.rank_n_contrast(_labelled_unit(spark, sf_dir)).select(F.round("loss", 6).alias("loss"))


@query("los06_combined", f"WITH {SIM} SELECT round(1.0 * (SELECT avg(ln(a) - pos) FROM (SELECT i, sum(exp(s / 0.5)) AS a, avg(CASE WHEN same THEN s / 0.5 END) AS pos FROM z GROUP BY i) WHERE pos IS NOT NULL) + 0.5 * (SELECT ln(avg(exp(-2 * dist ** 2))) FROM z), 6) AS loss")
def combined(spark, sf_dir):
    unit = _labelled_unit(spark, sf_dir)
    a = O.kept(PS.anchors(unit, distances=False))
    return L.combined([(1.0, PS.supcon(a), "loss"), (0.5, PS.uniformity_of(a), "uniformity")]).select(F.round("loss", 6).alias("loss"))


@query("aug01_noise")
def noise(spark, sf_dir):
    return L.with_noise(_base(spark, sf_dir), "id", "v", 0.1)


@query("aug02_dropout")
def dropout(spark, sf_dir):
    return L.with_dropout(_base(spark, sf_dir), "id", "v", 0.1)


@query("aug03_cutout", "SELECT vec_id AS id, round(list_sum(embedding[1:8]::DOUBLE[]) + list_sum(embedding[25:64]::DOUBLE[]), 5) AS total FROM embeddings")
def cutout(spark, sf_dir):
    return L.with_cutout(_base(spark, sf_dir), "v", 8, 16).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


NEAREST = f"WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.id < b.id), {NEAR}"


@query("aug04_mixup", f"{NEAREST} SELECT q AS id, round(0.7 * list_sum(a.v) + 0.3 * list_sum(b.v), 5) AS total FROM first JOIN e a ON a.id = q JOIN e b ON b.id = n")
def mixup(spark, sf_dir):
    b = _base(spark, sf_dir)
    return L.mixed_up(b, "id", "v", V.knn(b, 1), 0.7).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("aug05_knn_positive", f"{NEAREST} SELECT q AS id, n, round(b.v[1], 6) AS first FROM first JOIN e b ON b.id = n")
def knn_positive(spark, sf_dir):
    b = _base(spark, sf_dir)
    return L.knn_positive(b, "id", "v", V.knn(b, 1)).select("id", "n", F.round(F.get("positive", 0), 6).alias("first"))


@query("aug04_random_mixup")
def random_mixup(spark, sf_dir):
    """Two views of each row, each mixed with a random one of five neighbours by a share of its own from Beta(0.4, 0.4)."""
    b = _base(spark, sf_dir)
    edges, out = O.kept(V.knn(b, 5)), None
    for view in (1, 2):
        one = L.mixed_up(b, "id", "v", L.random_neighbour(edges, view), L.beta_share("id", seed=10 * view)).withColumn("view", F.lit(view))
        out = one if out is None else out.union(one)
    return out


@query("aug05_random_positive")
def random_positive(spark, sf_dir):
    b = _base(spark, sf_dir)
    return L.knn_positive(b, "id", "v", L.random_neighbour(V.knn(b, 5)))


@query("aug01_adaptive_noise")
def adaptive_noise(spark, sf_dir):
    """Noise as wide as the mean distance to five neighbours."""
    b = _base(spark, sf_dir)
    radius = V.knn(b, 5).groupBy(F.col("q").alias("id")).agg(F.avg("dist").alias("radius"))
    return L.with_noise(b.join(radius, "id"), "id", "v", F.col("radius") / 8).drop("radius")


@query("aug06_composed")
def composed(spark, sf_dir):
    return L.composed(_base(spark, sf_dir), lambda d: L.with_noise(d, "id", "v", 0.05), lambda d: L.with_dropout(d, "id", "v", 0.1))


@query("aug06_one_of")
def one_of(spark, sf_dir):
    return L.one_of(_base(spark, sf_dir), "id", "v", lambda d: L.with_noise(d, "id", "v", 0.05), lambda d: L.with_dropout(d, "id", "v", 0.1))


@query("rep01_refined")
def refined(spark, sf_dir):
    """Trained on all rows, with their labels, and applied to all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("y"))
    r = Refiner(16, hidden=64, losses=[(1.0, "supcon"), (0.5, "align_uniform")], epochs=6, eval_every=3).fit(e)
    return r.transform(e)


@query("rep02_training_history")
def training_history(spark, sf_dir):
    """Each epoch's mean loss, and what the held-out rows were evaluated to; plateau schedule, early stop."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    r = Refiner(16, hidden=64, epochs=6, eval_every=2, schedule="plateau", monitor="isotropy", patience=2, rate=3e-3).fit(e)
    rows = [("loss", k + 1, x) for k, x in enumerate(r.history["loss"])] + [(r.monitor, r.eval_every * (k + 1), x) for k, x in enumerate(r.history.get(r.monitor, []))]
    return spark.createDataFrame(rows, "metric string, epoch int, value double")


@query("rep03_auto_refined")
def auto_refined(spark, sf_dir):
    """From the report to refined vectors: the report's width, five neighbours as positives, contrast and half of alignment and uniformity."""
    b = _base(spark, sf_dir)
    return refined_by(b, V.analysis(b), hidden=64, epochs=4, eval_every=4).transform(b)


@query("srv01_fused_decision", f"WITH {F3} SELECT doc_id, round(p_t, 4) AS p_t, round(p_m, 4) AS p_m, round(p_x, 4) AS p_x, CASE WHEN {MEAN3} >= 0.5 THEN 'yes' ELSE 'no' END AS decision FROM f")
def fused_decision(spark, sf_dir):
    mean, _ = MO.spread("p_t", "p_m", "p_x")
    return _fusion(spark, sf_dir).select("doc_id", *(F.round(c, 4).alias(c) for c in ("p_t", "p_m", "p_x")), F.when(mean >= 0.5, "yes").otherwise("no").alias("decision"))


THREE = """lab AS (SELECT vec_id AS id, label, (label < 5)::INT AS y, embedding::DOUBLE[] AS v FROM embeddings),
 x AS (SELECT id, y, v[1:8] AS tab, v[9:40] AS img, v[41:64] AS txt FROM lab),
 mem AS (SELECT * FROM x WHERE id % 3 <> 0),
 d AS (SELECT q.id AS q, m.y, m.id AS n, unnest(['t', 'm', 'x']) AS part, unnest([list_distance(q.tab, m.tab), list_distance(q.img, m.img), list_distance(q.txt, m.txt)]) AS dist FROM x q JOIN mem m ON q.id <> m.id),
 r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q, part ORDER BY dist, n) <= 5),
 p AS (SELECT q, part, sum(y / (dist + 1e-8)) / sum(1 / (dist + 1e-8)) AS p FROM r GROUP BY q, part),
 w AS (SELECT q AS id, max(p) FILTER (part = 't') AS p_t, max(p) FILTER (part = 'm') AS p_m, max(p) FILTER (part = 'x') AS p_x FROM p GROUP BY q)"""


@query("srv01_three_models", f"WITH {THREE} SELECT id, round(p_t, 4) AS p_t, round(p_m, 4) AS p_m, round(p_x, 4) AS p_x, CASE WHEN (p_t + p_m + p_x) / 3 >= 0.5 THEN 'yes' ELSE 'no' END AS decision FROM w")
def three_models(spark, sf_dir):
    """The serving route: three neighbour models, each on a part of the vectors, their memories two thirds of the rows, fused with equal weights; every row is asked."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("int").alias("y"))
    out, memory = None, F.col("id") % 3 != 0
    for name, first, width in (("p_t", 1, 8), ("p_m", 9, 32), ("p_x", 41, 24)):
        part = e.select("id", F.slice("v", first, width).alias("v"))
        w = 1 / (F.col("dist") + 1e-8)
        near = V.knn(part.filter(memory), 5, queries=part).join(e.select(F.col("id").alias("n"), "y"), "n")
        p = near.groupBy(F.col("q").alias("id")).agg((F.sum(F.col("y") * w) / F.sum(w)).alias(name))
        out = p if out is None else out.join(p, "id")
    mean, _ = MO.spread("p_t", "p_m", "p_x")
    return out.select("id", *(F.round(c, 4).alias(c) for c in ("p_t", "p_m", "p_x")), F.when(mean >= 0.5, "yes").otherwise("no").alias("decision"))


@query("srv02_confidence", f"WITH {F3}, r AS (SELECT doc_id, round(2 * abs(0.65::DOUBLE * {MEAN3} - 0.5), 4) AS risk FROM f) SELECT doc_id, risk, CASE WHEN risk >= 0.6 THEN 'clear' WHEN risk >= 0.3 THEN 'borderline' ELSE 'uncertain' END AS confidence FROM r")
def serving_confidence(spark, sf_dir):
    mean, _ = MO.spread("p_t", "p_m", "p_x")
    r = _fusion(spark, sf_dir).select("doc_id", MO.serving_risk(mean).alias("risk"))
    return r.withColumn("confidence", F.get(F.array(F.lit("uncertain"), F.lit("borderline"), F.lit("clear")), S.by_thresholds("risk", 0.3, 0.6)))


RELEVANCE = f"WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.id < b.id), {NEAR}, d AS (SELECT q, unnest(['pirads', 'psav', 'months', 'age']) AS variable, unnest([abs(a.v[1] - b.v[1]), abs(a.v[2] - b.v[2]), abs(a.v[3] - b.v[3]), abs(a.v[4] - b.v[4])]) AS value FROM first JOIN e a ON a.id = q JOIN e b ON b.id = n), m AS (SELECT q, variable, value / max(value) OVER (PARTITION BY variable) AS value FROM d), c AS (SELECT q, variable, (value >= 0.1)::INT + (value >= 0.3)::INT + (value >= 0.6)::INT AS class FROM m), w AS (SELECT q, max(class) FILTER (variable = 'pirads') AS pirads, max(class) FILTER (variable = 'psav') AS psav, max(class) FILTER (variable = 'months') AS months, max(class) FILTER (variable = 'age') AS age FROM c GROUP BY q)"


@query("srv03_explanation", f"{RELEVANCE} SELECT q, pirads, psav, months, age, array_to_string(list_filter([CASE WHEN pirads >= 1 THEN 'radiology_report' END, CASE WHEN psav >= 1 THEN 'psa_trend' END, CASE WHEN months >= 1 THEN 'previous_notes' END, CASE WHEN age >= 2 THEN 'vitals' END], lambda x: x IS NOT NULL), ',') AS reveal FROM w")
def explanation(spark, sf_dir):
    names = ["pirads", "psav", "months", "age"]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.get(F.col("embedding").cast("array<double>"), i).alias(n) for i, n in enumerate(names)))
    x = AT.explained(AT.distance_attribution(V.knn(_base(spark, sf_dir), 1), rows, "id", names), names, dict.fromkeys(names, (0.1, 0.3, 0.6)))
    return x.withColumn("reveal", F.array_join("reveal", ","))


@query("srv03_shapley_explanation")
def shapley_explanation(spark, sf_dir):
    """The explaining tool as it serves: kernel Shapley values of the neighbour vote over all dimensions, their mean size per variable, scaled by the largest of the table, cut into classes and turned into sections."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 5).cast("double").alias("y"))
    names = ["pirads", "psav", "months", "age"]
    families = [f"{names[i * len(names) // 64]}__{i}" for i in range(64)]
    memory, labels = SH.fitted_memory(e)
    found = SH.by_family(SH.kernel_shap(e, memory, labels, memory[: SH.BACKGROUND]), families)
    return AT.explained(O.kept(found), names, dict.fromkeys(names, (0.1, 0.3, 0.6))).withColumn("reveal", F.array_join("reveal", ","))


@query("srv04_record", f"WITH {F3}, r AS (SELECT doc_id, {MEAN3} AS p, round(2 * abs(0.65::DOUBLE * {MEAN3} - 0.5), 4) AS risk, doc_id % 9 <> 0 AS has FROM f) SELECT doc_id, CASE WHEN p >= 0.5 THEN 'yes' ELSE 'no' END AS decision, CASE WHEN risk >= 0.6 THEN 'clear' WHEN risk >= 0.3 THEN 'borderline' ELSE 'uncertain' END AS confidence, has AS ok, CASE WHEN has THEN 'ok' ELSE 'variable_weights must be an object' END AS reason FROM r")
def record(spark, sf_dir):
    """The tools' outputs joined into one record, as they are, and checked."""
    mean, _ = MO.spread("p_t", "p_m", "p_x")
    tools = _fusion(spark, sf_dir).select("doc_id", F.when(mean >= 0.5, "yes").otherwise("no").alias("decision"), MO.serving_risk(mean).alias("risk"))
    tools = tools.withColumn("confidence", F.get(F.array(F.lit("uncertain"), F.lit("borderline"), F.lit("clear")), S.by_thresholds("risk", 0.3, 0.6)))
    checked = tools.withColumn("v", S.validated("treatment", F.col("decision"), F.col("doc_id") % 9 != 0))
    return checked.select("doc_id", "decision", "confidence", "v.ok", "v.reason")


@query("srv04_report_text", f"WITH {F3} SELECT doc_id, printf('Biopsy %s; combined probability %.2f.', CASE WHEN {MEAN3} >= 0.5 THEN 'recommended' ELSE 'not recommended' END, {MEAN3}) AS free_text FROM f")
def report_text(spark, sf_dir):
    mean, _ = MO.spread("p_t", "p_m", "p_x")
    return _fusion(spark, sf_dir).select("doc_id", F.format_string("Biopsy %s; combined probability %s.", F.when(mean >= 0.5, "recommended").otherwise("not recommended"), S.fixed(mean, 2)).alias("free_text"))
