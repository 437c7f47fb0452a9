"""Queries over sources, joins, aggregates, windows, sets and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import order as O
from ..operators import resampling as R
from ..operators import sets
from ..sources import readers
from .registry import query, table


@query("src01_case_documents", "SELECT user_id, max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY user_id")
def case_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k bigint").alias("doc"))
    return e.groupBy("user_id").agg(F.max("doc.k").alias("k"), F.count("*").alias("n"))


@query("src02_null_policies", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 4 = 2 THEN NULL ELSE o_totalprice END AS coerced FROM orders")
def null_policies(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "NA").when(k % 4 == 2, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(~raw.isin("", "NA"), raw).try_cast("double").alias("coerced"))


@query("src03_json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json("props", "k bigint")).alias("again"))
    return e.select("event_id", F.from_json("again", "k bigint")["k"].alias("k"))


@query("src04_vector_arrays", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_arrays(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("src06_interface_route", "WITH k AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS key FROM events GROUP BY user_id) SELECT user_id, key, CASE key WHEN 'click|error|purchase|signup|view' THEN 'task1' WHEN 'click|error|signup|view' THEN 'task2' END AS task FROM k")
def interface_route(spark, sf_dir):
    k = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("slugs")).select("user_id", readers.interface_key(F.col("slugs")).alias("key"))
    routes = spark.createDataFrame([("click|error|purchase|signup|view", "task1"), ("click|error|signup|view", "task2")], "key string, task string")
    return k.join(F.broadcast(routes), "key", "left")


@query("src07_ground_truth", "SELECT doc_id, quality, lang, length(text) AS n FROM documents JOIN labels USING (doc_id)")
def ground_truth(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "lang", F.char_length("text").cast("long").alias("n"))


@query("src09_manifest", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS length FROM documents")
def manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))


@query("joi01_left_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("joi02_three_way", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity + o.o_totalprice + c.c_acctbal AS total FROM lineitem a JOIN orders o ON a.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey")
def three_way(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return li.join(o, "l_orderkey").join(c, "o_custkey").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("o_totalprice") + F.col("c_acctbal")).alias("total"))


@query("joi03_ordered_alignment", "SELECT row_number() OVER (ORDER BY doc_id DESC) AS place, doc_id, d.n_chars FROM labels JOIN documents d USING (doc_id)")
def ordered_alignment(spark, sf_dir):
    ids, rows = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    if not ids.join(rows, "doc_id", "left_anti").isEmpty():
        raise KeyError("an id has no row")
    return O.placed(ids.join(rows, "doc_id"), F.col("doc_id").desc()).select((F.col("place") + 1).alias("place"), "doc_id", "n_chars")


@query("joi04_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("joi05_missing_candidates", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_candidate' ELSE 'ok' END AS status, coalesce(l.quality, 0) AS score FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_candidates(spark, sf_dir):
    d, got = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    have = got.select("doc_id", F.lit("ok").alias("status"), F.col("quality").alias("score"))
    return have.join(d, "doc_id", "left_semi").unionByName(d.join(got, "doc_id", "left_anti").select("doc_id", F.lit("missing_candidate").alias("status"), F.lit(0).alias("score")))


@query("joi06_compared_keys", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0) b ON a.k = b.k")
def compared_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return sets.compared_keys(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 5 = 0"), "k")


SERIES = "SELECT user_id, event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, min(value) AS lowest, max(value) AS highest, avg(value) AS mean FROM events GROUP BY user_id, event_type"


@query("agg01_series_stats", f"SELECT user_id, event_type, n, first, last, lowest, highest, round(mean, 6) AS mean, round(last - first, 6) AS delta, round((last - first) / greatest(n - 1, 1), 6) AS slope FROM ({SERIES})")
def series_stats(spark, sf_dir):
    s = A.series_stats(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "delta", "slope")})


@query("agg02_last_match", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (contains(event_type, 'sign')) AS sign, arg_max(value, (ts, event_id)) FILTER (contains(event_type, 'c')) AS with_c FROM events GROUP BY user_id")
def last_match(spark, sf_dir):
    t = F.col("event_type")
    return A.last_match(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", {"sign": t.contains("sign"), "with_c": t.contains("c")})


def _holed(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 == 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))


@query("agg03_missing_rates", "SELECT 'price' AS \"column\", round(avg((o_orderkey % 3 = 0)::INT), 6) AS missing_rate, true AS kept FROM orders UNION ALL SELECT 'status', round(avg((o_orderkey % 5 <> 0)::INT), 6), false FROM orders UNION ALL SELECT 'priority', 0.0, true")
def missing_rates(spark, sf_dir):
    return A.missing_rates(_holed(spark, sf_dir), ["price", "status", "priority"]).select("column", F.round("missing_rate", 6).alias("missing_rate"), (F.col("missing_rate") <= 0.5).alias("kept"))


@query("agg04_value_counts", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("agg04_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return A.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg05_all_null", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def all_null(spark, sf_dir):
    return _holed(spark, sf_dir).filter(A.all_null("price", "status")).select("o_orderkey")


@query("agg06_summary", "WITH m AS (SELECT o_orderstatus, unnest(['even', 'price']) AS metric, unnest([CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, o_totalprice]) AS value FROM orders) SELECT o_orderstatus, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS lowest, max(value) AS highest, count(value) AS n_valid FROM m GROUP BY ALL")
def summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("even"))
    return A.summarised(o, ["o_orderstatus"], ["price", "even"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("agg07_confusion", "WITH g AS (SELECT a.x AS truth, b.x AS predicted FROM (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x)), n AS (SELECT truth, predicted, count(*) AS n FROM (SELECT least(2, quality + doc_id % 2) AS truth, toxic AS predicted FROM labels) GROUP BY ALL), m AS (SELECT truth, predicted, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (truth, predicted)) SELECT truth, predicted, n, round(CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN n / sum(n) OVER (PARTITION BY truth) ELSE 0 END, 6) AS share FROM m")
def confusion(spark, sf_dir):
    y = table(spark, sf_dir, "labels").select(F.least(F.lit(2), F.col("quality") + F.col("doc_id") % 2).cast("int").alias("t"), F.col("toxic").cast("int").alias("p"))
    return A.confusion(y, "t", "p", [0, 1, 2]).withColumn("share", F.round("share", 6))


SPLITS = "WITH s AS (SELECT split, doc_id, quality, row_number() OVER (PARTITION BY split, quality ORDER BY md5(concat_ws('|', '42', split::VARCHAR, doc_id::VARCHAR)), doc_id) AS place, count(*) OVER (PARTITION BY split, quality) AS n FROM labels, (SELECT unnest(range(5))::INT AS split)), splits AS (SELECT split, doc_id, quality, (place <= round(n * 0.2))::INT AS role FROM s)"


@query("agg08_class_balance", f"{SPLITS} SELECT split, role, quality, count(*) AS n FROM splits GROUP BY ALL")
def class_balance(spark, sf_dir):
    return R.class_balance(R.stratified_splits(table(spark, sf_dir, "labels"), "doc_id", "quality", 5), "quality")


@query("agg09_selection_frequency", "SELECT l_partkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def selection_frequency(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = li.groupBy("l_partkey").agg(F.countDistinct("l_linenumber").alias("n"))
    return n.join(sets.in_every(li, "l_partkey", "l_linenumber"), "l_partkey", "left_semi")


@query("agg10_majority", "SELECT o_custkey, arg_max(k, n * 1000 - k) AS k, max(n) AS votes FROM (SELECT o_custkey, (o_orderkey % 3)::INT AS k, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def majority(spark, sf_dir):
    return A.majority(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).cast("int").alias("k")), ["o_custkey"], "k")


@query("agg11_baselines", "SELECT c.c AS constant, round(avg((quality = c.c)::INT), 6) AS accuracy, c.c = (SELECT arg_max(quality, n * 10 - quality) FROM (SELECT quality, count(*) n FROM labels GROUP BY 1)) AS is_majority FROM labels, (VALUES (0), (1)) c(c) GROUP BY c.c")
def baselines(spark, sf_dir):
    y = table(spark, sf_dir, "labels")
    top = F.broadcast(A.majority(y, [], "quality").select(F.col("quality").alias("top")))
    c = spark.createDataFrame([(0,), (1,)], "constant int")
    return y.crossJoin(F.broadcast(c)).groupBy("constant").agg(F.round(F.avg((F.col("quality") == F.col("constant")).cast("int")), 6).alias("accuracy")).crossJoin(top).select("constant", "accuracy", (F.col("constant") == F.col("top")).alias("is_majority"))


@query("agg12_agreement", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, NULL::DOUBLE AS flat, round(avg((l_quantity > 25 AND l_discount <= 0.05 OR l_quantity <= 25 AND l_discount > 0.05)::INT), 6) AS disagreement FROM lineitem GROUP BY l_returnflag")
def agreement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    return li.groupBy("l_returnflag").agg(F.round(A.pearson("l_quantity", "l_extendedprice"), 6).alias("r"), A.pearson("l_quantity", "one").alias("flat"), F.round(F.avg(((F.col("l_quantity") > 25) != (F.col("l_discount") > 0.05)).cast("int")), 6).alias("disagreement"))


@query("agg13_percentiles", "SELECT event_type, round(quantile_cont(value, 0.33), 6) AS p33, round(quantile_cont(value, 0.67), 6) AS p67, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.33), 6).alias("p33"), F.round(F.percentile("value", 0.67), 6).alias("p67"), F.round(F.median("value"), 6).alias("middle"))


@query("agg14_histogram", "WITH e AS (SELECT min(value) lo, max(value) hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", 20)


@query("agg15_seed_ensemble", "SELECT user_id, round(avg(value), 6) AS mean, round(avg((value > 50)::INT), 6) AS agreement, (sum((value > 50)::INT) * 2 > count(*))::INT AS vote FROM events GROUP BY user_id")
def seed_ensemble(spark, sf_dir):
    high = (F.col("value") > 50).cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(high), 6).alias("agreement"), (F.sum(high) * 2 > F.count("*")).cast("int").alias("vote"))


@query("win03_average_ranks", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0::DOUBLE AS rank FROM events")
def average_ranks(spark, sf_dir):
    return O.average_ranks(table(spark, sf_dir, "events"), F.floor("value"), ("event_type",)).select("event_id", "rank")


@query("win06_fold_index", "SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN row_number() OVER (PARTITION BY user_id % 3 <> 0 ORDER BY user_id) - 1 ELSE -1 END AS fold FROM (SELECT DISTINCT user_id FROM events)")
def fold_index(spark, sf_dir):
    return R.fold_index(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id", F.col("user_id") % 3 != 0)


@query("win07_cumulative", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY value, event_id), 6) AS so_far, round(sum(value) OVER (PARTITION BY user_id ORDER BY value, event_id) / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def cumulative(spark, sf_dir):
    by = Window.partitionBy("user_id")
    so_far = F.sum("value").over(by.orderBy("value", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.round(so_far, 6).alias("so_far"), F.round(so_far / F.sum("value").over(by), 6).alias("share"))


@query("win08_midpoints", "SELECT user_id, round((value + next) / 2, 6) AS midpoint FROM (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS next FROM (SELECT DISTINCT user_id, value FROM events)) WHERE next IS NOT NULL")
def midpoints(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("user_id", "value").distinct()
    return v.withColumn("next", F.lead("value").over(Window.partitionBy("user_id").orderBy("value"))).filter("next is not null").select("user_id", F.round((F.col("value") + F.col("next")) / 2, 6).alias("midpoint"))


@query("win09_right_tail_logsumexp", "SELECT event_id, round(m + ln(sum(exp(value / 100 - m)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS tail FROM (SELECT *, max(value / 100) OVER (PARTITION BY user_id) AS m FROM events)")
def right_tail_logsumexp(spark, sf_dir):
    by = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("m", F.max(F.col("value") / 100).over(by))
    tail = F.sum(F.exp(F.col("value") / 100 - F.col("m"))).over(by.orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing))
    return e.select("event_id", F.round(F.col("m") + F.log(tail), 6).alias("tail"))


@query("set01_union", "SELECT 'order' AS arm, o_orderkey AS id, o_totalprice AS value FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("arm"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("arm"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return A.union_all([o, c])


@query("set02_set_f1", "WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (event_id % 17 = 0) AS a, list(DISTINCT event_type) FILTER (event_id % 19 = 0) AS b FROM events GROUP BY user_id), n AS (SELECT user_id, coalesce(len(a), 0) AS a, coalesce(len(b), 0) AS b, coalesce(len(list_intersect(a, b)), 0) AS common FROM s) SELECT user_id, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (a + b) END::DOUBLE, 6) AS f1 FROM n")
def set_f1(spark, sf_dir):
    pick = lambda k: F.collect_set(F.when(F.col("event_id") % k == 0, F.col("event_type")))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(pick(17).alias("a"), pick(19).alias("b"))
    return s.select("user_id", F.round(sets.set_f1("a", "b"), 6).alias("f1"))


@query("set03_in_every_fold", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def in_every_fold(spark, sf_dir):
    return sets.in_every(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("set04_shared_columns", "SELECT 'value' AS name, 0 AS views WHERE false")
def shared_columns(spark, sf_dir):
    views = {"orders": table(spark, sf_dir, "orders").columns, "customer": table(spark, sf_dir, "customer").columns, "part": table(spark, sf_dir, "part").columns}
    sets.assert_disjoint(**views)
    rows = [(c, v) for v, cs in views.items() for c in cs]
    return spark.createDataFrame(rows, "name string, view string").groupBy("name").agg(F.countDistinct("view").cast("int").alias("views")).filter("views > 1")


PRICED = "t AS (SELECT l_quantity AS quantity, l_tax AS tax, l_discount AS discount, l_quantity + 0 AS again, CASE WHEN l_discount >= 0 THEN l_discount END AS target FROM lineitem)"


@query("set04_equal_columns", f"WITH {PRICED} SELECT a, b, differ::BIGINT AS differ, differ = 0 AS duplicate, differ = 0 AND b = 'target' AS leak FROM (SELECT unnest(['quantity', 'quantity', 'quantity', 'quantity', 'tax', 'tax', 'tax', 'discount', 'discount', 'again']) AS a, unnest(['tax', 'discount', 'again', 'target', 'discount', 'again', 'target', 'again', 'target', 'target']) AS b, unnest([sum((quantity <> tax)::INT), sum((quantity <> discount)::INT), sum((quantity <> again)::INT), sum((quantity <> target)::INT), sum((tax <> discount)::INT), sum((tax <> again)::INT), sum((tax <> target)::INT), sum((discount <> again)::INT), sum((discount <> target)::INT), sum((again <> target)::INT)]) AS differ FROM t)")
def equal_columns(spark, sf_dir):
    """No feature twice and no target among them, by the columns' values in all rows."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    t = table(spark, sf_dir, "lineitem").select(q.alias("quantity"), F.col("l_tax").alias("tax"), d.alias("discount"), (q + 0).alias("again"), F.when(d >= 0, d).alias("target"))
    return sets.equal_columns(t, t.columns, "target")


@query("spl02_left_out_sums", "SELECT c_nationkey AS held_out, any_value(n) - count(*) AS n, round(any_value(s) - sum(c_acctbal), 4) AS c_acctbal FROM customer, (SELECT count(*) AS n, sum(c_acctbal) AS s FROM customer) GROUP BY c_nationkey UNION ALL SELECT -c_custkey, any_value(n) - count(*), round(any_value(s) - sum(c_acctbal), 4) FROM customer, (SELECT count(*) AS n, sum(c_acctbal) AS s FROM customer) GROUP BY c_custkey")
def left_out_sums(spark, sf_dir):
    """Leave one nation out, and leave one customer out, over the whole table."""
    c = table(spark, sf_dir, "customer")
    one = R.left_out_sums(c.withColumn("own", -F.col("c_custkey")), "own", ["c_acctbal"])
    both = R.left_out_sums(c, "c_nationkey", ["c_acctbal"]).unionByName(one)
    return both.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("spl01_stratified_split", f"{SPLITS} SELECT split, doc_id, quality, role FROM splits")
def stratified_split(spark, sf_dir):
    return R.stratified_splits(table(spark, sf_dir, "labels"), "doc_id", "quality", 5)


@query("spl02_leave_one_out", "SELECT h.k AS held_out, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation, (SELECT DISTINCT n_nationkey AS k FROM nation) h WHERE n_nationkey <> h.k GROUP BY h.k")
def leave_one_out(spark, sf_dir):
    return R.leave_one_out(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("held_out").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))


@query("spl03_contiguous_folds", "SELECT doc_id, least(floor((row_number() OVER (ORDER BY doc_id) - 1) / floor(count(*) OVER () / 3.0)), 2)::INT AS fold FROM labels")
def contiguous_folds(spark, sf_dir):
    return R.contiguous_folds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("spl04_stratified_folds", "SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR)), doc_id) - 1) % 3)::INT AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    return R.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("spl06_subsample", "SELECT event_id FROM events ORDER BY md5(concat_ws('|', '42', event_id::VARCHAR)), event_id LIMIT 500")
def subsample(spark, sf_dir):
    return R.subsample(table(spark, sf_dir, "events"), "event_id", 500).select("event_id")


@query("spl07_determinism")
def determinism(spark, sf_dir):
    """The stratified splits made twice, from differently partitioned rows: their digests agree."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return R.run_twice(lambda n: R.stratified_splits(labels.repartition(n), "doc_id", "quality", 5))
