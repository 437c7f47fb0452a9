"""Queries over the column functions, on event, document and order rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import query, table

#: A messy text per event; the same SQL in both engines.
RAW = """CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NONE' WHEN 3 THEN 'Not reported' WHEN 4 THEN cast(user_id AS string)
 WHEN 5 THEN concat(cast(user_id AS string), '/', cast(event_id % 90 AS string), ' mmHg') WHEN 6 THEN concat(cast(user_id AS string), ' kg') WHEN 7 THEN concat('-', cast(user_id AS string))
 WHEN 8 THEN concat('-', cast(user_id AS string), '.5') ELSE concat('about ', cast(user_id AS string), '.25 units') END"""
SMOKING = "CASE event_id % 6 WHEN 0 THEN 'Ex-smoker, 20 pack years' WHEN 1 THEN 'Current smoker' WHEN 2 THEN 'Never smoked' WHEN 3 THEN 'Non-smoker' WHEN 4 THEN NULL ELSE event_type END"
DECISION = "CASE event_id % 6 WHEN 0 THEN ' Active-Surveillance ' WHEN 1 THEN 'RADICAL  prostatectomy' WHEN 2 THEN 'radiotherapy' WHEN 3 THEN NULL WHEN 4 THEN 'watch' ELSE 'active surveillance' END"
LEVEL = "CASE event_id % 7 WHEN 0 THEN 'Decisive' WHEN 1 THEN ' important ' WHEN 2 THEN 'noted' WHEN 3 THEN 'not_revealed' WHEN 4 THEN 'not_used' WHEN 5 THEN 'unknown' ELSE NULL END"
ALLOWED = ("active_surveillance", "radical_prostatectomy", "radiotherapy")


def _events(spark, sf_dir, *more):
    return table(spark, sf_dir, "events").select("*", *(F.expr(e).alias(n) for n, e in more))


@query("sca01_safe_float", f"SELECT event_id, CASE WHEN raw IN ('', 'NONE', 'Not reported') THEN NULL ELSE try_cast(raw AS DOUBLE) END AS safe, CASE WHEN raw IN ('', 'NONE', 'Not reported') THEN NULL ELSE coalesce(try_cast(raw AS DOUBLE), try_cast(nullif(regexp_extract(raw, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE)) END AS serving FROM (SELECT event_id, {RAW} AS raw FROM events)")
def safe_float(spark, sf_dir):
    return _events(spark, sf_dir, ("raw", RAW)).select("event_id", S.safe_float("raw").alias("safe"), S.safe_float_or_digits("raw").alias("serving"))


@query("sca02_safe_int", f"SELECT event_id, trunc(CASE WHEN raw IN ('', 'NONE', 'Not reported') THEN NULL ELSE try_cast(raw AS DOUBLE) END) AS whole FROM (SELECT event_id, {RAW} AS raw FROM events)")
def safe_int(spark, sf_dir):
    return _events(spark, sf_dir, ("raw", RAW)).select("event_id", S.safe_int("raw").alias("whole"))


@query("sca03_extract_number", f"SELECT event_id, try_cast(nullif(regexp_extract(raw, '[-+]?\\d*\\.\\d+|\\d+', 0), '') AS DOUBLE) AS number FROM (SELECT event_id, {RAW} AS raw FROM events)")
def extract_number(spark, sf_dir):
    return _events(spark, sf_dir, ("raw", RAW)).select("event_id", S.extract_number("raw").alias("number"))


@query("sca04_blood_pressure", f"SELECT event_id, CASE WHEN len(n) >= 2 THEN try_cast(n[1] AS DOUBLE) END AS systolic, CASE WHEN len(n) >= 2 THEN try_cast(n[2] AS DOUBLE) END AS diastolic FROM (SELECT event_id, regexp_extract_all({RAW}, '(\\d+)', 1) AS n FROM events)")
def blood_pressure(spark, sf_dir):
    return _events(spark, sf_dir, ("raw", RAW)).withColumn("bp", S.blood_pressure("raw")).select("event_id", "bp.systolic", "bp.diastolic")


@query("sca05_status_case", f"SELECT event_id, CASE WHEN contains(s, 'Ex-smoker') THEN 'Ex-smoker' WHEN contains(s, 'Current') THEN 'Current' WHEN contains(s, 'Never') OR contains(s, 'Non-smoker') THEN 'Never' ELSE s END AS status FROM (SELECT event_id, {SMOKING} AS s FROM events)")
def status_case(spark, sf_dir):
    return _events(spark, sf_dir, ("s", SMOKING)).select("event_id", S.smoking_status("s").alias("status"))


@query("sca06_coded", f"SELECT event_id, CASE lower(trim(s)) WHEN 'not_used' THEN 0 WHEN 'noted' THEN 1 WHEN 'important' THEN 2 WHEN 'decisive' THEN 3 ELSE 0 END AS code, CASE WHEN lower(trim(s)) = 'not_revealed' THEN 'not_used' WHEN lower(trim(s)) IN ('not_used', 'noted', 'important', 'decisive') THEN lower(trim(s)) END AS level FROM (SELECT event_id, {LEVEL} AS s FROM events)")
def coded(spark, sf_dir):
    return _events(spark, sf_dir, ("s", LEVEL)).select("event_id", S.coded("s", S.WEIGHT, 0).alias("code"), S.weight_name("s").alias("level"))


@query("sca07_decision", f"SELECT event_id, CASE WHEN d IN {ALLOWED} THEN d END AS decision FROM (SELECT event_id, regexp_replace(replace(lower(trim({DECISION})), '-', '_'), '\\s+', '_', 'g') AS d FROM events)")
def decision(spark, sf_dir):
    return _events(spark, sf_dir, ("s", DECISION)).select("event_id", S.decision("s", ALLOWED).alias("decision"))


@query("sca08_json_path", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_path(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("sca09_alias_first", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN cast(user_id AS DOUBLE) END, -1.0) AS value FROM events")
def alias_first(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("double")), F.lit(-1.0)).alias("value"))


@query("sca10_size_or_zero", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN len(string_split(text, ' ')) ELSE 0 END AS n FROM conversations")
def size_or_zero(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.size_or_zero(F.when(F.col("turn") % 2 == 0, F.split("text", " "))).cast("long").alias("n"))


@query("sca11_joined_text", "SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN concat('order ', cast(o_orderkey AS VARCHAR)) END], lambda x: x IS NOT NULL AND x <> ''), ' | ') AS line FROM orders")
def joined_text(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", S.joined(" | ", F.col("o_orderstatus"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.when(k % 2 == 0, F.concat(F.lit("order "), k.cast("string")))).alias("line"))


@query("sca12_prefix_projection", "SELECT l_orderkey, l_shipdate, l_suppkey FROM lineitem")
def prefix_projection(spark, sf_dir):
    return S.with_prefixes(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_ship", "l_supp", expect=2)


@query("sca13_eligibility", "SELECT CASE WHEN user_id % 11 = 0 THEN 'excluded_missing_mri' WHEN user_id % 7 = 0 THEN 'excluded_missing_pirads' WHEN event_type = 'error' THEN 'unlabeled_test' ELSE 'usable_labeled' END AS status, count(*) AS n FROM events GROUP BY 1")
def eligibility(spark, sf_dir):
    u = F.col("user_id")
    return _events(spark, sf_dir).groupBy(S.eligibility(u % 11 != 0, u % 7 != 0, F.col("event_type") != "error").alias("status")).agg(F.count("*").alias("n"))


@query("sca14_guarded_ratio", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def guarded_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.guarded_ratio("l_tax", "l_discount"), 6).alias("ratio"))


def _sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _lemma_sql(w: str) -> str:
    """The lemma of ``w`` in DuckDB, from the same dictionary and rules."""
    keys = ", ".join(f"'{x}'" for x in S.IRREGULAR)
    rules = ""
    for pattern, put in S.SUFFIXES:
        cut = f"regexp_replace({w}, '{pattern}', '{put}')"
        rules += f" WHEN regexp_matches({w}, '{pattern}') THEN " + (f"regexp_replace({cut}, '(.) $', '')" if put.endswith(" ") else cut)
    return f"CASE WHEN {w} IN {_sql_list(S.NEGATIONS)} THEN {w} WHEN {w} IN ({keys}) THEN MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in S.IRREGULAR.items())}}}[{w}]{rules} ELSE {w} END"


@query("sca15_clean_tokens", f"SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: w NOT IN {_sql_list(w for w in (*S.STOPWORDS, *S.NUMBER_WORDS) if w not in S.NEGATIONS)}), lambda w: {_lemma_sql('w')}), lambda w: length(w) > 1 AND NOT regexp_matches(w, '\\d')), ' ') AS cleaned FROM documents")
def clean_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.clean_tokens("text"), " ").alias("cleaned"))


@query("sca16_clean_tokens_serving", f"SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\\d+', '', 'g'), '[^a-z\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 OR w IN {_sql_list(S.NEGATIONS)}), ' ') AS cleaned FROM documents")
def clean_tokens_serving(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.clean_tokens_serving("text"), " ").alias("cleaned"))


@query("sca17_l2_normalised", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / (n + 1e-12) * (x / (n + 1e-12)))), 6) AS squared, round(v[1] / (n + 1e-12), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def l2_normalised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.l2_normalised(F.col("embedding").cast("array<double>")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"), F.round(F.get("u", 0), 6).alias("first"))


@query("sca18_clip_and_round", "SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS clipped, cast(greatest(0, least(2, floor(value / 40 + 0.5))) AS INTEGER) AS class FROM events")
def clip_and_round(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.clip01(F.col("value") / 100).alias("clipped"), S.nearest_class(F.col("value") / 40).alias("class"))


@query("sca19_thresholds", "SELECT event_id, (value >= 10)::INT + (value >= 40)::INT + (value >= 90)::INT AS up, 2 - (value >= 10)::INT - (value >= 40)::INT AS down FROM events")
def thresholds(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.by_thresholds("value", 10, 40, 90).alias("up"), S.by_thresholds("value", 10, 40, descending=True).alias("down"))


@query("sca20_p_gate", "SELECT event_id, CASE WHEN (event_id % 100) / 100.0::DOUBLE >= 0.05 THEN 0 ELSE (value >= 40)::INT + 1 END AS class FROM events")
def p_gate(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.p_gated(S.by_thresholds("value", 40) + 1, (F.col("event_id") % 100) / 100.0).alias("class"))


@query("sca21_reveal_list", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN greatest(o_orderkey % 4, o_orderkey % 3) >= 1 THEN 'radiology_report' END, CASE WHEN o_orderkey % 5 >= 1 THEN 'psa_trend' END, CASE WHEN o_orderkey % 2 >= 1 THEN 'laboratory_results' END, CASE WHEN o_orderkey % 7 >= 1 THEN 'previous_notes' END, CASE WHEN o_orderkey % 6 >= 2 THEN 'vitals' END], lambda x: x IS NOT NULL), ',') AS sections FROM orders")
def reveal_list(spark, sf_dir):
    k = F.col("o_orderkey")
    w = {"pirads": k % 4, "psad": k % 3, "psav": k % 5, "psap": k % 2, "months": k % 7, "age": k % 6}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(S.reveal_list(w), ",").alias("sections"))


@query("sca22_ordered_distinct", "WITH l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS kinds FROM l")
def ordered_distinct(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    return e.select("user_id", F.array_join(S.ordered_distinct(F.transform("l", lambda x: x["event_type"])), ",").alias("kinds"))


@query("sca23_validated", f"SELECT event_id, d IS NOT NULL AND event_id % 9 <> 0 AS ok, CASE WHEN d IS NULL THEN 'invalid decision' WHEN event_id % 9 = 0 THEN 'variable_weights must be an object' ELSE 'ok' END AS reason FROM (SELECT event_id, CASE WHEN d IN {ALLOWED} THEN d END AS d FROM (SELECT event_id, regexp_replace(replace(lower(trim({DECISION})), '-', '_'), '\\s+', '_', 'g') AS d FROM events))")
def validated(spark, sf_dir):
    e = _events(spark, sf_dir, ("s", DECISION))
    return e.select("event_id", S.validated("treatment", S.decision("s", ALLOWED), F.col("event_id") % 9 != 0).alias("v")).select("event_id", "v.ok", "v.reason")


@query("sca24_label_encodings", "SELECT doc_id, (quality * 0.9 + 0.05)::DOUBLE AS smoothed, round(sqrt(1 - (quality * 0.9 + 0.05)), 6) AS amp_no, round(sqrt(quality * 0.9 + 0.05), 6) AS amp_yes FROM labels")
def label_encodings(spark, sf_dir):
    y = table(spark, sf_dir, "labels").withColumn("smoothed", S.smoothed_label("quality", 0.1)).withColumn("a", S.amplitudes("smoothed"))
    return y.select("doc_id", "smoothed", F.round(F.get("a", 0), 6).alias("amp_no"), F.round(F.get("a", 1), 6).alias("amp_yes"))


@query("sca25_soft_target", "SELECT doc_id, CASE WHEN quality = 1 THEN 0.5 + 0.5 * c ELSE 0.5 - 0.5 * c END AS target FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS c FROM labels)")
def soft_target(spark, sf_dir):
    c = F.when(F.col("doc_id") % 3 == 0, 1.0).when(F.col("doc_id") % 3 == 1, 0.5).otherwise(0.25)
    return table(spark, sf_dir, "labels").select("doc_id", S.soft_target("quality", c).alias("target"))
