"""Queries that write given tables as files of a run and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, readers
from .registry import query, table

LABELLED = "d AS (SELECT d.doc_id, text, lang, quality FROM documents d JOIN labels USING (doc_id))"


def _cases(spark, sf_dir) -> str:
    """Labelled documents as case directories: a note, a decision that every fifth lacks, and reasoning that every seventh has broken; returns the folder."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    note = F.to_json(F.struct("lang", F.octet_length("text").alias("bytes"), F.substring("text", 1, 40).alias("start")))
    decision = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("quality") == 1, '"yes"').otherwise('"no"'))
    reasoning = F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("quality").alias("confidence"), F.lit("plain").alias("kind"))))
    entry = F.explode(F.array(*(F.struct(F.lit(f).alias("file"), t.alias("text")) for f, t in (("note.json", note), ("decision.json", decision), ("reasoning.json", reasoning)))))
    rows = d.select(F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"), entry.alias("f")).select("case_id", "f.file", "f.text")
    folder = files.run_folder(spark, "cases")
    files.write_cases(rows, folder)
    return folder


@query("src01_case_source", f"WITH {LABELLED} SELECT 'case-' || doc_id AS case_id, lang, strlen(text) AS bytes, CASE WHEN doc_id % 5 <> 0 THEN CASE quality WHEN 1 THEN 'yes' ELSE 'no' END END AS decision FROM d")
def case_source(spark, sf_dir):
    t = files.case_table(spark, _cases(spark, sf_dir), {"note": ("note.json", "lang string, bytes long"), "decision": ("decision.json", "string")})
    return t.select("case_id", "note.lang", "note.bytes", "decision")


@query("src02_csv_policies", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN round(o_totalprice, 2) END AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'NA' WHEN o_orderkey % 4 = 2 THEN 'n/a' ELSE o_orderstatus END AS coerced, CASE WHEN o_orderkey % 4 IN (0, 1) THEN NULL WHEN o_orderkey % 4 = 2 THEN 'n/a' ELSE o_orderstatus END AS strict FROM orders")
def csv_policies(spark, sf_dir):
    """The same file under two null policies; a price that is no number is null under either."""
    k = F.col("o_orderkey")
    holed = lambda x: F.when(k % 4 == 0, "").when(k % 4 == 1, "NA").when(k % 4 == 2, "n/a").otherwise(x)
    folder = files.run_folder(spark, "csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", holed(F.round("o_totalprice", 2).cast("string")).alias("price"), holed(F.col("o_orderstatus")).alias("status"))
    readers.write_csv(o, folder, ["o_orderkey", "price", "status"])
    read = lambda policy: readers.csv_table(spark, folder, "o_orderkey long, price double, status string", policy)
    return read("coerce").withColumnRenamed("status", "coerced").join(read("strict").select("o_orderkey", F.col("status").alias("strict")), "o_orderkey")


@query("src03_config_round_trip", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_mktsegment")
def config_round_trip(spark, sf_dir):
    """A table's summary kept as a configuration and read again."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    folder = files.run_folder(spark, "config")
    readers.write_config(spark, folder, {"segments": {r["c_mktsegment"]: {"n": r["n"], "mean": r["mean"]} for r in c.collect()}})
    got = readers.read_config(spark, folder)["segments"]
    return spark.createDataFrame([(k, v["n"], v["mean"]) for k, v in got.items()], "segment string, n long, mean double")


@query("src04_array_shards", "SELECT vec_id AS id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def array_shards(spark, sf_dir):
    folder = files.run_folder(spark, "arrays")
    files.save_arrays(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), folder)
    return files.load_arrays(spark, folder).select("id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("src06_job_dump", "SELECT 'job-' || o_orderkey AS pk, CASE o_orderkey % 3 WHEN 0 THEN 'single' ELSE 'both' END AS task, 'V' || o_custkey AS value FROM orders WHERE o_orderkey % 3 <> 2")
def job_dump(spark, sf_dir):
    """Orders as a dump of jobs: the sorted slugs of a job's inputs name its task, those of no task go; a slug has two spellings."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, slug = F.col("o_orderkey"), lambda s, v: F.struct(F.struct(s.alias("slug"), F.lit("x.json").alias("relative_path")).alias("socket"), v.alias("value"))
    first = slug(F.when(k % 2 == 0, "report").otherwise("the-report"), F.concat(F.lit("V"), F.col("o_custkey").cast("string")))
    inputs = F.when(k % 3 == 0, F.array(first)).when(k % 3 == 1, F.array(slug(F.lit("image"), F.lit("i")), first)).otherwise(F.array(slug(F.lit("other"), F.lit("o"))))
    folder = files.run_folder(spark, "jobs")
    o.select(F.concat(F.lit("job-"), k.cast("string")).alias("pk"), inputs.alias("inputs")).write.json(folder)
    routes = {"report": "single", "the-report": "single", "image|report": "both", "image|the-report": "both"}
    return readers.jobs(spark, folder, routes, lines=True).select("pk", "task", readers.input_value("inputs", ["report", "the-report"]).alias("value"))


@query("src07_ground_truth_files", f"WITH {LABELLED} SELECT 'case-' || doc_id AS case_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS decision, quality AS confidence FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def ground_truth_files(spark, sf_dir):
    t = files.case_table(spark, _cases(spark, sf_dir), {"decision": ("decision.json", "string"), "reasoning": ("reasoning.json", "confidence int")})
    return t.filter("decision is not null and reasoning.confidence is not null").select("case_id", "decision", "reasoning.confidence")


@query("src09_file_manifest", "SELECT doc_id || '/text.txt' AS path, strlen(text) AS length, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def file_manifest(spark, sf_dir):
    folder = files.run_folder(spark, "texts")
    files.write_cases(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("text.txt").alias("file"), "text"), folder)
    return files.manifest(spark, folder)
