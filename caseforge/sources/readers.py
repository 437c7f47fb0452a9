"""Readers and writers of case files, job dumps, configurations, vectors and model bundles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOBS = "pk string, inputs array<struct<socket:struct<slug:string,relative_path:string>,value:string>>, outputs array<struct<socket:struct<slug:string,relative_path:string>>>"


def case_files(spark: SparkSession, root: str, file: str, schema: str | T.DataType) -> DataFrame:
    """``case_id, doc`` for each ``root/<case>/file``; a file that isn't the schema's JSON gives a null doc."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file).text(root, wholetext=True)
    case = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    # A bare JSON string is no struct: it is read as the field of one.
    bare = F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x")
    doc = bare if schema == "string" else F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return raw.select(case.alias("case_id"), doc.alias("doc"))


def case_table(spark: SparkSession, root: str, files: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per case with a column per kind of file; a missing file gives null. ``files``: column -> (file, schema)."""
    out = None
    for column, (file, schema) in files.items():
        part = case_files(spark, root, file, schema).withColumnRenamed("doc", column)
        out = part if out is None else out.join(part, "case_id", "full")
    return out


def csv_table(spark: SparkSession, path: str, schema: str, nulls: str = "default") -> DataFrame:
    """``default``: empty is null; ``strict``: only empty and ``NA``; ``coerce``: all read as text, then cast where it fits."""
    read = spark.read.option("header", True)
    if nulls == "default":
        return read.schema(schema).csv(path)
    fields = T.StructType.fromDDL(schema).fields
    text = read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields])).csv(path)
    empty = lambda c: F.when(~F.col(c).isin("", "NA") if nulls == "strict" else F.col(c) != "", F.col(c))
    return text.select(*(empty(f.name).try_cast(f.dataType).alias(f.name) for f in fields))


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_bundle(path: str, config: dict, **tables: DataFrame) -> None:
    """A model: its tables as Parquet and its parameters as JSON."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_config(spark, f"{path}/config", config | {"tables": sorted(tables)})


def load_bundle(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    config = read_config(spark, f"{path}/config")
    return config, {t: spark.read.parquet(f"{path}/{t}") for t in config["tables"]}


def interface_key(slugs: Column) -> Column:
    return F.concat_ws("|", F.array_sort(slugs))


def jobs(spark: SparkSession, path: str, routes: dict[str, str], lines: bool = False) -> DataFrame:
    """``pk, task, inputs, outputs`` of a job dump, one JSON array a file or a job a line; the sorted input slugs name the task, jobs of no task go."""
    j = spark.read.schema(JOBS).option("multiLine", not lines).json(path)
    j = j.withColumn("key", interface_key(F.transform("inputs", lambda i: i["socket"]["slug"])))
    names = F.broadcast(spark.createDataFrame(list(routes.items()), "key string, task string"))
    return j.join(names, "key").drop("key")


def input_value(inputs: str, slugs: list[str]) -> Column:
    """The value of the first of several spellings of a slug that a job has."""

    def value_of(slug: str) -> Column:
        return F.get(F.transform(F.filter(inputs, lambda i: i["socket"]["slug"] == slug), lambda i: i["value"]), 0)

    return F.coalesce(*(value_of(s) for s in slugs))


def ground_truth(spark: SparkSession, root: str, decision_file: str, reasoning_file: str, reasoning_schema: str) -> DataFrame:
    """One flat record per case that has both files."""
    d = case_files(spark, root, decision_file, "string").select("case_id", F.col("doc").alias("decision"))
    r = case_files(spark, root, reasoning_file, reasoning_schema).filter("doc is not null").select("case_id", "doc.*")
    return d.filter("decision is not null").join(r, "case_id")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    have = set(df.columns)
    df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def single_case(spark: SparkSession, path: str, aliases: dict[str, list[str]], schema: str) -> DataFrame:
    """One case in any dialect: for each name the first of its aliases that the file has."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    have = set(raw.columns)
    return raw.select(*(F.coalesce(*(F.col(a) for a in names if a in have), F.lit(None)).alias(n) for n, names in aliases.items()))


def first_vector(x: Column) -> Column:
    """A list of numbers, or the first of a list of lists, from JSON text."""
    return F.when(x.rlike(r"^\s*\[\s*\["), F.get(F.from_json(x, "array<array<double>>"), 0)).otherwise(F.from_json(x, "array<double>"))
