"""Readers of sequences, gene lists, lock files, sidecars and documents, and a scan of a project folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import EngineError, dedupe_first, with_ordinal

SIDECAR = T.StructType([
    T.StructField("artifact", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("output_sha256", T.StringType()), T.StructField("stamped_at", T.StringType()),
    T.StructField("fetched_at", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("data_version", T.StringType()),
    T.StructField("tool_version", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("inputs", T.MapType(T.StringType(), T.StringType())),
])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence, length of each record; line breaks in sequences are dropped. A record is a row, so sizes add up across executors."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return records.select(head.alias("header"), seq.alias("sequence")).withColumn("length", F.length("sequence"))


def read_gene_list(spark: SparkSession, path: str, format: str = "auto", column: str | None = None) -> DataFrame:
    """gene: a symbol per line (# starts a comment), or a column of a TSV or CSV. auto: a tab in the first line means TSV."""
    if format == "auto":
        first = spark.read.text(path).limit(1).collect()
        format = "tsv" if first and "\t" in first[0]["value"] else "text"
    if format == "text":
        rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("gene"))
    elif format in ("tsv", "csv"):
        rows = spark.read.csv(path, sep="\t" if format == "tsv" else ",", header=True)
        rows = rows.select(F.trim(F.col(f"`{column or rows.columns[0]}`")).alias("gene"))
    else:
        raise EngineError("read_gene_list", f"unknown format: {format}")
    return dedupe_first(with_ordinal(rows.where("gene <> ''")), ["gene"], ["ordinal"]).drop("ordinal")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_lockfiles(spark: SparkSession, path: str) -> DataFrame:
    """path, ecosystem, package, version of pinned packages in requirements, renv, conda and pyproject files below path."""
    files = _files(spark, path, "*")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    lines = files.where(name.rlike(r"^requirements.*\.txt$")).select("path", F.explode(F.split("value", r"\r?\n")).alias("l"))
    req = lines.select("path", F.lit("pip").alias("ecosystem"), F.regexp_extract("l", r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", 1).alias("package"), F.regexp_extract("l", r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#]+)", 2).alias("version"))
    packages = F.from_json(F.get_json_object("value", "$.Packages"), "map<string, struct<Package string, Version string>>")
    renv = files.where(name == "renv.lock").select("path", F.explode(F.map_values(packages)).alias("p")).select("path", F.lit("renv").alias("ecosystem"), F.col("p.Package").alias("package"), F.col("p.Version").alias("version"))
    conda_line = r"^\s*-\s*(?:[\w.-]+::)?([A-Za-z0-9._-]+)\s*=+\s*([^\s=#]+)"
    conda = files.where(name.rlike(r"^environment.*\.ya?ml$")).select("path", F.explode(F.split("value", r"\r?\n")).alias("l"))
    conda = conda.select("path", F.lit("conda").alias("ecosystem"), F.regexp_extract("l", conda_line, 1).alias("package"), F.regexp_extract("l", conda_line, 2).alias("version"))
    spec = r'"([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*[=~><!]=\s*([^",;\s]+)[^"]*"'
    project = files.where(name == "pyproject.toml").select("path", F.explode(F.regexp_extract_all("value", F.lit(spec), F.lit(0))).alias("l"))
    project = project.select("path", F.lit("pyproject").alias("ecosystem"), F.regexp_extract("l", spec, 1).alias("package"), F.regexp_extract("l", spec, 2).alias("version"))
    return req.unionByName(renv).unionByName(conda).unionByName(project).where("package <> '' AND version <> ''").distinct()


def read_sidecars(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """Sidecars (*.meta.json) below path: either name of the hash is read; hidden folders and deeper ones are skipped."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("multiLine", True).schema(SIDECAR).json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    tail = F.substring_index(F.col("path"), path.rstrip("/") + "/", -1)
    rows = rows.where(~tail.rlike(r"(^|/)\.[^/]") & (F.size(F.split(tail, "/")) <= depth + 1))
    return rows.withColumn("sha256", F.coalesce("sha256", "output_sha256")).drop("output_sha256")


def scan_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Artifacts (from sidecars), tools (packages, first file wins by path), workflows and lock files of a folder."""
    files = _files(spark, path, "*").select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    kinds = F.when(F.col("name").isin("Snakefile") | F.col("name").endswith(".smk"), "snakemake").when(F.col("name").endswith(".nf"), "nextflow").when(F.col("name").isin("Makefile", "makefile"), "make").when(F.col("name").endswith(".cwl"), "cwl")
    locks = read_lockfiles(spark, path)
    return {
        "artifacts": read_sidecars(spark, path),
        "tools": dedupe_first(locks, ["ecosystem", "package"], ["path", "version"]),
        "workflows": files.select("path", kinds.alias("kind")).where("kind IS NOT NULL"),
        "lockfiles_found": locks.select("path", "ecosystem").distinct(),
    }


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content (binary), sha256 of the files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
