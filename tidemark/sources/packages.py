"""Query sets, runs, index manifests and packages of evidence: what is checked when read and what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.signals import usefulness

#: Columns that a set of search queries must have, and those of a run.
QUERY_COLUMNS = ("query_id", "query", "intent", "expected_ticker", "source_scope")
RUN_COLUMNS = ("query_id", "doc_id", "rank", "score", "method")
VERSION = "1"


def checked_queries(rows: DataFrame, required: tuple[str, ...] = QUERY_COLUMNS) -> DataFrame:
    """A set of queries: the required columns, no blank id or query, no id twice, one row at least."""
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    n, ids, blanks = rows.agg(F.count("*"), F.count_distinct("query_id"), F.count_if(blank("query_id") | blank("query"))).first()
    if not n or blanks or ids < n:
        raise ValueError(f"of {n} queries {blanks} lack an id or words, and {n - ids} ids stand twice")
    return rows


def _plain(rows: DataFrame) -> DataFrame:
    """Lists as text with | between."""
    return rows.select(*[F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields])


def write_run(rows: DataFrame, path: str, columns: tuple[str, ...] = RUN_COLUMNS, append: bool = False) -> None:
    """A run as CSV, each file with its header; appended to what is there, or in its place."""
    _plain(rows.select(*[c for c in columns if c in rows.columns])).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run in rank order within its queries; without a method it is called run."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows if "method" in rows.columns else rows.withColumn("method", F.lit("run"))
    return rows.withColumns({"rank": F.col("rank").cast("int"), "method": F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("run"))}).orderBy("query_id", "rank")


def read_usefulness(spark: SparkSession, path: str) -> DataFrame:
    """Scores of features by name and alias, from a table of relations."""
    return usefulness(spark.read.option("header", True).csv(path))


def _state(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Last change (milliseconds) and bytes of a file or folder; none where there is nothing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    return fs.getFileStatus(where).getModificationTime(), fs.getContentSummary(where).getLength()


def write_manifest(spark: SparkSession, path: str, source: str, counts: dict[str, int]) -> None:
    """(key, value) rows: version, source with its state, and counts."""
    changed, size = _state(spark, source)
    rows = {"schema_version": VERSION, "documents_path": source, "documents_mtime": changed, "documents_size": size} | counts
    spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def usable(spark: SparkSession, path: str, source: str) -> bool:
    """Whether the index that a manifest describes is of this version and of the source as it is now."""
    if _state(spark, path) is None or (now := _state(spark, source)) is None:
        return False
    said = {r.key: r.value for r in spark.read.parquet(path).collect()}
    return (said.get("schema_version"), said.get("documents_path"), said.get("documents_mtime"), said.get("documents_size")) == (VERSION, source, str(now[0]), str(now[1]))


def write_package(path: str, tables: dict[str, DataFrame], bucket: str | None = None) -> None:
    """A package: each table as JSON lines, in folders by the column `bucket` where a table has it, and a manifest of their rows."""
    counts = []
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(bucket) if bucket and bucket in rows.columns else writer).json(f"{path}/{name}")
        counts.append((name, rows.sparkSession.read.schema(rows.schema).json(f"{path}/{name}").count()))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(counts, "name string, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_columns(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> DataFrame:
    """Those of the wanted columns that a CSV has; others aren't read."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[c for c in wanted if c in rows.columns])
