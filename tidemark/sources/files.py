"""Sources and sinks: JSON lines, CSV with lists, panels with unknown column names, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import list_of

_S, _A = T.StringType(), T.ArrayType(T.StringType())
#: Fields of a normalised document.
DOCUMENT = T.StructType(
    [T.StructField(n, _S) for n in ("doc_id", "title", "body", "source", "source_type", "url", "published_at", "first_seen_at", "available_at", "ingested_at", "version_id")]
    + [T.StructField("is_revision", T.BooleanType()), T.StructField("revision_of", _S), T.StructField("duplicate_cluster_id", _S)]
    + [T.StructField(n, _A) for n in ("tickers_detected", "matched_tickers", "matched_holdings", "company_names_detected", "sectors_detected", "sector_tags", "event_tags", "risk_terms")]
    + [T.StructField(n, T.DoubleType()) for n in ("sentiment_score", "uncertainty_score", "source_credibility")]
    + [T.StructField(n, _S) for n in ("event_type", "language", "document_hash")]
)
#: Names under which a panel may hold its date and its ticker.
DATE_NAMES, TICKER_NAMES = ("date", "Date", "datetime", "timestamp", "decision_date"), ("tic", "ticker", "symbol", "Ticker", "Symbol")


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line fails the read."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(list(paths))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Raw documents with every derived default filled in, and rows dropped that lack an id or a zoned time."""
    from tidemark.functions.text import content_hash, document_hash
    from tidemark.functions.times import zoned

    empty = F.array().cast(_A)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    tickers = F.transform(F.coalesce("tickers_detected", empty), lambda t: F.upper(t))
    out = raw.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "body", "source", "source_type", "url", "event_type")})
    out = out.withColumns({"available_at": F.coalesce(blank("available_at"), blank("published_at")), "tickers_detected": tickers, "source_credibility": F.when(F.coalesce("source_credibility", F.lit(0.0)) == 0, 0.5).otherwise(F.col("source_credibility"))})
    out = out.withColumns({"first_seen_at": F.coalesce(blank("first_seen_at"), "available_at"), "ingested_at": F.coalesce(blank("ingested_at"), "available_at")})
    out = out.withColumns({"matched_tickers": F.coalesce("matched_tickers", "tickers_detected"), "sector_tags": F.coalesce("sector_tags", "sectors_detected", empty), "event_tags": F.coalesce("event_tags", F.when(F.col("event_type") != "", F.array("event_type")).otherwise(empty)), "risk_terms": F.coalesce("risk_terms", empty)})
    out = out.withColumn("matched_holdings", F.coalesce("matched_holdings", F.filter("matched_tickers", lambda t: t != "MARKET")))
    out = out.withColumn("duplicate_cluster_id", F.coalesce(blank("duplicate_cluster_id"), content_hash("title", "body")))
    out = out.withColumn("document_hash", F.coalesce(blank("document_hash"), document_hash(*map(F.col, ("source", "doc_id", "published_at", "available_at", "title", "body")))))
    return out.filter(blank("doc_id").isNotNull() & zoned(F.col("published_at")).isNotNull() & zoned(F.col("available_at")).isNotNull())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, all text; named columns must be there, and list columns are split."""
    df = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.withColumns({c: list_of(c) for c in lists if c in df.columns})


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel of (date, tic, ...) whatever those columns are called; rows without either are left out."""
    df = spark.read.option("header", True).csv(path)
    found = [next((n for n in names if n in df.columns), None) for names in (DATE_NAMES, TICKER_NAMES)]
    if None in found:
        raise ValueError("no date or ticker column")
    date, tic = found
    rest = [c for c in df.columns if c not in found]
    out = df.select(F.to_date(F.substring(date, 1, 10)).alias("date"), F.upper(F.trim(tic)).alias("tic"), *[F.coalesce(F.col(c).try_cast("double"), F.lit(None)).alias(c) if c not in ("split", "regime") else F.col(c) for c in rest])
    return out.filter("date IS NOT NULL AND tic <> ''")


def universe(panel: DataFrame) -> DataFrame:
    """Tickers of each date."""
    return panel.groupBy("date").agg(F.array_sort(F.collect_set("tic")).alias("tickers"))


def arrays_to_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Parallel arrays as rows."""
    return df.select(*[c for c in df.columns if c not in columns], F.explode(F.arrays_zip(*columns)).alias("row_")).select("*", "row_.*").drop("row_")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows, columns in the order they are first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table at path hasn't; how many there were. A fault in reading the table is an error, not no table."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = df.dropDuplicates([key])
    if there:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def macro_documents(observations: DataFrame, lag_days: int = 1) -> DataFrame:
    """Documents from observations (series, day, value): available at 14:00 UTC some days after the day they are of."""
    at = F.to_timestamp(F.concat(F.date_add("day", lag_days).cast("string"), F.lit(" 14:00:00")))
    text = F.format_string("Series %s: Value: %s", "series", F.col("value").cast("string"))
    return observations.filter("value IS NOT NULL").select(F.format_string("official_macro_%s_%s", F.lower("series"), F.col("day").cast("string")).alias("doc_id"), text.alias("body"), at.alias("available_at"), F.lit("official_macro_release").alias("source_type"), "series", "value")
