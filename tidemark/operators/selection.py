"""De-duplication by rule, samples and quotas, grouping of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with an empty or null key all stay."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    columns = rows.columns
    best = rows.filter(~empty).groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row")).select("row.*")
    return best.select(*columns).unionByName(rows.filter(empty))


def best_wins(rows: DataFrame, key: str, score: Column, order: list[str]) -> DataFrame:
    """The row of each key with the highest score, the earliest of equals."""
    columns = rows.columns
    rows = rows.withColumn("score_", score)
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(-F.col("score_"), *order)).alias("row")).select("row.*")


def row_key(*fields: Column) -> Column:
    """The first field that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(f.cast("string")), F.lit("")) for f in fields])


def copies(rows: DataFrame, hashed: Column, doc: str = "doc_id") -> DataFrame:
    """(cluster, first, n) of texts that several documents have."""
    return rows.groupBy(hashed.alias("cluster")).agg(F.min(doc).alias("first"), F.count("*").alias("n")).filter("n > 1")


def stratified(rows: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """n rows: the first of every stratum, in order, then the rest in order; n is the sample's size."""
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return rows.withColumn("own", rn).orderBy((F.col("own") > 1).cast("int"), *order).limit(n)


def per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("own", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("own") <= n)


def evenly_spaced(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each group at even distances, both ends included; groups of n or fewer whole."""
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"slot": F.row_number().over(w.orderBy(*order)) - 1, "size": F.count("*").over(w)})
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("size") - 1) / (n - 1)).cast("long"))
    return rows.filter((F.col("size") <= n) | F.array_contains(slots, F.col("slot"))).drop("size")


def quotas(rows: DataFrame, by: list[str], kind: Column, shares: dict[str, int], order: list[str], n: int) -> DataFrame:
    """Up to the quota of each kind in each group, then the group's earliest rows up to n."""
    rows = rows.withColumn("kind_", kind)
    place = F.row_number().over(Window.partitionBy(*by, "kind_").orderBy(*order))
    quota = F.lit(n - sum(shares.values()))
    for k, v in shares.items():
        quota = F.when(F.col("kind_") == k, v).otherwise(quota)
    rows = rows.withColumn("within", (place <= quota))
    return per_group(rows, by, [F.desc("within"), *[F.asc(o) for o in order]], n).drop("kind_")


def leaders(rows: DataFrame, group: str, order: list[Column], children: int = 5) -> DataFrame:
    """The best row of each group with the ids of the next ones, and whether there are more still."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    kept = F.array_sort(F.collect_list(F.when((F.col("place") > 1) & (F.col("place") <= children + 1), F.struct("place", "doc_id"))))
    return ranked.groupBy(group).agg(
        F.min_by("doc_id", "place").alias("leader"), F.array_join(F.transform(kept, lambda x: x["doc_id"].cast("string")), "|").alias("children"),
        F.count("*").alias("n"), (F.max("place") > children + 1).alias("has_more"),
    )


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of all, in order; limit is held within 1..25."""
    n = max(1, min(25, limit))
    best = rows.orderBy(*order).limit(offset + n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") > offset)


def promote(rows: DataFrame, favourite: Column, score: str, by: list[str]) -> DataFrame:
    """promoted: all rows of a favourite site of which one row has 0.6 of the best score, or any if no score is over 0.5."""
    most = F.max(score).over(Window.partitionBy(*by))
    enough = F.when(most > 0.5, 0.6 * most).otherwise(-1.0)
    good = F.max((favourite & (F.col(score) >= enough)).cast("int")).over(Window.partitionBy(*by, "site"))
    return rows.withColumn("promoted", favourite & (good == 1))
