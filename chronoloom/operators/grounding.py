"""Small operators of authoring and generation: number extraction and ranking, gold checks, shares, medians, decoding, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashrand import SEED, STATIC, u
from chronoloom.operators.ranges import running


def finite(rows: DataFrame, col: str) -> DataFrame:
    c = F.col(col).cast("double")
    return rows.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def subsample(rows: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """The k rows with the least draws: a sampling operator, the same rows on every run."""
    return rows.withColumn("u_", u(STATIC, 9, F.col(key), seed=seed)).orderBy("u_", key).limit(k).drop("u_")


def decode(code: Column, names: list[str]) -> Column:
    """Name of a dictionary code; codes past the end are the last name."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.least(code, F.lit(len(names) - 1)) + 1).cast("int"))


def shares(rows: DataFrame, weight: str) -> DataFrame:
    return rows.withColumn("share", F.round(F.col(weight) / F.sum(weight).over(Window.partitionBy()), 6))


def weighted_median(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """The least value whose running weight, doubled, reaches the total; on distinct values."""
    c = rows.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    return running(c, ["v"], run="w").where(F.col("run") * 2 >= F.col("run_all")).agg(F.min("v").alias("median"))


def dictionary_union(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """value, code: values in the order in which they are first seen, over all groups."""
    first = rows.groupBy(F.col(value).alias("value")).agg(F.min(F.struct(F.col(group), F.col(order))).alias("at"))
    return first.select("value", (F.row_number().over(Window.orderBy("at")) - 1).alias("code"))


def numbers(text: Column) -> Column:
    """Amounts, grouped and plain numbers, as written, in order."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+"), F.lit(0))


def candidates(docs: DataFrame, trigger: str, reach: int = 40) -> DataFrame:
    """doc_id, k, number, hits: each number with the trigger words within reach characters before or after it.

    The text is split at numbers once; what stands between two of them is looked at, cut to the reach.
    """
    parts = docs.select("doc_id", F.split("text", "[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+").alias("between"), numbers(F.col("text")).alias("found"))
    x = parts.select("doc_id", "between", F.posexplode("found").alias("k", "number"))
    before, after = F.right(F.col("between")[F.col("k")], F.lit(reach)), F.left(F.col("between")[F.col("k") + 1], F.lit(reach))
    count = lambda s: F.regexp_count(F.lower(s), F.lit(trigger))
    return x.select("doc_id", "k", "number", (count(before) + count(after)).alias("hits"))


def best_candidate(found: DataFrame) -> DataFrame:
    """Most hits, then the first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "k")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def against_gold(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: parameters, found, right, accuracy; gold and extracted: name, value."""
    x = gold.join(extracted.select("name", F.col("value").alias("got")), "name", "left")
    return x.agg(F.count("*").alias("n"), F.count("got").alias("found"), F.count_if(F.col("got") == F.col("value")).alias("right"), F.round(F.avg((F.coalesce(F.col("got") == F.col("value"), F.lit(False))).cast("int")), 6).alias("accuracy"))


def first_sources(rows: DataFrame, key: str, order: str, limit: int = 6) -> DataFrame:
    """First occurrence of each key, at most `limit` of them: a report."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(order).limit(limit)


def clock(t: Column) -> dict[str, Column]:
    """day, weekday (Monday is 0), hour and second of the day of unix seconds."""
    day = F.floor(t / 86_400)
    return {"day": day, "weekday": F.pmod(day + 3, F.lit(7)).cast("int"), "hour": F.floor(F.pmod(t, F.lit(86_400)) / 3600).cast("int"), "second": F.pmod(t, F.lit(86_400)).cast("int")}
