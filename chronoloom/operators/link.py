"""Link prediction on edge streams: splits, negatives, memory baselines, ranking metrics and recent neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashrand import SEED, STATIC, u
from chronoloom.operators.ranges import running


def stream_ranks(edges: DataFrame) -> DataFrame:
    """Row number of each edge in (t, id) order as rank, and the number of rows as total, from running totals over ranges."""
    return running(edges, ["t", "id"], rank=F.lit(1).cast("bigint")).withColumnRenamed("rank_all", "total")


def chronological_split(edges: DataFrame, train: float = 0.7, validate: float = 0.15) -> DataFrame:
    share = (F.col("rank") - 1) / F.col("total")
    return stream_ranks(edges).withColumn("split", F.when(share < train, "train").when(share < train + validate, "validate").otherwise("test"))


def negatives(edges: DataFrame, n_nodes: int, seed: int = SEED) -> DataFrame:
    """For each edge a target drawn uniformly, keyed by the edge."""
    return edges.select("id", "src", "t", F.floor(u(STATIC, 1, F.col("id"), seed=seed) * F.lit(n_nodes)).cast("bigint").alias("dst"))


def edge_bank(edges: DataFrame, n_nodes: int, batch: int = 200, memory: float | None = None, seed: int = SEED) -> DataFrame:
    """id, batch, positive, negative: 1 where the pair was seen in an earlier batch (within `memory` of the span, if given).

    Predict, then update: a batch sees only batches before it. Both edges and candidates are keyed by pair; the last
    earlier time comes from one window over the pair's rows, ordered by batch.
    """
    x = stream_ranks(edges).withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("int"))
    span = x.agg((F.max("t") - F.min("t")).alias("span_"))
    cut = F.col("span_") * F.lit(memory if memory is not None else 0.0)
    pos = x.select("id", "batch", "src", "dst", "t", F.lit(1).alias("real"))
    neg = x.select("id", "batch", "src", F.floor(u(STATIC, 1, F.col("id"), seed=seed) * F.lit(n_nodes)).cast("bigint").alias("dst"), "t", F.lit(0).alias("real"))
    w = Window.partitionBy("src", "dst").orderBy("batch").rangeBetween(Window.unboundedPreceding, -1)
    seen = pos.unionAll(neg).withColumn("last", F.max(F.when(F.col("real") == 1, F.col("t"))).over(w)).crossJoin(F.broadcast(span))  # one row
    hit = F.col("last").isNotNull() & (F.lit(memory is None) | (F.col("t") - F.col("last") <= cut))
    return seen.groupBy("id", "batch").agg(F.max(F.when(F.col("real") == 1, hit.cast("int"))).alias("positive"), F.max(F.when(F.col("real") == 0, hit.cast("int"))).alias("negative"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """ROC AUC with midranks and average precision of (score, label), on distinct scores with counts.

    Ties get their midrank for the AUC; for precision they come together at their score, as a threshold would.
    """
    c = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    x = running(c, ["score"], ps="p", qs="q")
    x = x.select("p", "q", (F.col("qs") - F.col("q")).alias("below"), (F.col("ps_all") - F.col("ps") + F.col("p")).alias("tp"), (F.col("qs_all") - F.col("qs") + F.col("q")).alias("fp"), F.col("ps_all").alias("np"), F.col("qs_all").alias("nq"))
    return x.agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.max(F.col("np") * F.col("nq")), 6).alias("auc"), F.round(F.sum(F.col("p") / F.col("np") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("ap"))


def batch_average_precision(bank: DataFrame) -> DataFrame:
    """Mean over batches of the average precision of positives against negatives, scores 0 or 1."""
    x = bank.groupBy("batch").agg(F.sum("positive").alias("tp"), F.sum("negative").alias("fp"), F.count("*").alias("n"))
    hit = F.when(F.col("tp") > 0, F.col("tp") / F.col("n") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rest = (F.col("n") - F.col("tp")) / F.col("n") * F.lit(0.5)
    return x.agg(F.count("*").alias("batches"), F.round(F.avg(hit + rest), 6).alias("mean_ap"))


def recent_neighbours(edges: DataFrame, k: int = 20) -> DataFrame:
    """node, rank, other: the k latest partners of each node, both directions, latest first."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("side"), "t", "id"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("side"), "t", "id"))).alias("e")).select("e.*")
    w = Window.partitionBy("node").orderBy(F.desc("t"), F.desc("id"), "side")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("node", "rank", "other")


def degree_rank_codec(edges: DataFrame, col: str = "src", seed: int = SEED) -> DataFrame:
    """Values as (rank by frequency + u) / number of values, and back: id, code, decoded."""
    counts = edges.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    ranked = running(counts, ["c", "v"], r=F.lit(1).cast("bigint")).select("v", (F.col("r") - 1).alias("r"), F.col("r_all").alias("n"))
    x = edges.join(ranked, F.col(col) == F.col("v"))
    code = (F.col("r") + u(STATIC, 2, F.col("id"), seed=seed)) / F.col("n")
    x = x.select("id", code.alias("code"), "n")
    back = ranked.select(F.col("v").alias("decoded"), F.col("r").alias("r2"))
    return x.join(back, F.least(F.floor(F.col("code") * F.col("n")), F.col("n") - 1) == F.col("r2")).select("id", F.round("code", 9).alias("code"), "decoded")


def temporal_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int = SEED) -> DataFrame:
    """walk, step, node, t: each step takes a uniform out-edge with time at or after arrival.

    As a step needs only the number of eligible edges and one of them, edges are numbered by time within their source;
    the first eligible number comes from an as-of lookup over the union of arrivals and edges, the pick is an equi-join.
    """
    w = Window.partitionBy("src").orderBy("t", "id")
    e = edges.select("src", "dst", "t", "id", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("src")).alias("deg"))
    at = starts.select("walk", "node", F.col("t").alias("at"))
    out = at.select("walk", F.lit(0).alias("step"), "node", F.col("at").alias("t"))
    for s in range(1, steps + 1):
        line = e.select(F.col("src").alias("node"), "t", F.lit(1).alias("side"), "k", "deg", F.lit(None).cast("bigint").alias("walk")).unionAll(at.select("node", F.col("at").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("bigint").alias("deg"), "walk"))
        after = Window.partitionBy("node").orderBy("t", "side").rowsBetween(0, Window.unboundedFollowing)
        first = line.select("walk", "node", "side", F.first("k", ignorenulls=True).over(after).alias("lo"), F.first("deg", ignorenulls=True).over(after).alias("deg")).where("side = 0 and lo is not null")
        pick = F.col("lo") + F.floor(u(STATIC, 3, F.col("walk"), s, seed=seed) * (F.col("deg") - F.col("lo") + 1)).cast("int")
        at = first.select("walk", F.col("node").alias("src"), pick.alias("k")).join(e, ["src", "k"]).select("walk", F.col("dst").alias("node"), F.col("t").alias("at"))
        out = out.unionAll(at.select("walk", F.lit(s).alias("step"), "node", F.col("at").alias("t")))
    return out


def gap_buckets(gaps: DataFrame, buckets: int = 16) -> DataFrame:
    """Quantile buckets of log1p gaps and each bucket's mean, from counts of distinct gaps."""
    c = gaps.where("gap is not null").groupBy("gap").agg(F.count("*").alias("c"))
    x = running(c, ["gap"], upto="c").select("gap", "c", (F.col("upto") - F.col("c")).alias("before"), F.col("upto_all").alias("n"))
    b = F.floor(F.col("before") * buckets / F.col("n")).cast("int")
    return x.groupBy(b.alias("bucket")).agg(F.sum("c").alias("n"), F.round(F.sum(F.log1p("gap") * F.col("c")) / F.sum("c"), 5).alias("mean_log"))


def hash_split(key: Column, share: float, seed: int = SEED) -> Column:
    return u(STATIC, 4, key, seed=seed) < F.lit(share)
