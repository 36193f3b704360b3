"""Graph generators over spark.range: every edge is an expression of its ids, so generation has no state and no shuffle,
except where a model joins by its own definition (spatial cells, stub matching, weighted picks). Each function returns
src, dst (and pos where the order within a source matters)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashrand import BASELINE, SEED, TOPOLOGY, pick, poisson, u, zipf_cdf
from chronoloom.operators.ranges import running
from chronoloom.session import cut


def _nodes(spark: SparkSession, n: int, name: str = "src") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def _index(draw: Column, n: int) -> Column:
    return F.floor(draw * F.lit(n)).cast("bigint")


def _degrees(spark: SparkSession, n: int, mean: float, salt: int, seed: int) -> DataFrame:
    """src, pos for each half edge: Poisson degrees of at least 1."""
    k = F.greatest(poisson(u(TOPOLOGY, salt, F.col("src"), "d", seed=seed), max(mean, 0.01)), F.lit(1))
    return _nodes(spark, n).withColumn("pos", F.explode(F.sequence(F.lit(0), k - 1)))


def uniform_random(spark: SparkSession, n_src: int, n_dst: int, mean: float, seed: int = SEED) -> DataFrame:
    return _degrees(spark, n_src, mean, 1, seed).withColumn("dst", _index(u(TOPOLOGY, 1, F.col("src"), F.col("pos"), seed=seed), n_dst))


def small_world(spark: SparkSession, n: int, k: int, beta: float, seed: int = SEED) -> DataFrame:
    e = _nodes(spark, n).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))))
    moved = u(TOPOLOGY, 2, F.col("src"), F.col("j"), "r", seed=seed) < F.lit(beta)
    dst = F.when(moved, _index(u(TOPOLOGY, 2, F.col("src"), F.col("j"), "t", seed=seed), n)).otherwise((F.col("src") + F.col("j")) % n)
    e = e.select("src", dst.alias("dst")).where("src <> dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def stochastic_blocks(spark: SparkSession, n: int, blocks: int, mean: float, p_in: float, p_out: float, seed: int = SEED) -> DataFrame:
    """Equal contiguous blocks; the last one takes the remainder. The own block is chosen with probability p_in / (p_in + p_out)."""
    size = max(1, n // blocks)
    block = lambda c: F.least(F.floor(c / size), F.lit(blocks - 1)).cast("bigint")
    e = _degrees(spark, n, mean, 3, seed).withColumn("own", block(F.col("src")))
    other = (F.col("own") + 1 + _index(u(TOPOLOGY, 3, F.col("src"), F.col("pos"), "o", seed=seed), max(blocks - 1, 1))) % blocks
    at = F.when(u(TOPOLOGY, 3, F.col("src"), F.col("pos"), "b", seed=seed) < F.lit(p_in / (p_in + p_out)), F.col("own")).otherwise(other)
    width = F.when(F.col("at") == blocks - 1, F.lit(n - size * (blocks - 1))).otherwise(F.lit(size))
    return e.withColumn("at", at).select("src", "pos", (F.col("at") * size + F.floor(u(TOPOLOGY, 3, F.col("src"), F.col("pos"), "t", seed=seed) * width)).cast("bigint").alias("dst"))


def recursive_matrix(spark: SparkSession, n: int, edges: int, a: float, b: float, c: float, purpose: int = TOPOLOGY, seed: int = SEED) -> DataFrame:
    """R-MAT and stochastic Kronecker graphs: one quadrant draw for each level, ids modulo n."""
    bits = max(1, math.ceil(math.log2(n)))
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for level in range(bits):
        x = u(purpose, 4, F.col("id"), level, seed=seed)
        src = src * 2 + F.when(x < F.lit(a + b), 0).otherwise(1)
        dst = dst * 2 + F.when((x < F.lit(a)) | ((x >= F.lit(a + b)) & (x < F.lit(a + b + c))), 0).otherwise(1)
    return spark.range(edges).select("id", (src % n).alias("src"), (dst % n).alias("dst"))


def affiliation(spark: SparkSession, n_src: int, n_dst: int, mean: float, exponent: float, seed: int = SEED) -> DataFrame:
    """Bipartite, targets by Zipf rank. The distribution function's table has n_dst entries and rides in the plan; for
    many targets use weighted_picks over a weight table."""
    return _degrees(spark, n_src, mean, 5, seed).withColumn("dst", pick(u(TOPOLOGY, 5, F.col("src"), F.col("pos"), seed=seed), zipf_cdf(exponent, n_dst)).cast("bigint"))


def spatial(spark: SparkSession, n: int, radius: float, seed: int = SEED) -> DataFrame:
    """Points in the unit square joined within a radius: an equi-join on grid cells, each point sent to its 3 x 3 cells."""
    r = min(max(radius, 1e-4), 0.5)
    p = _nodes(spark, n).select("src", u(TOPOLOGY, 6, F.col("src"), "x", seed=seed).alias("x"), u(TOPOLOGY, 6, F.col("src"), "y", seed=seed).alias("y"))
    p = p.withColumn("cx", F.floor(F.col("x") / r)).withColumn("cy", F.floor(F.col("y") / r))
    near = p.withColumn("dx", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("dy", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    near = near.select("src", "x", "y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    q = p.select(F.col("src").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
    close = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) <= F.lit(r * r)
    return near.join(q, ["cx", "cy"]).where(close & (F.col("src") != F.col("dst"))).select("src", "dst")


def preferential_attachment(spark: SparkSession, n: int, m: int, seed: int = SEED, rounds: int = 64) -> DataFrame:
    """Barabasi-Albert without state (Sanders and Schulz 2016): half edge i points at a uniform earlier end; an even draw is a
    node, an odd one another half edge's target, whose draw is recomputed from its number. Both directions; loops dropped."""
    draw = lambda i: F.floor(u(TOPOLOGY, 7, i, seed=seed) * i * 2).cast("bigint")
    step = lambda r, _: F.when(r % 2 == 0, r).otherwise(F.when(r == 1, F.lit(0).cast("bigint")).otherwise(draw(F.floor(r / 2).cast("bigint"))))
    start = F.when(F.col("id") == 0, F.lit(0).cast("bigint")).otherwise(draw(F.col("id")))
    e = spark.range(n * m).select(F.floor(F.col("id") / m).cast("bigint").alias("src"), F.floor(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step) / 2 / m).cast("bigint").alias("dst"))
    e = e.where("src <> dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def erdos_renyi(spark: SparkSession, n: int, edges: int, seed: int = SEED) -> DataFrame:
    return spark.range(edges).select("id", _index(u(BASELINE, 1, F.col("id"), "s", seed=seed), n).alias("src"), _index(u(BASELINE, 1, F.col("id"), "d", seed=seed), n).alias("dst"))


def configuration(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """Directed configuration model: out stubs meet in stubs in hashed order. Ranks come from a global sort by range, not from one task."""
    return _ranked(edges, "src", "o", seed).join(_ranked(edges, "dst", "i", seed), "rank").select("src", "dst")


def _ranked(edges: DataFrame, col: str, salt: str, seed: int) -> DataFrame:
    """col, rank: dense ranks of hashed rows, by hash prefix buckets with running bucket sizes."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(BASELINE)), F.lit(salt), F.col("id").cast("string")).cast("binary"))
    rows = edges.select(col, h.alias("h"), F.substring(h, 1, 3).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("h"))
    return rows.withColumn("k", inner).join(F.broadcast(starts), F.col("bucket") == F.col("b")).select(col, (F.col("start") + F.col("k")).alias("rank"))  # 4096 rows


def weighted_picks(spark: SparkSession, weights: DataFrame, picks: int, salt: int, name: str, seed: int = SEED) -> DataFrame:
    """id, name: nodes (node, w integer) picked in proportion to w."""
    return _with_pick(spark.range(picks), weights, salt, name, seed)


#: Least number of equal stretches that all units of weight are cut into, and stretches of a node that one array holds.
STRETCHES, STRETCH_RUN = 1 << 12, 1 << 16


def _with_pick(rows: DataFrame, weights: DataFrame, salt: int, name: str, seed: int) -> DataFrame:
    """rows (id) with name, the node that owns the unit of weight drawn.

    Nodes lie along the units in their order, each from lo to hi, a null node last. A draw meets the nodes of its stretch alone.
    There are about as many stretches as nodes, so all draws together meet about two nodes each, and the draws spread evenly
    over stretches, whatever the weights; units are never made into rows.
    """
    placed = cut(running(weights.where("w > 0").withColumn("none", F.col("node").isNull()), ["none", "node"], hi="w"))
    nodes, total = placed.agg(F.count("*"), F.coalesce(F.max("hi_all"), F.lit(0))).first()
    wide = max(1, total // max(nodes, STRETCHES))
    at = lambda unit, size: F.floor(unit / F.lit(size)).cast("bigint") if size > 1 else unit
    lo, last, run = F.col("lo"), F.col("hi") - 1, wide * STRETCH_RUN
    spans = placed.select(F.col("node").alias(name), (F.col("hi") - F.col("w")).cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))
    spans = spans.withColumn("run", F.explode(F.sequence(at(lo, run), at(last, run))))
    first_in, last_in = F.greatest(at(lo, wide), F.col("run") * STRETCH_RUN), F.least(at(last, wide), F.col("run") * STRETCH_RUN + (STRETCH_RUN - 1))
    spans = spans.withColumn("stretch", F.explode(F.sequence(first_in, last_in))).drop("run")
    drawn = rows.withColumn("unit", F.floor(u(BASELINE, salt, F.col("id"), seed=seed) * F.lit(total)).cast("bigint")).withColumn("of", at(F.col("unit"), wide))
    owner = (F.col("of") == F.col("stretch")) & (F.col("unit") >= lo) & (F.col("unit") < F.col("hi"))
    return drawn.join(spans, owner).select(*rows.columns, name)


def chung_lu(spark: SparkSession, edges: DataFrame, seed: int = SEED) -> DataFrame:
    """As many edges as the model graph has, ends picked in proportion to out and in degrees."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("w"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("w"))
    return _with_pick(weighted_picks(spark, out, edges.count(), 11, "src", seed), into, 12, "dst", seed)


def forest_fire(spark: SparkSession, n: int, forward: float, backward: float, mean_degree: float, seed: int = SEED) -> DataFrame:
    """Leskovec's forest fire; sequential by definition, so one task runs it and yields its edges in batches."""
    cap = max(8, int(8 * mean_degree))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            rng = np.random.default_rng(seed)
            out: list[list[int]] = [[] for _ in range(n)]
            into: list[list[int]] = [[] for _ in range(n)]
            for v in range(1, n):
                seen, todo = set(), [int(rng.integers(v))]
                while todo and len(seen) < cap:
                    w = todo.pop()
                    if w in seen:
                        continue
                    seen.add(w)
                    for links, p in ((out[w], forward), (into[w], backward)):
                        k = int(rng.geometric(1 - p)) - 1
                        fresh = [x for x in links if x not in seen]
                        rng.shuffle(fresh)
                        todo += fresh[:k]
                for w in sorted(seen):
                    out[v].append(w)
                    into[w].append(v)
            pairs = [(v, w) for v in range(n) for w in out[v]]
            for k in range(0, len(pairs), 50_000):
                s, d = zip(*pairs[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64())], ["src", "dst"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "src bigint, dst bigint")
