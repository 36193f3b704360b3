"""The generator's building blocks as operators of their own: arrivals, bursts, spacings, partner memory, cascades, stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.hashrand import ACTOR, SEED, exponential, geometric, pick, poisson_cdf, u, weights_cdf

DAY = 86_400


def arrivals(spark: SparkSession, actors: int, days: int, rate: float, weekly: list[float], diurnal: list[float], seed: int = SEED) -> DataFrame:
    """actor, day, k, second: an inhomogeneous Poisson process by day. A day's count has mean rate x weekday weight; hours
    are drawn by the diurnal profile, which is the law that thinning at the hourly maximum leaves."""
    grid = spark.range(actors).withColumnRenamed("id", "actor").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    x = u(ACTOR, F.col("actor"), F.col("day"), "n", seed=seed)
    count = None
    for wd, w in enumerate(weekly):
        c = pick(x, poisson_cdf(rate * w))
        count = F.when(F.col("day") % 7 == wd, c) if count is None else count.when(F.col("day") % 7 == wd, c)
    e = grid.withColumn("n", count).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    key = lambda w: u(ACTOR, F.col("actor"), F.col("day"), F.col("k"), w, seed=seed)
    return e.select("actor", "day", "k", (pick(key("h"), weights_cdf(diurnal)) * 3600 + F.floor(key("s") * 3600)).cast("bigint").alias("second"))


def bursts(base: DataFrame, p: float, mean_length: float, gap: float = 300.0, seed: int = SEED) -> DataFrame:
    """Follow-ups of each base event with probability p: a geometric number at exponential gaps, cut at the day's end."""
    key = lambda *w: u(ACTOR, F.col("actor"), F.col("day"), F.col("k"), *w, seed=seed)
    more = F.when(key("b") < p, geometric(key("g"), mean_length)).otherwise(0)
    x = base.withColumn("j", F.explode(F.sequence(F.lit(0), more)))
    step = F.when(F.col("j") == 0, F.lit(0.0)).otherwise(exponential(key("e", F.col("j")), gap))
    w = Window.partitionBy("actor", "day", "k").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("at", F.col("second") + F.sum(step).over(w)).where(F.col("at") < DAY)
    return x.select("actor", "day", "k", "j", F.floor("at").cast("bigint").alias("second"))


def weibull_spacing(events: DataFrame, shape: float, window: int = DAY, seed: int = SEED) -> DataFrame:
    """Each actor's n events of a day at cumulated Weibull gaps, stretched to the window and turned by a phase."""
    key = lambda *w: u(ACTOR, F.col("actor"), F.col("day"), *w, seed=seed)
    gap = F.pow(exponential(key("w", F.col("k")), 1.0), F.lit(1.0 / shape))
    w = Window.partitionBy("actor", "day")
    x = events.withColumn("gap", gap).withColumn("upto", F.sum("gap").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("gap").over(w))
    at = F.pmod(F.col("upto") / F.col("all") * window + key("phase") * window, F.lit(float(window)))
    return x.select("actor", "day", "k", F.floor(F.round(at, 3)).cast("bigint").alias("second"))


def partner_memory(events: DataFrame, repeat_p: float, seed: int = SEED) -> DataFrame:
    """id, dst: with probability repeat_p an event reuses one of its source's last two fresh partners; dst of the input is the fresh draw."""
    again = u(ACTOR, F.col("id"), "again", seed=seed) < repeat_p
    w = Window.partitionBy("src").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("again", again).withColumn("kept", F.when(~F.col("again"), F.col("dst"))).withColumn("one", F.last("kept", ignorenulls=True).over(w))
    x = x.withColumn("before", F.when(~F.col("again"), F.col("one"))).withColumn("two", F.last("before", ignorenulls=True).over(w))
    use_two = (u(ACTOR, F.col("id"), "which", seed=seed) < 0.5) & F.col("two").isNotNull()
    return x.select("id", F.when(F.col("again"), F.coalesce(F.when(use_two, F.col("two")), "one", "dst")).otherwise(F.col("dst")).alias("dst"))


def neighbour_pick(events: DataFrame, skeleton: DataFrame, n_nodes: int, seed: int = SEED) -> DataFrame:
    """id, dst: a uniform neighbour of src in the skeleton (src, pos, dst); a uniform node where it has none."""
    deg = skeleton.groupBy("src").agg(F.count("*").alias("deg"))
    x = events.select("id", "src").join(deg, "src", "left").withColumn("pos", F.floor(u(ACTOR, F.col("id"), "nb", seed=seed) * F.col("deg")).cast("int"))
    x = x.join(skeleton, ["src", "pos"], "left")
    return x.select("id", F.coalesce("dst", F.floor(u(ACTOR, F.col("id"), "any", seed=seed) * n_nodes).cast("bigint")).alias("dst"))


def hawkes(base: DataFrame, branching: float, decay: float, window: int = DAY, seed: int = SEED) -> DataFrame:
    """actor, day, k, path, generation, second: self-exciting cascades, in which each event has Poisson(branching) children at
    exponential delays; children past the window are not born.

    A family is followed to its end in a Python function over Arrow batches, as its depth isn't known; it is finite, with
    1 / (1 - branching) members on average, as branching must be under 1. Draws are those of u, keyed by the path of births.
    """
    if not 0 <= branching < 1:
        raise ValueError("branching must be in [0, 1), else families don't end")
    cdf = poisson_cdf(branching)

    def run(batches):
        import bisect
        import hashlib
        import math

        import pyarrow as pa

        def uniform(*about):
            return int(hashlib.md5("|".join(map(str, (seed, ACTOR, *about))).encode()).hexdigest()[:13], 16) / (1 << 52)

        for b in batches:
            out = []
            for actor, day, k, second in zip(*(b.column(c).to_pylist() for c in ("actor", "day", "k", "second")), strict=True):
                todo = [("0", 0, float(second))]
                while todo:
                    path, g, t = todo.pop()
                    out.append((actor, day, k, path, g, math.floor(t)))
                    for i in range(min(bisect.bisect_right(cdf, uniform(actor, day, k, path, "kids")), len(cdf) - 1)):
                        child = f"{path}.{i}"
                        at = t - decay * math.log(max(uniform(actor, day, k, child, "delay"), 1e-12))
                        if at < window:
                            todo.append((child, g + 1, at))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["actor", "day", "k", "path", "generation", "second"])

    return base.select("actor", "day", "k", "second").mapInArrow(run, "actor bigint, day int, k int, path string, generation int, second bigint")


def chain_stage(campaigns: DataFrame, mean: float, scope: str, seed: int = SEED) -> DataFrame:
    """campaign, mi, q, t, src, dst for campaigns (id, members, s0, s1): Poisson(mean) events of each acting member."""
    x = campaigns.select("id", "members", "s0", "s1", F.posexplode("members").alias("mi", "member"))
    if scope == "collector":
        x = x.where("mi > 0")
    key = lambda *w: u(ACTOR, F.col("id"), F.col("mi"), *w, seed=seed)
    x = x.withColumn("n", pick(key("n"), poisson_cdf(mean))).where("n > 0").withColumn("q", F.explode(F.sequence(F.lit(1), F.col("n"))))
    size = F.size("members")
    i = F.floor(key(F.col("q"), "to") * size)
    other: Column = {
        "chain": F.element_at("members", (F.pmod(F.col("mi") + 1, size) + 1).cast("int")),
        "collector": F.element_at("members", 1),
        "ring": F.element_at("members", (F.when(F.element_at("members", (i + 1).cast("int")) == F.col("member"), F.pmod(i + 1, size)).otherwise(i) + 1).cast("int")),
    }[scope]
    return x.select("id", "mi", "q", (F.col("s0") + F.floor(key(F.col("q"), "t") * (F.col("s1") - F.col("s0")))).cast("bigint").alias("t"), F.col("member").alias("src"), other.alias("dst"))
