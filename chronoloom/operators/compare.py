"""How close two samples or two graphs are. Everything works on distinct values with counts, never on gathered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import stats
from chronoloom.operators.ranges import running


def value_counts(a: DataFrame, b: DataFrame, key: str = "g") -> DataFrame:
    """g, v, c1, c2: how often each finite value occurs in either sample (columns g, v), for each quantity g."""
    ok = F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")) & (F.abs(F.col("v").cast("double")) < float("inf"))
    both = a.where(ok).select(key, F.col("v").cast("double").alias("v"), F.lit(1).alias("s")).unionAll(b.where(ok).select(key, F.col("v").cast("double").alias("v"), F.lit(2).alias("s")))
    return both.groupBy(key, "v").agg(F.count_if(F.col("s") == 1).alias("c1"), F.count_if(F.col("s") == 2).alias("c2"))


def cdf_table(counts: DataFrame, key: str = "g") -> DataFrame:
    """Both distribution functions at each distinct value, sizes and the next value."""
    x = running(counts, ["v"], (key,), "v", u1="c1", u2="c2")
    x = x.select(key, "v", "c1", "c2", "u1", "u2", F.col("u1_all").alias("n1"), F.col("u2_all").alias("n2"), F.col("next_").alias("next"))
    return x.where("n1 > 0 and n2 > 0").withColumn("f1", F.col("u1") / F.col("n1")).withColumn("f2", F.col("u2") / F.col("n2"))


def two_sample_distances(a: DataFrame, b: DataFrame, key: str = "g", least: int = 5) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein-1 and energy distance of each quantity; null where a side has under `least` values."""
    x = cdf_table(value_counts(a, b, key), key)
    gap, width = F.abs(F.col("f1") - F.col("f2")), F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))
    out = x.groupBy(key).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("ks"), F.sum(gap * width).alias("w1"), F.sum(gap * gap * width).alias("e2"))
    enough = F.least("n1", "n2") >= least
    return out.select(key, "n1", "n2", F.round(F.when(enough, F.col("ks")), 6).alias("ks"), F.round(F.when(enough, F.col("w1")), 5).alias("wasserstein"), F.round(F.when(enough, F.sqrt(2 * F.col("e2"))), 5).alias("energy"))


def anderson_darling(a: DataFrame, b: DataFrame, key: str = "g", least: int = 8) -> DataFrame:
    """The two-sample statistic with midranks (Scholz and Stephens 1987, eq. 7), before normalisation."""
    l = F.col("c1") + F.col("c2")
    x = running(value_counts(a, b, key), ["v"], (key,), s1="c1", s2="c2")
    x = x.select(key, "v", "c1", "c2", l.alias("l"), (F.col("s1_all") + F.col("s2_all")).alias("n"), F.col("s1_all").alias("n1"), F.col("s2_all").alias("n2"), (F.col("s1") + F.col("s2") - l / 2).alias("ba"), (F.col("s1") - F.col("c1") / 2).alias("m1"), (F.col("s2") - F.col("c2") / 2).alias("m2"))
    den = F.col("ba") * (F.col("n") - F.col("ba")) - F.col("n") * F.col("l") / 4
    x = x.withColumn("den", den).where("den > 0")
    term = lambda m, k: F.col("l") / F.col("n") * F.pow(F.col("n") * F.col(m) - F.col("ba") * F.col(k), F.lit(2)) / F.col("den") / F.col(k)
    s = x.groupBy(key).agg(F.max("n").alias("n"), F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.sum(term("m1", "n1") + term("m2", "n2")).alias("s"))
    a2 = F.col("s") * (F.col("n") - 1) / F.col("n")
    return s.where(F.least("n1", "n2") >= least).select(key, "n1", "n2", F.round(a2, 5).alias("ad"))


def motif_counts(edges: DataFrame, delta: int) -> DataFrame:
    """Eight two-node temporal motifs: directions of three successive events of a pair within delta seconds.

    motif is the number made of the three direction bits (1: from the larger id), first event highest.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") > F.col("dst")).cast("int").alias("d"), "t", "id")
    w = Window.partitionBy("a", "b").orderBy("t", "id")
    x = e.select("d", F.lead("d", 1).over(w).alias("d2"), F.lead("d", 2).over(w).alias("d3"), (F.lead("t", 2).over(w) - F.col("t")).alias("span"))
    return x.where(F.col("span") <= delta).groupBy((F.col("d") * 4 + F.col("d2") * 2 + F.col("d3")).cast("int").alias("motif")).agg(F.count("*").alias("n"))


def motif_distance(a: DataFrame, b: DataFrame, delta: int) -> DataFrame:
    """L1 distance of two graphs' normalised motif histograms."""
    share = lambda e, s: motif_counts(e, delta).select("motif", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(s))
    both = share(a, "p").join(share(b, "q"), "motif", "full")
    return both.agg(F.round(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), 6).alias("l1"))


def relative_gap(a: Column, b: Column) -> Column:
    return F.when(F.abs(a) + F.abs(b) > 0, F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(F.lit(0.0))


def bounded_gap(a: Column, b: Column, scale: float) -> Column:
    return F.least(F.lit(1.0), F.abs(a - b) / scale)


def quantities(edges: DataFrame) -> DataFrame:
    """g, v: degrees, source gaps, pair counts and events a day of a graph, for the two-sample distances."""
    deg = stats.degrees(edges).select(F.lit("degree").alias("g"), F.col("degree").cast("double").alias("v"))
    gap = stats.source_gaps(edges).where("gap is not null").select(F.lit("gap").alias("g"), F.col("gap").cast("double").alias("v"))
    pair = edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("v")).select(F.lit("pair").alias("g"), "v")
    day = stats.daily_counts(edges).select(F.lit("day").alias("g"), F.col("n").cast("double").alias("v"))
    return deg.unionAll(gap).unionAll(pair).unionAll(day)


def scorecard(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - mean of four KS distances and six scalar distances; a distance that can't be had is left out of the mean."""
    ks = two_sample_distances(quantities(a), quantities(b)).select(F.col("g").alias("metric"), F.col("ks").alias("distance"))
    one = lambda e, s: stats.graph_scalars(e).crossJoin(F.broadcast(stats.burstiness(e))).crossJoin(F.broadcast(stats.memory(e).drop("n"))).crossJoin(F.broadcast(stats.repeat_ratio(e))).select(*[F.col(c).cast("double").alias(f"{c}_{s}") for c in ("density", "reciprocity", "mean_degree", "burstiness", "memory", "repeat_ratio")])
    x = one(a, "a").crossJoin(F.broadcast(one(b, "b")))  # one row each
    pair = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    scalars = x.select(
        relative_gap(*pair("density")).alias("density"), bounded_gap(*pair("reciprocity"), 1.0).alias("reciprocity"), relative_gap(*pair("mean_degree")).alias("mean_degree"),
        bounded_gap(*pair("burstiness"), 2.0).alias("burstiness"), bounded_gap(*pair("memory"), 2.0).alias("memory"), bounded_gap(*pair("repeat_ratio"), 1.0).alias("repeat_ratio"),
    )
    long = scalars.unpivot([], scalars.columns, "metric", "distance")
    rows = ks.unionAll(long).select("metric", F.round("distance", 4).alias("distance"))
    score = rows.agg(F.lit("score").alias("metric"), F.round(1 - F.avg("distance"), 4).alias("distance"))
    return rows.unionAll(score)
