"""One-pass and windowed statistics over an edge table (src, dst, t, event_type, label, ..., id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ranges import ranged, running

DAY = 86_400


def totals(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def counts_by_name(edges: DataFrame, col: str, names: list[str]) -> DataFrame:
    """A row for each declared name in order, zero where there are no events. names is a schema-sized list."""
    declared = edges.sparkSession.createDataFrame(list(enumerate(names)), "pos int, name string")
    found = edges.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n"))
    return declared.join(found, "name", "left").select("pos", "name", F.coalesce("n", F.lit(0)).alias("n"))


def daily_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree: one shuffle of both directions' partial counts."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count("*").alias("degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.agg(F.count("*").alias("active"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"))


def log2_bin(x: Column) -> Column:
    return F.floor(F.log2(x)).cast("int")


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy(F.least(log2_bin(F.col("degree")), F.lit(32)).alias("bin")).agg(F.count("*").alias("n"))


def distinct_counts(edges: DataFrame) -> DataFrame:
    """Exact distinct sources, targets and pairs, each from a two-level aggregation."""
    return edges.agg(F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.countDistinct("src", "dst").alias("n_pairs"))


def distinct_estimates(edges: DataFrame) -> DataFrame:
    """The same from HyperLogLog sketches: one pass, constant state, mergeable."""
    pair = F.xxhash64("src", "dst")
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(14)))
    return edges.agg(sketch(F.col("src")).alias("n_src"), sketch(F.col("dst")).alias("n_dst"), sketch(pair).alias("n_pairs"))


def repeat_ratio(edges: DataFrame) -> DataFrame:
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.agg(F.round(F.greatest(F.lit(0.0), 1 - F.count("*") / F.sum("n")), 6).alias("repeat_ratio"))


def attribute_moments(edges: DataFrame, cols: list[str]) -> DataFrame:
    """n, mean, sample deviation (0 for one value), least and largest of each numeric attribute, nulls and NaN left out."""
    v = F.when(~F.isnan("v"), F.col("v"))
    long = edges.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("double").alias("v")) for c in cols])).alias("a")).select("a.*")
    out = long.groupBy("attr").agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return out.select("attr", "n", F.round("m", 4).alias("mean"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("std"), F.col("lo").alias("min"), F.col("hi").alias("max"))


def exact_quantiles(edges: DataFrame, by: str, col: str, probs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The value at rank floor((n - 1) p), for each group and p, from counts of distinct values and their running totals by ranges."""
    counts = edges.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("c"))
    ranked = running(counts, [col], (by,), upto="c")
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("upto_all") - 1) * F.lit(p)), F.col(col))).alias(f"p{round(p * 100)}") for p in probs]
    return ranked.groupBy(by).agg(*at)


def approx_quantiles(edges: DataFrame, by: str, col: str, accuracy: int = 10_000) -> DataFrame:
    return edges.groupBy(by).agg(F.percentile_approx(col, [0.5, 0.9, 0.99], accuracy).alias("q"))


def categorical_histogram(edges: DataFrame, col: str, values: list[str]) -> DataFrame:
    return counts_by_name(edges, col, values).select(F.col("name").alias("value"), "n")


def top_nodes(edges: DataFrame, col: str, k: int = 20) -> DataFrame:
    """Heavy hitters, exactly; ties by id. A top-k: the limit is the feature."""
    return edges.groupBy(F.col(col).alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(k)


def stream_gaps(edges: DataFrame) -> DataFrame:
    """Gap to the previous row of the whole stream, ordered by (t, id), without a window over all rows in one task.

    Within a range of the order the gap is a lag; the first row of a range takes the last time of the range before, from
    a window over one row a range.
    """
    w = Window.partitionBy("part_").orderBy("t", "id")
    rows = ranged(edges.select("t", "id"), "t", "id").withColumn("prev", F.lag("t").over(w))
    ends = rows.groupBy("part_").agg(F.max("t").alias("end"))
    before = ends.select(F.col("part_").alias("p"), F.lag("end").over(Window.orderBy("part_")).alias("before"))
    return rows.join(before, rows.part_ == before.p).select("t", "id", (F.col("t") - F.coalesce("prev", "before")).alias("gap"))


def stream_gap_moments(edges: DataFrame) -> DataFrame:
    g = stream_gaps(edges).where("gap is not null")
    return g.agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 4).alias("mean"), F.round(F.stddev_samp("gap"), 4).alias("std"), F.min("gap").alias("min"), F.max("gap").alias("max"))


def source_gaps(edges: DataFrame) -> DataFrame:
    """src, t, id, gap to the source's previous event, and the gap before that."""
    w = Window.partitionBy("src").orderBy("t", "id")
    gaps = edges.select("src", "t", "id", (F.col("t") - F.lag("t").over(w)).alias("gap"))
    return gaps.withColumn("gap_before", F.lag("gap").over(w))


def burstiness(edges: DataFrame) -> DataFrame:
    """(sd - mean) / (sd + mean) of all sources' gaps; null under two gaps or where the sum isn't positive."""
    g = source_gaps(edges).agg(F.count("gap").alias("n"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"))
    ok = (F.col("n") >= 2) & (F.col("s") + F.col("m") > 0)
    return g.select("n", F.round(F.when(ok, (F.col("s") - F.col("m")) / (F.col("s") + F.col("m"))), 6).alias("burstiness"))


def memory(edges: DataFrame) -> DataFrame:
    """Correlation of each gap with the same source's gap before."""
    g = source_gaps(edges).where("gap is not null and gap_before is not null")
    return g.agg(F.count("*").alias("n"), F.round(F.corr(F.col("gap_before").cast("double"), F.col("gap").cast("double")), 6).alias("memory"))


def gap_histogram(edges: DataFrame) -> DataFrame:
    g = source_gaps(edges).where("gap is not null")
    return g.groupBy(F.when(F.col("gap") < 1, 0).otherwise(F.least(log2_bin(F.col("gap")), F.lit(31))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def graph_scalars(edges: DataFrame) -> DataFrame:
    """Edges, nodes, distinct pairs, density, reciprocity (a loop is its own reverse) and mean degree.

    Reciprocity needs no self join: a pair and its reverse share the key (least, greatest), and a group of two directions
    is reciprocal.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = pairs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("dirs"))
    m = both.agg(F.sum("n").alias("n_edges"), F.sum("dirs").alias("n_pairs"), F.sum(F.when((F.col("dirs") == 2) | (F.col("a") == F.col("b")), F.col("dirs")).otherwise(0)).alias("mutual"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("n_nodes"))
    x = m.crossJoin(F.broadcast(nodes))  # one row each
    return x.select(
        "n_edges", "n_nodes", "n_pairs", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 8).alias("density"),
        F.round(F.col("mutual") / F.col("n_pairs"), 6).alias("reciprocity"), F.round(2 * F.col("n_edges") / F.col("n_nodes"), 6).alias("mean_degree"),
    )


def activity_timeline(edges: DataFrame, buckets: int = 200) -> DataFrame:
    span = edges.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    x = edges.select("t").crossJoin(F.broadcast(span))  # one row
    b = F.least(F.floor((F.col("t") - F.col("t0")) * buckets / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))), F.lit(buckets - 1))
    return x.groupBy(b.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def power_law_fit(edges: DataFrame, candidates: int = 60, drop_last: int = 5, least_tail: int = 10, least_nodes: int = 50) -> DataFrame:
    """Exponent by maximum likelihood for the cut-off with the least Kolmogorov-Smirnov distance (Clauset et al. 2009).

    Works on the degree histogram: its rows are distinct degrees, whatever the number of nodes. Up to `candidates`
    cut-offs, spread evenly over the distinct degrees without the last few, are tried in one join with the histogram.
    """
    hist = degrees(edges).groupBy("degree").agg(F.count("*").alias("c"))
    one = Window.orderBy("degree")
    ranked = hist.select("degree", "c", (F.row_number().over(one) - 1).alias("r"), F.count("*").over(Window.partitionBy()).alias("u"), F.sum("c").over(Window.partitionBy()).alias("nodes"))
    usable = ranked.where(F.col("r") < F.col("u") - drop_last)
    m = F.col("u") - drop_last
    step = F.floor(F.col("r") * F.lit(candidates) / m)
    first = Window.partitionBy("step").orderBy("r")
    cuts = usable.withColumn("step", step).withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("degree").alias("xmin"), "nodes").where(F.col("nodes") >= least_nodes)
    tail = F.broadcast(cuts).join(hist, hist.degree >= F.col("xmin"))
    fits = tail.groupBy("xmin").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log(F.col("degree") / F.col("xmin"))).alias("s")).where((F.col("n") >= least_tail) & (F.col("s") > 0))
    fits = fits.select("xmin", "n", (1 + F.col("n") / F.col("s")).alias("alpha"))
    w = Window.partitionBy("xmin").orderBy("degree")
    dist = tail.drop("nodes").join(fits, "xmin").withColumn("cdf", F.sum("c").over(w) / F.col("n"))
    gap = F.abs(F.col("cdf") - (1 - F.pow(F.col("degree") / F.col("xmin"), 1 - F.col("alpha"))))
    ks = dist.groupBy("xmin", "n", "alpha").agg(F.max(gap).alias("ks"))
    best = ks.orderBy(F.round("ks", 9), "xmin").limit(1)
    return best.select("xmin", F.col("n").alias("n_tail"), F.round("alpha", 5).alias("alpha"), F.round("ks", 5).alias("ks"))


def simple_neighbours(edges: DataFrame) -> DataFrame:
    """a < b: undirected distinct edges without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def clustering(edges: DataFrame, sample: int = 2000) -> DataFrame:
    """Mean local clustering coefficient over up to `sample` nodes of degree 2 or more, those with the smallest md5.

    Triangles are counted at sampled nodes only. Edges point from the end of lower degree to the other, so that no node has
    more than sqrt(2 edges) of them; those of a sampled node's neighbours are followed, and looked up among its neighbours.
    Pairs of neighbours are never made.
    """
    e = simple_neighbours(edges)
    adj = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("x")).select("x.*")
    degree = adj.groupBy("v").agg(F.count("*").alias("k"))
    nodes = degree.where("k >= 2")
    picked = nodes.orderBy(F.md5(F.col("v").cast("string").cast("binary")), "v").limit(sample)
    own = adj.join(F.broadcast(picked.select("v")), "v")
    ka, kb = degree.select(F.col("v").alias("a"), F.col("k").alias("ka")), degree.select(F.col("v").alias("b"), F.col("k").alias("kb"))
    up = F.struct("ka", "a") < F.struct("kb", "b")
    pointed = e.join(ka, "a").join(kb, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("w"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("x"))
    closed = own.join(pointed, "w").select("v", "x").join(own.withColumnRenamed("w", "x"), ["v", "x"]).groupBy("v").agg(F.count("*").alias("tri"))
    local = picked.join(closed, "v", "left").select((2 * F.coalesce("tri", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("cc"))
    return local.agg(F.count("*").alias("n"), F.round(F.avg("cc"), 6).alias("clustering"))


def repeat_flags(edges: DataFrame) -> DataFrame:
    w = Window.partitionBy("src", "dst").orderBy("t", "id")
    return edges.select("id", (F.row_number().over(w) > 1).cast("int").alias("repeat"))


def previous_gap(edges: DataFrame) -> DataFrame:
    return source_gaps(edges).select("src", "id", "gap")


def battery(edges: DataFrame) -> DataFrame:
    """The flagship report: one row per event type with totals, distinct ends, repeats, burstiness and memory."""
    w = Window.partitionBy("event_type", "src").orderBy("t", "id")
    g = edges.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("before", F.lag("gap").over(w))
    g = g.withColumn("first", (F.row_number().over(Window.partitionBy("event_type", "src", "dst").orderBy("t", "id")) == 1).cast("int"))
    both = F.col("gap").isNotNull() & F.col("before").isNotNull()
    x = g.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.sum("first").alias("n_pairs"),
        F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"), F.corr(F.when(both, F.col("before").cast("double")), F.when(both, F.col("gap").cast("double"))).alias("r"),
    )
    return x.select("event_type", "n", "n_src", "n_dst", "n_pairs", F.round(1 - F.col("n_pairs") / F.col("n"), 6).alias("repeat_ratio"), F.round((F.col("s") - F.col("m")) / (F.col("s") + F.col("m")), 6).alias("burstiness"), F.round("r", 6).alias("memory"))
