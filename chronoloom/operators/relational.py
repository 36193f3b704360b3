"""Filters, lookups and interval joins that the workbench is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ranges import running
from chronoloom.session import cut


def actor_filter(nodes: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Conjunction of equalities on categorical columns; a numeric or unknown column is an error."""
    for c in conditions:
        kind = dict(nodes.dtypes).get(c)
        if kind != "string":
            raise ValueError(f"{c}: not a categorical column ({kind})")
        nodes = nodes.where(F.col(c) == conditions[c])
    return nodes


def shard(edges: DataFrame, index: int, count: int, key: str = "src") -> DataFrame:
    return edges.where(F.pmod(F.col(key), F.lit(count)) == index)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes and how many rows either side has more of, as multisets."""
    x = a.groupBy(*a.columns).agg(F.count("*").alias("na"), F.lit(0).cast("bigint").alias("nb")).unionAll(b.groupBy(*a.columns).agg(F.lit(0).cast("bigint").alias("na"), F.count("*").alias("nb")))
    y = x.groupBy(*a.columns).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return y.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("only_b"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges both of whose ends have total degree k or more among the edges that stay; repeated to the fixed point.

    Each round is a count of the ends and two semi joins; lineage is cut by checkpoint().
    """
    n = edges.count()
    while True:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).where(F.col("d") >= k).select("node")
        kept = cut(edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        m = kept.count()
        if m in (n, 0):
            return kept.select(*edges.columns)
        edges, n = kept.select(*edges.columns), m


def round_down(t: Column, granularity: int) -> Column:
    return t - F.pmod(t, F.lit(granularity))


def overlap_days(spans: DataFrame, day: int = 86_400) -> DataFrame:
    """A row for each day that a span [start, end) touches, with the part of it in that day.

    The interval join of spans and days as an explode of each span's own days: no theta join.
    """
    days = F.sequence(F.floor(F.col("start") / day), F.floor((F.col("end") - 1) / day))
    x = spans.where("end > start").withColumn("day", F.explode(days))
    return x.withColumns({"lo": F.greatest("start", F.col("day") * day).cast("bigint"), "hi": F.least("end", (F.col("day") + 1) * day).cast("bigint")})


def in_spans(edges: DataFrame, spans: DataFrame, bucket: int = 86_400) -> DataFrame:
    """Each edge with each span of its source that holds its time: an equi-join on source and time bucket plus the range check."""
    s = overlap_days(spans, bucket).select(F.col("actor").alias("src"), F.col("day").alias("b"), "start", "end", "span_id", "kind")
    x = edges.withColumn("b", F.floor(F.col("t") / bucket))
    return x.join(s, ["src", "b"]).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("b")


def outside_spans(edges: DataFrame, spans: DataFrame, bucket: int = 86_400) -> DataFrame:
    """Edges in no span of their source: the silence predicate as an anti join."""
    s = overlap_days(spans, bucket).select(F.col("actor").alias("src"), F.col("day").alias("b"), "lo", "hi")
    x = edges.withColumn("b", F.floor(F.col("t") / bucket))
    return x.join(s, (x.src == s.src) & (x.b == s.b) & (x.t >= s.lo) & (x.t < s.hi), "left_anti").drop("b")


def apply_failures(edges: DataFrame, spans: DataFrame, noise: float = -999.0, drift_per_day: float = 1.5, attr: str = "value") -> DataFrame:
    """Failure effects in span order: stuck repeats the span's first value, drift adds days since its start, noise overwrites.

    The spans of a row are folded in order of span id, so several effects act one upon the other. The last one labels it.
    """
    hit = in_spans(edges, spans)
    first = hit.where("kind = 'stuck'").groupBy("span_id").agg(F.min_by(attr, F.struct("t", "id")).alias("held"))
    hit = hit.join(first, "span_id", "left")
    fold = hit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("span_id", "kind", "start", "held", "t"))).alias("fx"))
    x = edges.join(fold, "id", "left")
    value = F.aggregate(
        "fx",
        F.col(attr).cast("double"),
        lambda v, f: F.when(f["kind"] == "stuck", f["held"]).when(f["kind"] == "drift", v + F.lit(drift_per_day) * (f["t"] - f["start"]) / 86_400.0).when(f["kind"] == "noise", F.lit(noise)).otherwise(v),
    )
    label = F.element_at(F.filter("fx", lambda f: f["kind"] != "rate_shift"), -1)["kind"]
    return x.select("id", "src", "t", F.when(F.col("fx").isNull(), F.col(attr)).otherwise(value).alias(attr), F.coalesce(F.when(F.size(F.filter("fx", lambda f: f["kind"] != "rate_shift")) > 0, label), F.col("label")).alias("label"))


def entity_type(node: Column, starts: list[tuple[str, int]]) -> Column:
    """Last type whose first id is at or under the node; starts ascend. A CASE, as there is one branch for each type of the schema."""
    out = F.lit(None).cast("string")
    for name, start in starts:
        out = F.when(node >= start, F.lit(name)).otherwise(out)
    return out


def ground_truth(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """Labelled edges with their anomaly instance. Spark broadcasts the instances where they are small."""
    return edges.join(instances, edges.anomaly_id == instances.instance_id, "left")


def reciprocal_pairs(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst").distinct()
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return pairs.join(back, ["src", "dst"], "left_semi").agg(F.count("*").alias("reciprocal"))


def edge_features(edges: DataFrame, attr: str = "value") -> DataFrame:
    """Ten features of each edge that name no node: degrees, gap, repeats, attribute and cyclic time."""
    src, pair = Window.partitionBy("src"), Window.partitionBy("src", "dst")
    in_deg = edges.groupBy(F.col("dst").alias("dst")).agg(F.count("*").alias("in_dst"))
    x = edges.join(in_deg, "dst")
    x = x.select(
        "id", "src", "t", attr, "in_dst", F.count("*").over(src).alias("out_src"), (F.col("t") - F.lag("t").over(src.orderBy("t", "id"))).alias("gap"),
        (F.row_number().over(pair.orderBy("t", "id")) > 1).cast("int").alias("repeat"), F.count("*").over(pair).alias("pair_n"),
    )
    hour = F.pmod(F.floor(F.col("t") / 3600), F.lit(24))
    angle = hour * F.lit(2 * 3.141592653589793 / 24)
    return x.select(
        "id", F.round(F.log1p("out_src"), 5).alias("log_out"), F.round(F.log1p("in_dst"), 5).alias("log_in"), F.round(F.log1p(F.coalesce("gap", F.lit(0))), 5).alias("log_gap"), "repeat", F.round(F.log1p("pair_n"), 5).alias("log_pair"),
        F.round(F.sin(angle), 5).alias("hour_sin"), F.round(F.cos(angle), 5).alias("hour_cos"), F.pmod(F.floor(F.col("t") / 86_400), F.lit(7)).cast("int").alias("weekday"), F.round(F.coalesce(F.col(attr), F.lit(0.0)), 5).alias("value"), F.col("gap").isNull().cast("int").alias("first"),
    )


def roll_up(rows: DataFrame, path: str, levels: int, measure: str) -> DataFrame:
    """Totals at each level of a slash-separated path: one pass over the leaves' totals, each sent to its prefixes."""
    leaves = rows.groupBy(path).agg(F.count("*").alias("n"), F.sum(F.col(measure).cast("decimal(18,4)")).alias("s"))
    x = leaves.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).where(F.col("level") <= F.size(F.split(path, "/")))
    x = x.groupBy("level", F.expr(f"substring_index({path}, '/', level)").alias("prefix"))
    return x.agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"))


def feature_time_join(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Edges with the time step of their source's features, 0 where there are none, in days."""
    return edges.join(features.select(F.col("node").alias("src"), "step"), "src", "left").select("src", "dst", (F.coalesce("step", F.lit(0)) * 86_400).alias("t"))


def dense_ids(edges: DataFrame) -> DataFrame:
    """Ends of any type as consecutive numbers in order, numbered over distinct values by ranges."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    ids = running(names, ["name"], nid=F.lit(1).cast("bigint")).select("name", (F.col("nid") - 1).alias("nid"))
    s, d = ids.select(F.col("name").alias("src"), F.col("nid").alias("src_id")), ids.select(F.col("name").alias("dst"), F.col("nid").alias("dst_id"))
    return edges.join(s, "src").join(d, "dst").select("src_id", "dst_id", "t")
