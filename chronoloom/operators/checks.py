"""Validation of an edge table: hard checks, legality constraints, sliding limits and folded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_violations(edges: DataFrame, order: str = "id") -> Column | DataFrame:
    """Rows whose time is before that of the row before them in stream order, found bucket by bucket of the order column.

    The order column is cut into ranges of 2^16; within one a window suffices, and each range's first row is compared
    with the last of the range before, so no task sorts the whole stream.
    """
    bucket = F.floor(F.col(order) / 65_536)
    rows = edges.select("t", F.col(order).alias("o"), bucket.alias("b"))
    rows = rows.withColumn("prev", F.lag("t").over(Window.partitionBy("b").orderBy("o")))
    last = rows.groupBy("b").agg(F.max_by("t", "o").alias("last"))
    before = last.select(F.col("b").alias("bb"), F.lag("last").over(Window.orderBy("b")).alias("before"))
    return rows.join(before, rows.b == before.bb, "left").where(F.col("t") < F.coalesce("prev", "before"))


def hard_checks(edges: DataFrame, n_nodes: int, types: list[str], labels: list[str]) -> DataFrame:
    """One row: rows, out of order, ids out of range, unknown types and labels, and the verdict."""
    late = order_violations(edges).agg(F.count("*").alias("out_of_order"))
    seen = edges.agg(
        F.count("*").alias("n"),
        F.count_if((F.col("src") >= n_nodes) | (F.col("dst") >= n_nodes) | (F.col("src") < 0) | (F.col("dst") < 0)).alias("id_out_of_range"),
        F.count_if(~F.coalesce(F.col("event_type").isin(types), F.lit(False))).alias("bad_type"),
        F.count_if(~F.coalesce(F.col("label").isin(labels), F.lit(False))).alias("bad_label"),
    )
    bad = F.col("out_of_order") + F.col("id_out_of_range") + F.col("bad_type") + F.col("bad_label")
    return seen.crossJoin(F.broadcast(late)).withColumn("verdict", F.when(bad == 0, "ok").otherwise("BROKEN"))  # one row each


def attribute_range(edges: DataFrame, rules: list[tuple[str, str, str, float | None, float | None]]) -> DataFrame:
    """rule, violations for (rule, event_type, attribute, least, most): all rules in one pass, nulls don't violate."""
    cols = []
    for name, event, attr, lo, hi in rules:
        v = F.col(attr)
        out = (F.lit(False) if lo is None else v < lo) | (F.lit(False) if hi is None else v > hi)
        cols.append(F.count_if((F.col("event_type") == event) & out).alias(name))
    return edges.agg(*cols).unpivot([], [c[0] for c in rules], "rule", "violations")


def near_threshold(edges: DataFrame, event: str, attr: str, floor: float, threshold: float) -> DataFrame:
    """Rows of the event with floor <= attribute < threshold."""
    return edges.where((F.col("event_type") == event) & (F.col(attr) >= floor) & (F.col(attr) < threshold))


def limit_violations(edges: DataFrame, k: int, window: int) -> DataFrame:
    """src, violations of at most k - 1 events in any `window` seconds, counted with reset.

    An ordered fold over each source's times: times older than t - window leave the queue, t enters it, and when it holds k
    a violation is counted and it empties. Rows stream through a Python generator in sorted order, of which Spark spills what
    doesn't fit; what is held is one queue of under k times, however many events a source has.
    """

    def fold(batches):
        import pyarrow as pa

        queue, src, count = [], None, 0
        for b in batches:
            out_s, out_v = [], []
            for s, t in zip(b.column("src").to_pylist(), b.column("t").to_pylist(), strict=True):
                if s != src:
                    if src is not None:
                        out_s.append(src)
                        out_v.append(count)
                    queue, src, count = [], s, 0
                queue = [x for x in queue if x >= t - window] + [t]
                if len(queue) >= k:
                    count, queue = count + 1, []
            yield pa.RecordBatch.from_arrays([pa.array(out_s, pa.int64()), pa.array(out_v, pa.int64())], ["src", "violations"])
        if src is not None:
            yield pa.RecordBatch.from_arrays([pa.array([src], pa.int64()), pa.array([count], pa.int64())], ["src", "violations"])

    rows = edges.select(F.col("src").cast("bigint").alias("src"), "t").repartition("src").sortWithinPartitions("src", "t")
    return rows.mapInArrow(fold, "src bigint, violations bigint")


#: The name under which it was first offered, beside a fold that gathered a source's times.
limit_violations_by_groups = limit_violations


def window_counts(edges: DataFrame, window: int) -> DataFrame:
    """Each row with the number of its source's rows in the window seconds up to it, itself included."""
    w = Window.partitionBy("src").orderBy("t").rangeBetween(-window, 0)
    return edges.withColumn("in_window", F.count("*").over(w))


def state_changes(edges: DataFrame, effects: dict[str, tuple[str, float]]) -> DataFrame:
    """node, t, id, delta. effects: event type to (side, sign); sign 0 counts 1, otherwise sign times value."""
    parts = None
    for event, (side, sign) in effects.items():
        delta = F.lit(1.0) if sign == 0 else F.lit(float(sign)) * F.col("value")
        part = edges.where((F.col("event_type") == event) & F.col("value").isNotNull()).select(F.col(side).alias("node"), "t", "id", delta.alias("delta"))
        parts = part if parts is None else parts.unionAll(part)
    return parts


def final_state(changes: DataFrame) -> DataFrame:
    """Sum of the changes of each node, in exact decimals so that the order doesn't matter."""
    return changes.groupBy("node").agg(F.sum(F.col("delta").cast("decimal(18,4)")).cast("double").alias("state"), F.count("*").alias("n"))


def final_state_with_set(changes: DataFrame, sets: DataFrame) -> DataFrame:
    """Last set wins, then only later changes count. sets: node, t, id, value."""
    last = sets.groupBy("node").agg(F.max_by("value", F.struct("t", "id")).alias("value"), F.max(F.struct("t", "id")).alias("at"))
    later = changes.join(last, "node", "full").where(F.col("at").isNull() | F.col("delta").isNull() | (F.struct("t", "id") > F.col("at")))
    sums = later.groupBy("node").agg(F.sum(F.col("delta").cast("decimal(18,4)")).alias("d"))
    return last.join(sums, "node", "full").select("node", (F.coalesce("value", F.lit(0.0)) + F.coalesce(F.col("d").cast("double"), F.lit(0.0))).alias("state"))


def negative_states(changes: DataFrame, initial: float = 0.0) -> DataFrame:
    """node, number of its changes after which its running state is under zero."""
    w = Window.partitionBy("node").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = changes.withColumn("state", F.lit(initial).cast("decimal(18,4)") + F.sum(F.col("delta").cast("decimal(18,4)")).over(w))
    return run.groupBy("node").agg(F.count_if(F.col("state") < 0).alias("negative"))
