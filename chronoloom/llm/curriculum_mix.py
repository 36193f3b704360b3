"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the source's share of the token budget; the
cumulative demand of a source, inverted, gives each of its documents the time at which it is due. Documents are then
range-sorted by that time. A source may be taken more than once, up to a stated number of passes.

Everything is DataFrame code. Running totals over documents come from three levels of partial sums keyed by the hash
of doc_id (256 x 256 buckets, then single documents), so that no task gets all rows of a hot source.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, ordered last; repeated
rows count each (ties in the order are broken by doc_id, then size, then arbitrarily among equal rows, which take equal
places in sum); an empty table gives an empty result; columns beside doc_id, text and source are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD, materialize

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Slope of each weight's schedule: the rate at time t is proportional to 1 + slope * (2 t - 1); its integral is 1.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, budget: float = 1.5, max_passes: int = 2, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """One row per source: source_size, weight, slope, target.

    Targets share budget * total by weight; a source stops at max_passes times its size and its excess is shared
    again. The sources that stop are those with the smallest size / weight, so the fill level follows from running
    sums in that order; the windows run over one row per source.
    """
    n = len(weights)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % n + 1).cast("int"))
    ranked = by_source.withColumns({"weight": pick(weights), "slope": pick(slopes)})
    cap = F.col("source_size") * F.lit(float(max_passes))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("asked", F.sum("source_size").over(total) * F.lit(float(budget)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    # the first source in this order that stays at or under its cap sets the level for all after it
    level = (F.col("asked") - F.col("cap_before")) / F.col("weight_left")
    filled = filled.withColumn("level", F.when(F.col("weight") * level <= F.col("cap"), level))
    filled = filled.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))
    return filled.select("source", "source_size", "weight", "slope", F.least(target, F.col("cap")).alias("target"))


def due_time(share: Column, slope: Column) -> Column:
    """Inverts u = t + slope * (t^2 - t) for t in 0..1: the time at which a source's demand has reached share u."""
    b = F.lit(1.0) - slope
    root = (F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0))) - b) / (F.lit(2.0) * slope)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)))


def place_documents(docs: DataFrame, budget: float = 1.5, max_passes: int = 2, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, starts (words of its source before it), slope."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("k")), "mix-sizes")
    targets = source_targets(slim, budget, max_passes, weights, slopes)
    rows = slim.withColumns({"a": F.substring("k", 1, 2), "b": F.substring("k", 1, 4)})
    fine = rows.groupBy("source", "a", "b").agg(F.sum("size").alias("s"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy("source", "a").agg(F.sum("s").alias("s"))
    coarse = coarse.select(F.col("source").alias("cs"), F.col("a").alias("ca"), F.coalesce(F.sum("s").over(before("source", "a")), F.lit(0)).alias("base_a"))
    fine = fine.select(F.col("source").alias("fs"), F.col("a").alias("fa"), F.col("b").alias("fb"), F.coalesce(F.sum("s").over(before("source", "a", "b")), F.lit(0)).alias("base_b"))
    in_bucket = Window.partitionBy("source", "b").orderBy("k", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("base_c", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    bases = fine.join(coarse, F.col("fs").eqNullSafe(F.col("cs")) & (F.col("fa") == F.col("ca")))
    bases = bases.select("fs", "fb", (F.col("base_a") + F.col("base_b")).alias("base"))
    t = targets.select(F.col("source").alias("ts"), "source_size", "target", "slope")
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("fs")) & (F.col("b") == F.col("fb"))).join(t, F.col("source").eqNullSafe(F.col("ts")))
    starts = F.col("base") + F.col("base_c")
    left = F.floor(F.col("target")) - starts
    taken = F.lit(0).cast("bigint")
    for i in range(max_passes):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), left - F.lit(i) * F.col("source_size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), starts.alias("starts"), "slope")


def passes(max_passes: int = 2) -> Column:
    """For a row of place_documents, an array of the passes in which the document is taken: pass, words, position (0..1)."""

    def one(i: int) -> Column:
        before = F.col("starts") + F.lit(i) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")) - before)).cast("bigint")
        return F.struct(F.lit(i).alias("pass"), words.alias("words"), F.when(words > 0, due_time(before / F.col("target"), F.col("slope"))).alias("position"))

    return F.filter(F.array(*[one(i) for i in range(max_passes)]), lambda x: x["words"] > 0)


def schedule(placed: DataFrame, max_passes: int = 2) -> DataFrame:
    """One row per document and pass in which it is taken: doc_id, source, pass, words, position (0..1), range-sorted by position."""
    spread = placed.withColumn("taking", F.explode(passes(max_passes)))
    return spread.select("doc_id", "source", "taking.pass", "taking.words", "taking.position").orderBy("position", "doc_id", "pass")


def mix_stage(docs: DataFrame) -> DataFrame:
    """The operator's result, which is the pipeline's last stage: a row per document with its place in the curriculum, range-sorted
    by first position.

    passes has an entry for each pass in which the document is taken, with the words taken and the position, so exploding it
    gives the rows of schedule(); taken and position are read from it. A document with taken = 0 isn't in the mix: it has no
    passes and a null position, and stays, last, so that the result accounts for every document of the stage before."""
    placed = place_documents(docs).withColumn("passes", passes())
    taken = F.aggregate("passes", F.lit(0).cast("bigint"), lambda total, x: total + x["words"])
    position = F.when(F.size("passes") > 0, F.col("passes")[0]["position"])
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), position.alias("position"), "passes").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_digest(docs: DataFrame) -> DataFrame:
    """The rows of mix_stage in its order, with the columns of ORACLE: all passes' words as taken, and the first one's position."""
    return mix_stage(docs).drop("passes")


ORACLE = r"""
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, '')) k,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, (row_number() over (order by source nulls last) - 1) % 3 k from s),
w as (select source, source_size, [3.0, 1.0, 2.0][k + 1]::double weight, [-0.5, 0.0, 0.5][k + 1]::double slope, 2.0 * source_size::double cap from r),
f as (select *, 1.5 * (sum(source_size) over ())::double asked,
             coalesce(sum(cap) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) cap_before,
             sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) weight_left from w),
l as (select *, case when weight * ((asked - cap_before) / weight_left) <= cap then (asked - cap_before) / weight_left end level from f),
g as (select source, source_size, slope, cap, weight,
             first_value(level ignore nulls) over (order by source_size / weight, source nulls last rows between unbounded preceding and current row) level from l),
t as (select source, source_size, slope, least(coalesce(weight * level, cap), cap) target from g),
p as (select d.doc_id, d.size, t.source_size, t.target, t.slope,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint starts
      from d join t on d.source is not distinct from t.source),
q as (select *, (greatest(0, least(size, floor(target)::bigint - starts)) + greatest(0, least(size, floor(target)::bigint - starts - source_size)))::bigint taken,
             starts / target u from p)
select doc_id, size, source_size, target, taken,
       case when taken > 0 then case when abs(slope) < 1e-9 then u
            else least(greatest((sqrt(greatest((1.0 - slope) * (1.0 - slope) + 4.0 * slope * u, 0.0)) - (1.0 - slope)) / (2.0 * slope), 0.0), 1.0) end end as position
from q
"""
