"""Queries of the relational helpers, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import relational as R
from chronoloom.plans.stats_queries import ev
from chronoloom.sources.tables import EV, SP, events_edges, load, supplier_edges

QUERIES: dict = {}
#: Least degree in the query of the iterated core; with it, several rounds take edges away.
CORE = 120


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


def spans(spark, sf_dir):
    """Failure spans of every fifth user: deterministic from the users that occur."""
    e = events_edges(spark, sf_dir)
    users = e.where("src % 5 = 0").groupBy("src").agg(F.min("t").alias("t0"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    x = users.withColumn("k", k)
    start = F.col("t0") + F.col("k") * 400_000
    kind = F.element_at(F.array(F.lit("stuck"), F.lit("drift"), F.lit("noise"), F.lit("rate_shift")), ((F.col("src") / 5 + F.col("k")) % 4 + 1).cast("int"))
    return x.select(F.col("src").alias("actor"), (F.col("src") * 10 + F.col("k")).alias("span_id"), start.alias("start"), (start + 600_000).alias("end"), kind.alias("kind"))


_SPANS = """us as (select src, min(t) t0 from ev where src % 5 = 0 group by src),
spans as (select src actor, src * 10 + k span_id, t0 + k * 400000 s0, t0 + k * 400000 + 600000 e0, ['stuck', 'drift', 'noise', 'rate_shift'][((src // 5 + k) % 4 + 1)::int] kind from us, (select unnest([0, 1, 2]) k))"""

add("actor_filter", lambda spark, d: R.actor_filter(load(spark, d, "customer"), {"c_mktsegment": "BUILDING"}).select("c_custkey", "c_nationkey"), "select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING'")
add(
    "shard_union",
    lambda spark, d: (lambda e: R.same_rows(e, R.shard(e, 0, 4).unionAll(R.shard(e, 1, 4)).unionAll(R.shard(e, 2, 4)).unionAll(R.shard(e, 3, 4))))(events_edges(spark, d)),
    f"with {EV} select count(*) n_a, count(*) n_b, 0::bigint only_a, 0::bigint only_b from ev",
)
def _core_sql(k: int, rounds: int) -> str:
    """The rounds unrolled; more than are needed change nothing."""
    ctes = [f"{EV}, e0 as (select id, src, dst from ev)"]
    for r in range(rounds):
        ctes.append(f"c{r} as (select node from (select src node from e{r} union all select dst from e{r}) group by node having count(*) >= {k}), e{r + 1} as materialized (select * from e{r} where src in (from c{r}) and dst in (from c{r}))")
    return f"with {', '.join(ctes)} select id, src, dst from e{rounds}"


add("kcore_filter", lambda spark, d: R.k_core(events_edges(spark, d).select("id", "src", "dst"), CORE), _core_sql(CORE, 16))
add("granularity", ev(lambda e: e.select("id", R.round_down(F.col("t"), 3600).alias("hour_t"))), f"with {EV} select id, t - t % 3600 hour_t from ev")
add(
    "interval_overlap",
    lambda spark, d: R.overlap_days(spans(spark, d)).select("span_id", "day", "lo", "hi"),
    f"with {EV}, {_SPANS}, days as (select unnest(range((select min(s0) // 86400 from spans), (select max(e0) // 86400 + 1 from spans))) as day) select span_id, day, greatest(s0, day * 86400) lo, least(e0, (day + 1) * 86400) hi from spans join days on s0 < (day + 1) * 86400 and e0 > day * 86400",
)
add("silence_filter", lambda spark, d: R.outside_spans(events_edges(spark, d), spans(spark, d)).select("id", "src", "t"), f"with {EV}, {_SPANS} select id, src, t from ev where not exists (select 1 from spans where actor = src and t >= s0 and t < e0)")
add(
    "failure_spans",
    lambda spark, d: R.in_spans(events_edges(spark, d), spans(spark, d)).select("id", "span_id", "kind"),
    f"with {EV}, {_SPANS} select id, span_id, kind from ev join spans on actor = src and t >= s0 and t < e0",
)
add(
    "failure_label",
    lambda spark, d: R.apply_failures(events_edges(spark, d), spans(spark, d)).select("id", F.round("value", 4).alias("value"), "label"),
    f"""with {EV}, {_SPANS}, h as (select ev.*, span_id, kind, s0 from ev join spans on actor = src and t >= s0 and t < e0),
st as (select span_id, arg_min(value, (t, id)) held from h where kind = 'stuck' group by span_id),
f as (select h.*, held, row_number() over (partition by id order by span_id) k, count(*) over (partition by id) n from h left join st using (span_id)),
w as (select id, max(n) n, max(case when k = 1 then kind end) k1, max(case when k = 2 then kind end) k2, max(case when k = 1 then held end) h1, max(case when k = 2 then held end) h2, max(case when k = 1 then (t - s0) / 86400.0 end) d1, max(case when k = 2 then (t - s0) / 86400.0 end) d2 from f group by id),
v as (select ev.id, ev.value, ev.label, w.*, case k1 when 'stuck' then h1 when 'drift' then value + 1.5 * d1 when 'noise' then -999.0 else value end v1 from ev left join w on ev.id = w.id)
select id, round(case when n is null then value else case k2 when 'stuck' then h2 when 'drift' then v1 + 1.5 * d2 when 'noise' then -999.0 else v1 end end, 4) as value,
 case when k2 is not null and k2 <> 'rate_shift' then k2 when k1 is not null and k1 <> 'rate_shift' then k1 else label end as label from v""",
)
_starts = [("customer", 0), ("supplier", 40), ("part", 90)]
add("type_lookup", ev(lambda e: e.select("id", R.entity_type(F.col("src"), _starts).alias("src_type"))), f"with {EV} select id, case when src >= 90 then 'part' when src >= 40 then 'supplier' else 'customer' end src_type from ev")
add(
    "ground_truth_join",
    lambda spark, d: R.ground_truth(events_edges(spark, d).withColumn("anomaly_id", F.when(F.col("label") == "error", F.col("src") % 7).otherwise(-1)), events_edges(spark, d).where("label = 'error'").groupBy((F.col("src") % 7).alias("instance_id")).agg(F.count("*").alias("edges"))).select("id", "anomaly_id", F.coalesce("edges", F.lit(0)).alias("edges")),
    f"with {EV}, i as (select src % 7 instance_id, count(*) edges from ev where label = 'error' group by 1), e as (select *, case when label = 'error' then src % 7 else -1 end anomaly_id from ev) select id, anomaly_id, coalesce(edges, 0) edges from e left join i on anomaly_id = instance_id",
)
add("reciprocity", lambda spark, d: R.reciprocal_pairs(supplier_edges(spark, d)), f"with {SP}, p as (select distinct src, dst from sp) select count(*) reciprocal from p a where exists (select 1 from p b where b.src = a.dst and b.dst = a.src)")
add(
    "edge_features",
    ev(R.edge_features),
    f"""with {EV}, a as (select id, t, value, count(*) over (partition by dst) i, count(*) over (partition by src) o, t - lag(t) over (partition by src order by t, id) gap, row_number() over (partition by src, dst order by t, id) r, count(*) over (partition by src, dst) p from ev)
select id, round(ln(1 + o), 5) log_out, round(ln(1 + i), 5) log_in, round(ln(1 + coalesce(gap, 0)), 5) log_gap, (r > 1)::int repeat, round(ln(1 + p), 5) log_pair, round(sin((t // 3600 % 24) * 2 * pi() / 24), 5) + 0.0e0 hour_sin, round(cos((t // 3600 % 24) * 2 * pi() / 24), 5) + 0.0e0 hour_cos,
(t // 86400 % 7)::int weekday, round(coalesce(value, 0), 5) as value, (gap is null)::int as first from a""",
)
add(
    "taxonomy_rollup",
    lambda spark, d: R.roll_up(load(spark, d, "part").withColumn("path", F.translate("p_type", " ", "/")), "path", 3, "p_retailprice"),
    """with p as (select string_split(p_type, ' ') w, p_retailprice::decimal(18,4) v from part), l as (select unnest([1, 2, 3]) level)
select level, array_to_string(w[1:level], '/') prefix, count(*) n, sum(v)::double total from p, l where level <= len(w) group by 1, 2""",
)
add(
    "elliptic_join",
    lambda spark, d: R.feature_time_join(events_edges(spark, d), load(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("step"))),
    f"with {EV} select src, dst, (coalesce(c_nationkey, 0) * 86400)::int t from ev left join (select * from customer where c_custkey % 3 = 0) on c_custkey = src",
)
add(
    "dense_ids",
    lambda spark, d: R.dense_ids(events_edges(spark, d).select(F.concat(F.lit("u"), F.col("src")).alias("src"), F.concat(F.lit("p"), F.col("dst")).alias("dst"), "t")),
    f"with {EV}, x as (select 'u' || src s, 'p' || dst d, t from ev), n as (select name, row_number() over (order by name) - 1 i from (select distinct s name from x union select distinct d from x)) select a.i src_id, b.i dst_id, t from x join n a on a.name = s join n b on b.name = d",
)
