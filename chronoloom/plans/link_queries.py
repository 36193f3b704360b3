"""Queries of the link prediction family, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.hashrand import STATIC, u_sql
from chronoloom.operators import link as L
from chronoloom.operators import stats as S
from chronoloom.plans.stats_queries import GAPS, ev
from chronoloom.sources.tables import EV, events_edges

QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


_RANK = "rk as (select *, row_number() over (order by t, id) as rank, count(*) over () total from ev)"
add("chrono_split", ev(lambda e: L.chronological_split(e).select("id", "split")), f"with {EV}, {_RANK} select id, case when (rank - 1) / total < 0.7e0 then 'train' when (rank - 1) / total < 0.85e0 then 'validate' else 'test' end split from rk")
_NEG = f"floor({u_sql(STATIC, '1', 'id')} * 1000)::bigint"
add("negatives", ev(lambda e: L.negatives(e, 1000)), f"with {EV} select id, src, t, {_NEG} dst from ev")


def _bank(memory: float | None) -> str:
    near = "true" if memory is None else f"t - last <= {memory} * (select max(t) - min(t) from ev)"
    return f"""{EV}, {_RANK}, b as (select *, ((rank - 1) // 200)::int batch from rk),
cand as (select id, batch, src, dst, t, 1 r from b union all select id, batch, src, {_NEG}, t, 0 from b),
s as (select *, max(case when r = 1 then t end) over (partition by src, dst order by batch range between unbounded preceding and 1 preceding) last from cand),
bank as (select id, batch, max(case when r = 1 then (last is not null and {near})::int end) positive, max(case when r = 0 then (last is not null and {near})::int end) negative from s group by 1, 2)"""


add("edgebank_scores", ev(lambda e: L.edge_bank(e, 1000)), f"with {_bank(None)} select * from bank")
add("edgebank_window_scores", ev(lambda e: L.edge_bank(e, 1000, memory=0.15)), f"with {_bank(0.15)} select * from bank")


def _pairs(e):
    bank = L.edge_bank(e, 1000)
    return bank.select(F.col("positive").alias("score"), F.lit(1).alias("label")).unionAll(bank.select(F.col("negative").alias("score"), F.lit(0).alias("label")))


_METRIC = """c as (select score, sum(label) p, sum(1 - label) q from sc group by score),
x as (select *, coalesce(sum(q) over (order by score rows between unbounded preceding and 1 preceding), 0) below, sum(p) over (order by score desc) tp, sum(q) over (order by score desc) fp, sum(p) over () np, sum(q) over () nq from c)
select round(sum(p * (below + q / 2)) / max(np * nq), 6) auc, round(sum(p / np * tp / (tp + fp)), 6) ap from x"""
add("edgebank_auc", ev(lambda e: L.ranking_metrics(_pairs(e))), f"with {_bank(None)}, sc as (select positive score, 1 as label from bank union all select negative, 0 from bank), {_METRIC}")
add("value_error_auc", ev(lambda e: L.ranking_metrics(e.where("value is not null").select(F.round("value").alias("score"), (F.col("label") == "error").cast("int").alias("label")))), f"with {EV}, sc as (select round(value) score, (label = 'error')::int as label from ev where value is not null), {_METRIC}")
add(
    "edgebank_batch_ap",
    ev(lambda e: L.batch_average_precision(L.edge_bank(e, 1000))),
    f"with {_bank(None)}, x as (select batch, sum(positive) tp, sum(negative) fp, count(*) n from bank group by 1) select count(*) batches, round(avg(case when tp > 0 then tp / n * tp / (tp + fp) else 0 end + (n - tp) / n * 0.5), 6) mean_ap from x",
)
add(
    "recent_neighbors",
    ev(L.recent_neighbours),
    f"with {EV}, x as (select src node, dst other, 0 side, t, id from ev union all select dst, src, 1, t, id from ev), r as (select node, row_number() over (partition by node order by t desc, id desc, side) as rank, other from x) select node, rank::int as rank, other from r where rank <= 20",
)
add(
    "degree_rank_codec",
    ev(L.degree_rank_codec),
    f"with {EV}, c as (select src v, count(*) c from ev group by 1), r as (select v, row_number() over (order by c, v) - 1 r, count(*) over () n from c), x as (select id, (r + {u_sql(STATIC, '2', 'id')}) / n code, n from ev join r on v = src) select id, round(code, 9) code, v decoded from x join r on least(floor(code * x.n), x.n - 1) = r.r",
)
_step = lambda s: f"""w{s} as (select walk, dst node, t from (select a.walk, e.dst, e.t, row_number() over (partition by a.walk order by e.t, e.id) k, count(*) over (partition by a.walk) n from w{s - 1} a join ev e on e.src = a.node and e.t >= a.t) x where k = 1 + floor({u_sql(STATIC, '3', 'walk', str(s))} * n)::int)"""
add(
    "temporal_walks",
    ev(lambda e: L.temporal_walks(e, e.groupBy(F.col("src").alias("node")).agg(F.min("t").alias("t")).withColumn("walk", F.col("node")), 4)),
    f"with {EV}, w0 as (select src walk, src node, min(t) t from ev group by src), {', '.join(_step(s) for s in range(1, 5))} " + " union all ".join(f"select walk, {s}::int step, node, t from w{s}" for s in range(5)),
)
add(
    "gap_buckets",
    ev(lambda e: L.gap_buckets(S.source_gaps(e))),
    f"with {EV}, {GAPS}, c as (select gap, count(*) c from g where gap is not null group by 1), x as (select gap, c, sum(c) over (order by gap) - c bef, sum(c) over () n from c) select floor(bef * 16 / n)::int bucket, sum(c)::bigint n, round(sum(ln(1 + gap) * c) / sum(c), 5) mean_log from x group by 1",
)
add("stream_ranks", lambda spark, d: L.stream_ranks(events_edges(spark, d)).select("id", "rank"), f"with {EV}, {_RANK} select id, rank from rk")
