"""Queries of the statistics family over the driver tables, each with its oracle."""

from __future__ import annotations

from chronoloom.operators import stats as S
from chronoloom.sources.tables import EV, OE, SP, events_edges, order_edges, supplier_edges

TYPES = ["view", "signup", "purchase", "error", "click", "refund"]

QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


def ev(f):
    return lambda spark, d: f(events_edges(spark, d))


def sp(f):
    return lambda spark, d: f(supplier_edges(spark, d))


def oe(f):
    return lambda spark, d: f(order_edges(spark, d))


DEG = "deg as (select node, count(*) degree, sum(o)::bigint out_degree, sum(i)::bigint in_degree from (select src node, 1 o, 0 i from ev union all select dst, 0, 1 from ev) group by node)"
GAPS = "g0 as (select src, t, id, t - lag(t) over (partition by src order by t, id) gap from ev), g as (select *, lag(gap) over (partition by src order by t, id) gap_before from g0)"

add("edge_totals", ev(S.totals), f"with {EV} select count(*) n, min(t) t_min, max(t) t_max from ev")
add(
    "events_per_type",
    ev(lambda e: S.counts_by_name(e, "event_type", TYPES)),
    f"with {EV}, names as (select * from (values {', '.join(f'({i}, {n!r})' for i, n in enumerate(TYPES))}) v(pos, name)) select pos, name, coalesce(n, 0) n from names left join (select event_type name, count(*) n from ev group by 1) using (name)",
)
add("daily_counts", ev(S.daily_counts), f"with {EV} select floor(t / 86400)::bigint as day, count(*) n from ev group by 1")
add("degree_summary", ev(S.degree_summary), f"with {EV}, {DEG} select count(*) active, round(avg(degree), 6) mean_degree, max(degree) max_degree, max(out_degree) max_out, max(in_degree) max_in from deg")
add("degree_log2_hist", ev(S.degree_histogram), f"with {EV}, {DEG} select least(floor(log2(degree)), 32)::int bin, count(*) n from deg group by 1")
add("distinct_pairs", ev(S.distinct_counts), f"with {EV} select count(distinct src) n_src, count(distinct dst) n_dst, count(distinct (src, dst)) n_pairs from ev")
add("repeat_ratio", ev(S.repeat_ratio), f"with {EV} select round(greatest(0, 1 - count(distinct (src, dst)) / count(*)), 6) repeat_ratio from ev")
add(
    "attr_moments",
    oe(lambda e: S.attribute_moments(e, ["amount", "quantity", "discount"])),
    f"with {OE}, l as (select 'amount' attr, amount v from oe union all select 'quantity', quantity from oe union all select 'discount', discount from oe) "
    "select attr, count(v) n, round(avg(v), 4) mean, round(coalesce(stddev_samp(v), 0), 4) std, min(v) min, max(v) max from l where not isnan(v) group by attr",
)
add(
    "attr_quantiles",
    ev(lambda e: S.exact_quantiles(e, "event_type", "value")),
    f"with {EV}, r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from ev where value is not null) "
    + "select event_type, "
    + ", ".join(f"min(case when r = floor((n - 1) * {p}) then value end) p{round(p * 100)}" for p in (0.5, 0.9, 0.99))
    + " from r group by event_type",
)
add(
    "cat_hist",
    ev(lambda e: S.categorical_histogram(e, "label", ["normal", "error", "unseen"])),
    f"with {EV}, names as (select * from (values ('normal'), ('error'), ('unseen')) v(value)) select value, coalesce(n, 0) n from names left join (select label as value, count(*) n from ev group by 1) using (value)",
)
add("top_hubs", ev(lambda e: S.top_nodes(e, "src")), f"with {EV} select src node, count(*) n from ev group by 1 order by n desc, node limit 20")
add(
    "global_gap",
    ev(S.stream_gap_moments),
    f"with {EV}, g as (select t - lag(t) over (order by t, id) gap from ev) select count(gap) n, round(avg(gap), 4) mean, round(stddev_samp(gap), 4) std, min(gap) min, max(gap) max from g",
)
add("burstiness", ev(S.burstiness), f"with {EV}, {GAPS} select count(gap) n, round((stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap)), 6) burstiness from g")
add("memory", ev(S.memory), f"with {EV}, {GAPS} select count(*) n, round(corr(gap_before::double, gap::double), 6) memory from g where gap is not null and gap_before is not null")
add("gap_cdf_log2", ev(S.gap_histogram), f"with {EV}, {GAPS} select (case when gap < 1 then 0 else least(floor(log2(gap)), 31) end)::int bin, count(*) n from g where gap is not null group by 1")
add(
    "graph_scalars",
    sp(S.graph_scalars),
    f"""with {SP}, p as (select src, dst, count(*) n from sp group by 1, 2), v as (select count(distinct node) n from (select src node from sp union all select dst from sp))
select (select count(*) from sp) n_edges, v.n n_nodes, (select count(*) from p) n_pairs, round((select count(*) from sp) / (v.n * (v.n - 1)), 8) density,
round((select count(*) from p a where exists (select 1 from p b where b.src = a.dst and b.dst = a.src)) / (select count(*) from p), 6) reciprocity, round(2 * (select count(*) from sp) / v.n, 6) mean_degree from v""",
)
add(
    "activity_timeline",
    ev(S.activity_timeline),
    f"with {EV}, s as (select min(t) t0, max(t) t1 from ev) select least(floor((t - t0) * 200 / greatest(t1 - t0, 1)), 199)::int bucket, count(*) n from ev, s group by 1",
)
add(
    "powerlaw_fit",
    ev(S.power_law_fit),
    f"""with {EV}, {DEG}, h as (select degree, count(*) c from deg group by 1), r as (select *, row_number() over (order by degree) - 1 r, count(*) over () u, sum(c) over () nodes from h),
c as (select degree xmin, row_number() over (partition by floor(r * 60 / (u - 5)) order by r) k from r where r < u - 5 and nodes >= 50),
f as (select xmin, sum(c) n, sum(c * ln(degree / xmin)) s from c join h on degree >= xmin where k = 1 group by xmin having sum(c) >= 10 and sum(c * ln(degree / xmin)) > 0),
a as (select xmin, n, 1 + n / s alpha from f),
d as (select a.xmin, a.n, alpha, degree, sum(c) over (partition by a.xmin order by degree) / a.n cdf from a join h on degree >= a.xmin),
k as (select xmin, n, alpha, max(abs(cdf - (1 - pow(degree / xmin, 1 - alpha)))) ks from d group by 1, 2, 3)
select xmin, n::bigint n_tail, round(alpha, 5) alpha, round(ks, 5) ks from k order by round(k.ks, 9), xmin limit 1""",
)
add(
    "clustering",
    sp(S.clustering),
    f"""with {SP}, e as (select distinct least(src, dst) a, greatest(src, dst) b from sp where src <> dst), j as (select a v, b w from e union all select b, a from e),
k as (select v, count(*) k from j group by v having count(*) >= 2 order by md5(v::varchar), v limit 2000),
t as (select x.v, count(*) tri from j x join j y on x.v = y.v and x.w < y.w join e on e.a = x.w and e.b = y.w where x.v in (select v from k) group by x.v)
select count(*) n, round(avg(2 * coalesce(tri, 0) / (k * (k - 1))), 6) clustering from k left join t using (v)""",
)
add("repeat_flag", ev(S.repeat_flags), f"with {EV} select id, (row_number() over (partition by src, dst order by t, id) > 1)::int repeat from ev")
add("prev_gap", ev(lambda e: S.previous_gap(e).fillna(-1)), f"with {EV} select src, id, coalesce(t - lag(t) over (partition by src order by t, id), -1) gap from ev")
add(
    "stats_battery",
    ev(S.battery),
    f"""with {EV}, a as (select *, t - lag(t) over (partition by event_type, src order by t, id) gap from ev),
b as (select *, lag(gap) over (partition by event_type, src order by t, id) bef from a)
select event_type, count(*) n, count(distinct src) n_src, count(distinct dst) n_dst, count(distinct (src, dst)) n_pairs, round(1 - count(distinct (src, dst)) / count(*), 6) repeat_ratio,
round((stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap)), 6) burstiness, round(corr(bef::double, gap::double), 6) memory from b group by event_type""",
)
add("distinct_estimates", ev(S.distinct_estimates))
add("approx_quantiles", ev(lambda e: S.approx_quantiles(e, "event_type", "value")))
