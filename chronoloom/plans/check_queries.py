"""Queries of the validation and comparison families, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import checks as C
from chronoloom.operators import compare as P
from chronoloom.plans.stats_queries import TYPES, ev, sp
from chronoloom.sources.tables import EV, SP, events_edges, supplier_edges

WEEK = 604_800
QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


RULES = [("value_1_100", "view", "value", 1.0, 100.0), ("purchase_5_50", "purchase", "value", 5.0, 50.0), ("click_any", "click", "value", None, None)]
EFFECTS = {"purchase": ("src", -1.0), "signup": ("src", 1.0), "click": ("dst", 0)}
_STATE = "ch as (select src node, t, id, -value delta from ev where event_type = 'purchase' and value is not null union all select src, t, id, value from ev where event_type = 'signup' and value is not null union all select dst, t, id, 1.0 from ev where event_type = 'click' and value is not null)"
_types = ", ".join(f"'{x}'" for x in TYPES[:5])

add(
    "hard_checks",
    ev(lambda e: C.hard_checks(e, 1000, TYPES[:5], ["normal", "error"])),
    f"""with {EV}, o as (select count(*) c from (select t < lag(t) over (order by id) late from ev) where late),
x as (select count(*) n, count(*) filter (src >= 1000 or dst >= 1000 or src < 0 or dst < 0) r, count(*) filter (not event_type in ({_types})) y, count(*) filter (not label in ('normal', 'error')) l from ev)
select n, c out_of_order, r id_out_of_range, y bad_type, l bad_label, case when c + r + y + l = 0 then 'ok' else 'BROKEN' end verdict from x, o""",
)
add(
    "attr_range_violations",
    ev(lambda e: C.attribute_range(e, RULES)),
    f"with {EV} select 'value_1_100' as rule, count(*) filter (event_type = 'view' and (value < 1 or value > 100)) violations from ev union all "
    "select 'purchase_5_50', count(*) filter (event_type = 'purchase' and (value < 5 or value > 50)) from ev union all select 'click_any', 0 from ev where id = (select min(id) from ev)",
)
def _limit_sql(source: str, k: int, w: int) -> str:
    """A recursive fold over each source's sorted times, as DuckDB's list_reduce can't change its element's type."""
    return f"""with recursive {EV}, s as (select src, list(t order by t) ts from ev where {source} group by src),
f as (select src, ts, 1 i, []::bigint[] q, 0::bigint v from s union all
 select src, ts, i + 1, case when len(list_filter(q, lambda x: x >= ts[i] - {w})) + 1 >= {k} then []::bigint[] else list_append(list_filter(q, lambda x: x >= ts[i] - {w}), ts[i]) end,
  v + case when len(list_filter(q, lambda x: x >= ts[i] - {w})) + 1 >= {k} then 1 else 0 end from f where i <= len(ts))
select src, max(v) violations from f group by src"""


add("rate_limit_violations", ev(lambda e: C.limit_violations(e.where("event_type = 'purchase'"), 4, WEEK)), _limit_sql("event_type = 'purchase'", 4, WEEK))
add("rate_limit_violations_streamed", ev(lambda e: C.limit_violations_by_groups(e.where("event_type = 'purchase'"), 4, WEEK)), _limit_sql("event_type = 'purchase'", 4, WEEK))
add("subthreshold_violations", ev(lambda e: C.limit_violations(C.near_threshold(e, "purchase", "value", 10, 50), 3, WEEK)), _limit_sql("event_type = 'purchase' and value >= 10 and value < 50", 3, WEEK))
add(
    "rate_window_counts",
    ev(lambda e: C.window_counts(e.where("event_type = 'purchase'"), WEEK).select("id", "in_window")),
    f"with {EV} select id, count(*) over (partition by src order by t range between {WEEK} preceding and current row) in_window from ev where event_type = 'purchase'",
)
add("state_effects", ev(lambda e: C.final_state(C.state_changes(e, EFFECTS))), f"with {EV}, {_STATE} select node, sum(delta::decimal(18,4))::double state, count(*) n from ch group by node")
add(
    "state_set_effects",
    ev(lambda e: C.final_state_with_set(C.state_changes(e, EFFECTS), e.where("event_type = 'error' and value is not null").select(F.col("src").alias("node"), "t", "id", "value")).select("node", F.round("state", 4).alias("state"))),
    f"""with {EV}, {_STATE}, st as (select src node, arg_max(value, (t, id)) v, max((t, id)) last from ev where event_type = 'error' and value is not null group by src),
d as (select node, sum(delta::decimal(18,4))::double d from ch left join st using (node) where st.last is null or (ch.t, ch.id) > st.last group by node)
select coalesce(st.node, d.node) node, round(coalesce(v, 0) + coalesce(d, 0), 4) state from st full join d on st.node = d.node""",
)
add(
    "state_non_negative",
    ev(lambda e: C.negative_states(C.state_changes(e, EFFECTS), 20.0)),
    f"with {EV}, {_STATE} select node, count(*) filter (s < 0) negative from (select node, 20 + sum(delta::decimal(18,4)) over (partition by node order by t, id) s from ch) group by node",
)


def halves(spark, d):
    e = events_edges(spark, d)
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


def _q(cte: str) -> str:
    return f"""{cte}d as (select node, count(*)::double v from (select src node from e union all select dst from e) group by 1),
g0 as (select src, t, id, t - lag(t) over (partition by src order by t, id) gap from e),
q as (select 'degree' g, v from d union all select 'gap', gap::double from g0 where gap is not null union all select 'pair', count(*)::double from e group by src, dst union all select 'day', count(*)::double from e group by floor(t / 86400))"""


def _two(select: str) -> str:
    one = lambda s, k: f"e{s} as (select * from ev where id % 2 = {k}), " + _q("").replace("from e ", f"from e{s} ").replace("from e)", f"from e{s})").replace("d as (", f"d{s} as (").replace("from d ", f"from d{s} ").replace("g0 as (", f"g0{s} as (").replace("from g0 ", f"from g0{s} ").replace("q as (", f"q{s} as (")
    return f"""with {EV}, {one(1, 0)}, {one(2, 1)},
c as (select g, v, sum(x) c1, sum(y) c2 from (select g, v, 1 x, 0 y from q1 union all select g, v, 0, 1 from q2) group by g, v),
cdf as (select g, v, c1, c2, sum(c1) over (partition by g order by v) u1, sum(c2) over (partition by g order by v) u2, sum(c1) over (partition by g) n1, sum(c2) over (partition by g) n2, lead(v) over (partition by g order by v) nx from c),
f as (select *, u1 / n1 f1, u2 / n2 f2, coalesce(nx - v, 0) w from cdf), {select}"""


add(
    "ks_wasserstein_energy",
    lambda spark, d: P.two_sample_distances(*(P.quantities(e) for e in halves(spark, d))),
    _two("z as (select 1) select g, max(n1)::bigint n1, max(n2)::bigint n2, round(max(abs(f1 - f2)), 6) ks, round(sum(abs(f1 - f2) * w), 5) wasserstein, round(sqrt(2 * sum((f1 - f2) * (f1 - f2) * w)), 5) energy from f group by g"),
)
add(
    "anderson_darling",
    lambda spark, d: P.anderson_darling(*(P.quantities(e) for e in halves(spark, d))),
    _two(
        """x as (select g, c1 + c2 l, n1 + n2 n, n1, n2, (u1 + u2) - (c1 + c2) / 2 ba, u1 - c1 / 2 m1, u2 - c2 / 2 m2 from cdf),
y as (select *, ba * (n - ba) - n * l / 4 den from x)
select g, max(n1)::bigint n1, max(n2)::bigint n2, round(sum(l / n * pow(n * m1 - ba * n1, 2) / den / n1 + l / n * pow(n * m2 - ba * n2, 2) / den / n2) * (max(n) - 1) / max(n), 5) ad from y where den > 0 group by g having least(max(n1), max(n2)) >= 8"""
    ),
)
_MOTIF = "m as (select least(src, dst) a, greatest(src, dst) b, (src > dst)::int d, t, id from {t} where src <> dst), n as (select d * 4 + lead(d, 1) over w * 2 + lead(d, 2) over w motif, lead(t, 2) over w - t span from m window w as (partition by a, b order by t, id))"
add("temporal_motifs", sp(lambda e: P.motif_counts(e, 30 * 86_400)), f"with {SP}, {_MOTIF.format(t='sp')} select motif::int motif, count(*) n from n where span <= {30 * 86_400} group by 1")


def _motif_share(s: int) -> str:
    return f"e{s} as (select * from sp where id % 2 = {s - 1}), " + _MOTIF.format(t=f"e{s}").replace("m as (", f"m{s} as (").replace("from m ", f"from m{s} ").replace("n as (", f"n{s} as (", 1).replace(", n as (", f", n{s} as (") + f", h{s} as (select motif, count(*) / sum(count(*)) over () p from n{s} where span <= {60 * 86_400} group by 1)"


add(
    "motif_l1",
    lambda spark, d: P.motif_distance(supplier_edges(spark, d).where("id % 2 = 0"), supplier_edges(spark, d).where("id % 2 = 1"), 60 * 86_400),
    f"with {SP}, {_motif_share(1)}, {_motif_share(2)} select round(sum(abs(coalesce(h1.p, 0) - coalesce(h2.p, 0))), 6) l1 from h1 full join h2 using (motif)",
)


def _scalars_sql(k: int) -> str:
    return f"""p{k} as (select src, dst, count(*) n from e{k} group by 1, 2), v{k} as (select count(distinct node) n from (select src node from e{k} union all select dst from e{k})),
b{k} as (select gap, lag(gap) over (partition by src order by t, id) gap_before from g0{k}),
s{k} as (select round(m / (v * (v - 1)), 8) density, round(r / np, 6) reciprocity, round(2 * m / v, 6) mean_degree, round((sd - av) / (sd + av), 6) burstiness, mem memory, round(greatest(0, 1 - np / m), 6) repeat_ratio
from (select (select count(*) from e{k}) m, (select n from v{k}) v, (select count(*) from p{k}) np, (select count(*) from p{k} a where exists (select 1 from p{k} b where b.src = a.dst and b.dst = a.src)) r,
(select stddev_samp(gap) from b{k}) sd, (select avg(gap) from b{k}) av, (select round(corr(gap_before::double, gap::double), 6) from b{k} where gap is not null and gap_before is not null) mem))"""


_relative = lambda c: f"case when abs(s1.{c}) + abs(s2.{c}) > 0 then abs(s1.{c} - s2.{c}) / (abs(s1.{c}) + abs(s2.{c})) else 0 end"
_bounded = lambda c, scale: f"least(1.0, abs(s1.{c} - s2.{c}) / {scale})"
_DISTANCES = [("density", _relative("density")), ("reciprocity", _bounded("reciprocity", 1.0)), ("mean_degree", _relative("mean_degree")), ("burstiness", _bounded("burstiness", 2.0)), ("memory", _bounded("memory", 2.0)), ("repeat_ratio", _bounded("repeat_ratio", 1.0))]
add(
    "fidelity_score",
    lambda spark, d: P.scorecard(*halves(spark, d)),
    _two(
        f"""{_scalars_sql(1)}, {_scalars_sql(2)}, r as (select g metric, round(case when least(max(n1), max(n2)) >= 5 then round(max(abs(f1 - f2)), 6) end, 4) distance from f group by g
union all {" union all ".join(f"select '{name}', round({d}, 4) from s1, s2" for name, d in _DISTANCES)})
select metric, distance from r union all select 'score', round(1 - avg(distance), 4) from r"""
    ),
)
