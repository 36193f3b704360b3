"""Queries of the small operators and of the generators' comparison, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.hashrand import STATIC, u_sql
from chronoloom.operators import grounding as G
from chronoloom.operators import stats as S
from chronoloom.plans import topology as T
from chronoloom.plans.stats_queries import ev
from chronoloom.sources.tables import EV, load, supplier_edges

QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


add("finite_filter", ev(lambda e: G.finite(e.withColumn("x", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))), "x").select("id")), f"with {EV} select id from ev where id % 7 <> 0 and id % 11 <> 0 and value is not null")
add("edge_subsample", ev(lambda e: G.subsample(e, "id", 500).select("id", "src", "dst")), f"with {EV} select id, src, dst from ev order by {u_sql(STATIC, '9', 'id')}, id limit 500")
_names = ["zero", "one", "two", "three"]
add("decode_codes", ev(lambda e: e.select("id", G.decode(F.col("src") % 6, _names).alias("name"))), f"with {EV} select id, {_names}[least(src % 6, 3) + 1] as name from ev")
add("type_mix", ev(lambda e: G.shares(e.groupBy("event_type").agg(F.count("*").alias("n")), "n")), f"with {EV} select event_type, count(*) n, round(count(*) / sum(count(*)) over (), 6) as share from ev group by 1")
add("weighted_median", lambda spark, d: G.weighted_median(load(spark, d, "part"), "p_retailprice", "p_size"), "with c as (select p_retailprice v, sum(p_size) w from part group by 1), x as (select v, sum(w) over (order by v) run, sum(w) over () total from c) select min(v) median from x where run * 2 >= total")
add("dictionary_union", lambda spark, d: G.dictionary_union(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey"), "with f as (select o_orderpriority as value, min((o_orderstatus, o_orderkey)) a from orders group by 1) select value, (row_number() over (order by a) - 1)::int code from f")
_NUM = r"'[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+'"
add(
    "number_candidates",
    lambda spark, d: G.candidates(load(spark, d, "documents").select("doc_id", "text"), "the|and"),
    f"""with p as (select doc_id, regexp_split_to_array(text, {_NUM}) b, regexp_extract_all(text, {_NUM}) f from documents), x as (select doc_id, b, unnest(range(len(f))) k, unnest(f) number from p)
select doc_id, k::int k, number, (len(regexp_extract_all(lower(right(b[k + 1], 40)), 'the|and')) + len(regexp_extract_all(lower(left(b[k + 2], 40)), 'the|and')))::int hits from x""",
)
add("best_candidate", lambda spark, d: G.best_candidate(G.candidates(load(spark, d, "documents").select("doc_id", "text"), "the|and")).select("doc_id", "number"),
    f"""with p as (select doc_id, regexp_split_to_array(text, {_NUM}) b, regexp_extract_all(text, {_NUM}) f from documents), x as (select doc_id, b, unnest(range(len(f))) k, unnest(f) number from p),
y as (select doc_id, k, number, len(regexp_extract_all(lower(right(b[k + 1], 40)), 'the|and')) + len(regexp_extract_all(lower(left(b[k + 2], 40)), 'the|and')) hits from x), z as (select doc_id, number, row_number() over (partition by doc_id order by hits desc, k) r from y) select doc_id, number from z where r = 1""")  # fmt: skip
add("gold_accuracy", lambda spark, d: G.against_gold(load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value")), load(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name"), (F.col("n_regionkey") + F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(0)).alias("value"))),
    "select count(*) n, count(*) filter (n_nationkey % 4 <> 0) found, count(*) filter (n_nationkey % 4 <> 0 and n_nationkey % 5 <> 0) as right, round(avg((n_nationkey % 4 <> 0 and n_nationkey % 5 <> 0)::int), 6) accuracy from nation")
add("first_sources", lambda spark, d: G.first_sources(load(spark, d, "documents").select("doc_id", "source"), "source", "doc_id"), "select min(doc_id) doc_id, source from documents group by source order by 1 limit 6")
add("clock_parts", ev(lambda e: e.select("id", *[c.alias(n) for n, c in G.clock(F.col("t")).items()])), f"with {EV} select id, t // 86400 as day, ((t // 86400 + 3) % 7)::int weekday, (t % 86400 // 3600)::int as hour, (t % 86400)::int as second from ev")


def comparison(spark, d):
    """The scalar battery of a graph and of models fitted to it."""
    real = supplier_edges(spark, d).select("src", "dst")
    n, m = real.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1, real.count()
    graphs = {"real": real, "erdos_renyi": T.erdos_renyi(spark, n, m), "r_mat": T.recursive_matrix(spark, n, m, 0.45, 0.22, 0.22), "configuration": T.configuration(supplier_edges(spark, d)), "small_world": T.small_world(spark, n, max(2, 2 * (m // n // 2)), 0.1)}
    out = None
    for name, e in graphs.items():
        row = S.graph_scalars(e.select("src", "dst")).withColumn("graph", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


add("generator_comparison", comparison)
