"""Queries of the graph generators, each with an oracle that repeats the draws."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronoloom.functions.hashrand import BASELINE, TOPOLOGY, pick_sql, poisson_sql, real, u_sql, zipf_cdf
from chronoloom.plans import topology as T
from chronoloom.sources.tables import SP, supplier_edges

QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


N = 1500


def _deg(n: int, mean: float, salt: int) -> str:
    k = f"greatest({poisson_sql(u_sql(TOPOLOGY, str(salt), 'src', chr(39) + 'd' + chr(39)), mean)}, 1)"
    return f"n as (select unnest(range({n})) src), e as (select src, unnest(range({k})) pos from n)"


def _q(x: str) -> str:
    return f"'{x}'"


add("gen_uniform", lambda spark, d: T.uniform_random(spark, N, 400, 3.0), f"with {_deg(N, 3.0, 1)} select src, pos::int pos, floor({u_sql(TOPOLOGY, '1', 'src', 'pos')} * 400)::bigint dst from e")
add(
    "gen_smallworld",
    lambda spark, d: T.small_world(spark, N, 4, 0.1),
    f"""with n as (select unnest(range({N})) src), j as (select src, unnest([1, 2]) j from n),
e as (select src, case when {u_sql(TOPOLOGY, '2', 'src', 'j', _q('r'))} < 1e-1 then floor({u_sql(TOPOLOGY, '2', 'src', 'j', _q('t'))} * {N})::bigint else (src + j) % {N} end dst from j)
select src, dst from e where src <> dst union all select dst, src from e where src <> dst""",
)
_size = N // 4
add(
    "gen_sbm",
    lambda spark, d: T.stochastic_blocks(spark, N, 4, 3.0, 0.8, 0.2),
    f"""with {_deg(N, 3.0, 3)}, o as (select src, pos, least(src // {_size}, 3) own from e),
a as (select src, pos, case when {u_sql(TOPOLOGY, '3', 'src', 'pos', _q('b'))} < {real(0.8 / (0.8 + 0.2))} then own else (own + 1 + floor({u_sql(TOPOLOGY, '3', 'src', 'pos', _q('o'))} * 3)::bigint) % 4 end as blk from o)
select src, pos::int pos, (blk * {_size} + floor({u_sql(TOPOLOGY, '3', 'src', 'pos', _q('t'))} * case when blk = 3 then {N - 3 * _size} else {_size} end))::bigint dst from a""",
)


def _matrix_sql(n: int, edges: int, a: float, b: float, c: float, purpose: int) -> str:
    bits = max(1, math.ceil(math.log2(n)))
    xs = ", ".join(f"{u_sql(purpose, '4', 'id', str(k))} x{k}" for k in range(bits))
    src = " + ".join(f"case when x{k} < {real(a + b)} then 0 else {1 << (bits - 1 - k)} end" for k in range(bits))
    dst = " + ".join(f"case when x{k} < {real(a)} or (x{k} >= {real(a + b)} and x{k} < {real(a + b + c)}) then 0 else {1 << (bits - 1 - k)} end" for k in range(bits))
    return f"with i as (select unnest(range({edges})) id), x as (select id, {xs} from i) select id, (({src}) % {n})::bigint src, (({dst}) % {n})::bigint dst from x"


add("gen_rmat", lambda spark, d: T.recursive_matrix(spark, N, 6000, 0.57, 0.19, 0.19), _matrix_sql(N, 6000, 0.57, 0.19, 0.19, TOPOLOGY))
add("gen_kronecker", lambda spark, d: T.recursive_matrix(spark, 1024, 5000, 0.5, 0.2, 0.2, BASELINE), _matrix_sql(1024, 5000, 0.5, 0.2, 0.2, BASELINE))
add(
    "gen_affiliation",
    lambda spark, d: T.affiliation(spark, N, 150, 2.5, 1.2),
    f"with {_deg(N, 2.5, 5)} select src, pos::int pos, {pick_sql(u_sql(TOPOLOGY, '5', 'src', 'pos'), zipf_cdf(1.2, 150))}::bigint dst from e",
)
add(
    "gen_spatial",
    lambda spark, d: T.spatial(spark, 800, 0.05),
    f"with p as (select src, {u_sql(TOPOLOGY, '6', 'src', _q('x'))} x, {u_sql(TOPOLOGY, '6', 'src', _q('y'))} y from (select unnest(range(800)) src)) "
    f"select a.src, b.src dst from p a join p b on a.src <> b.src and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {real(0.05 * 0.05)}",
)
_draw = lambda i: f"floor({u_sql(TOPOLOGY, '7', i)} * {i} * 2)::bigint"
add(
    "gen_pa",
    lambda spark, d: T.preferential_attachment(spark, N, 3),
    f"""with recursive h as (select i, case when i = 0 then 0 else {_draw('i')} end r from (select unnest(range({N * 3})) i)),
c as (select i, r from h union all select c.i, h.r from c join h on h.i = c.r // 2 where c.r % 2 = 1),
e as (select i // 3 src, (r // 2) // 3 dst from c where r % 2 = 0) select src, dst from e where src <> dst union all select dst, src from e where src <> dst""",
)
add("gen_er", lambda spark, d: T.erdos_renyi(spark, N, 5000), f"select id, floor({u_sql(BASELINE, '1', 'id', _q('s'))} * {N})::bigint src, floor({u_sql(BASELINE, '1', 'id', _q('d'))} * {N})::bigint dst from (select unnest(range(5000)) id)")
add(
    "gen_config_model",
    lambda spark, d: T.configuration(supplier_edges(spark, d)),
    f"""with {SP}, a as (select src, row_number() over (order by md5('42|{BASELINE}|o|' || id)) r from sp), b as (select dst, row_number() over (order by md5('42|{BASELINE}|i|' || id)) r from sp) select src, dst from a join b using (r)""",
)


def _picks_sql(col: str, salt: int) -> str:
    return f"""w{salt} as (select {col} node, count(*) w from sp group by 1), k{salt} as (select node, sum(w) over (order by node) - w lo, sum(w) over (order by node) hi from w{salt}),
d{salt} as (select id, floor({u_sql(BASELINE, str(salt), 'id')} * (select count(*) from sp)) x from (select unnest(range((select count(*) from sp))) id)), p{salt} as (select id, node from d{salt} join k{salt} on x >= lo and x < hi)"""


add("gen_chung_lu", lambda spark, d: T.chung_lu(spark, supplier_edges(spark, d)).select("id", "src", "dst"), f"with {SP}, {_picks_sql('src', 11)}, {_picks_sql('dst', 12)} select id, p11.node src, p12.node dst from p11 join p12 using (id)")
add("gen_forest_fire", lambda spark, d: T.forest_fire(spark, 800, 0.35, 0.2, 4.0))
add("gen_skeleton_csr", lambda spark, d: T.uniform_random(spark, 300, 100, 3.0).groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]), ",").alias("targets")),
    f"with {_deg(300, 3.0, 1)} select src, string_agg(floor({u_sql(TOPOLOGY, '1', 'src', 'pos')} * 100)::bigint::varchar, ',' order by pos) targets from e group by src")
