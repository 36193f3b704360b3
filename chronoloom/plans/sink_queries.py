"""Queries of the renderers, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.operators import stats as S
from chronoloom.operators.ranges import running
from chronoloom.plans.stats_queries import ev
from chronoloom.sources import sinks as K
from chronoloom.session import shared_dir
from chronoloom.sources.tables import EV, events_edges, load

QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


def with_id(e):
    return e.withColumn("anomaly_id", F.when(F.col("label") == "error", F.col("src") % 7).otherwise(-1))


add("render_csv", ev(lambda e: with_id(e).select("id", K.csv_line(with_id(e), ["value"]).alias("line"))),
    f"with {EV} select id, concat_ws(',', src, dst, t, event_type, label, case when label = 'error' then src % 7 else -1 end, case when value is null then '' when value = floor(value) then floor(value)::bigint::varchar else regexp_replace(printf('%.4f', value), '\\.?0+$', '') end) line from ev")
add("render_graphml", ev(lambda e: K.graphml_lines(e.select(F.col("src").alias("id")).distinct(), e.select("id", "src", "dst", "event_type", "label"), ["event_type", "label"])),
    f"""with {EV} select 0 section, r::bigint as row, line from (values (0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (2, '<key id="event_type" for="edge" attr.name="event_type" attr.type="string"/>'), (3, '<key id="label" for="edge" attr.name="label" attr.type="string"/>'), (4, '<graph id="G" edgedefault="directed">')) v(r, line)
union all select distinct 1, src, '<node id="n' || src || '"/>' from ev
union all select 2, id, '<edge source="n' || src || '" target="n' || dst || '"><data key="event_type">' || event_type || '</data><data key="label">' || label || '</data></edge>' from ev union all select 3, 0, '</graph></graphml>'""")  # fmt: skip


def instances(spark, d):
    e = with_id(events_edges(spark, d)).where("anomaly_id >= 0")
    return e.groupBy(F.col("anomaly_id").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("members"), F.min("t").alias("start_t"), F.max("t").alias("end_t")).withColumns({"intent": F.lit("error"), "kind": F.lit("failure")})


add("node_labels", lambda spark, d: K.node_labels(instances(spark, d)), f"with {EV} select distinct src node_id, 'error' intent, 'failure' kind, src % 7 anomaly_id from ev where label = 'error'")
add("prometheus", ev(K.prometheus), f"""with {EV} select 'graph_edges_total ' || count(*) line from ev union all select 'graph_events_total{{event_type="' || event_type || '"}} ' || count(*) from ev group by event_type union all select 'graph_labels_total{{label="' || label || '"}} ' || count(*) from ev group by label""")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/chronoloom-sink-{uuid.uuid4().hex}"


def written(spark, d, kind: str):
    path = _folder(spark)
    e = with_id(events_edges(spark, d)).select("src", "dst", "t", "event_type", "label", "anomaly_id", "value")
    K.write(e, f"{path}/edges", kind, ["value"])
    return path


_FIXED = "src, dst, t, event_type, label, case when label = 'error' then src % 7 else -1 end anomaly_id"
add("parquet_round_trip", lambda spark, d: K.read_shards(spark, written(spark, d, "parquet")), f"with {EV} select {_FIXED}, value from ev")
add("csv_round_trip", lambda spark, d: K.read_csv(spark, f"{written(spark, d, 'csv')}/edges", ["value"]), f"with {EV} select {_FIXED}, round(value, 4) as value from ev")
add("load_edges", lambda spark, d: K.load_edges(spark, f"{written(spark, d, 'parquet')}/edges", "purchase"), f"with {EV} select src, dst, t::double t from ev where event_type = 'purchase'")
add("stream_order", lambda spark, d: running(K.read_stream_order(spark, f"{written(spark, d, 'parquet')}/edges").select("id", "t"), ["id"], k=F.lit(1)).select(F.col("k").cast("int").alias("k"), "t"), f"with {EV} select (row_number() over (order by t))::int k, t from ev")


def tee_counts(spark, d):
    """Two sinks of one computation, and its rows counted as they pass."""
    path = _folder(spark)
    rows, seen = K.counted(events_edges(spark, d).select("src", "dst", "t", "event_type", "label", "id"))
    K.tee(rows, lambda x: x.write.parquet(f"{path}/a"), lambda x: x.where("label = 'error'").write.parquet(f"{path}/b"))
    n = lambda p: spark.read.parquet(p).count()
    return spark.createDataFrame([(n(f"{path}/a"), n(f"{path}/b"), int(seen.get["n"] > 0))], "n_all bigint, n_errors bigint, counted int")


add("tee_counts", tee_counts, f"with {EV} select count(*) n_all, count(*) filter (label = 'error') n_errors, 1::int counted from ev")
add("nodes_csv", lambda spark, d: (lambda n: n.select(K.nodes_csv(n, ["balance"]).alias("line")))(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))),
    "select concat_ws(',', c_custkey, c_mktsegment, case when c_acctbal = floor(c_acctbal) then floor(c_acctbal)::bigint::varchar else regexp_replace(printf('%.4f', c_acctbal), '\\.?0+$', '') end) line from customer")


def edge_list(spark, d, header: bool):
    path = _folder(spark)
    e = events_edges(spark, d).orderBy("id").select(F.concat_ws(",", F.concat(F.lit("u"), "src"), "event_type", F.concat(F.lit("p"), "dst")).alias("from,kind,to"))
    e.coalesce(1).write.option("header", header).option("quote", "").option("sep", "\x01").csv(path)
    return K.read_edge_list(spark, path, "from", "to", "index")


add("edge_list_by_name", lambda spark, d: edge_list(spark, d, True),
    f"with {EV}, x as (select 'u' || src s, 'p' || dst d, row_number() over (order by id) - 1 k from ev), n as (select name, row_number() over (order by name) - 1 i from (select s name from x union select d from x)) select a.i src, b.i dst, k::double t from x join n a on a.name = s join n b on b.name = d")
add("daily_sparkline", ev(lambda e: S.daily_counts(e).groupBy().agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("x")).select(X.sparkline(F.transform("x", lambda v: v["n"])).alias("line"))),
    f"with {EV}, c as (select t // 86400 as day, count(*) n from ev group by 1) select string_agg(substr('{X.BARS}', least(n * 8 // (select greatest(max(n), 1) from c), 7)::int + 1, 1), '' order by day) line from c")
add("durations", lambda spark, d: load(spark, d, "orders").select("o_orderkey", X.human_duration(F.col("o_totalprice")).alias("took")),
    """with s as (select o_orderkey, o_totalprice p, floor(o_totalprice)::bigint s from orders) select o_orderkey, case when p < 1 then printf('%.1f', p) || 's' when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' when s < 86400 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' else (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' end took from s""")  # fmt: skip
