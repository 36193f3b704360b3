"""The workbench: oracles, properties of the generators, rule bases, sinks and streams."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import hashrand as H
from chronoloom.operators import checks, compare, link, relational, retrieval, stats
from chronoloom.plans import registry, simulate, topology
from chronoloom.rules import model
from chronoloom.sources import sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENTRIES = registry.entries()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


def rows(names, it):
    return sorted((tuple(plain(v) for v in r) for r in it), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ENTRIES.items() if sql))
def test_query_equals_its_oracle(spark, con, sf, name):
    run, sql = ENTRIES[name]
    got = run(spark, sf)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows(cols, got.select(*cols).collect()) == rows(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ENTRIES.items() if not sql))
def test_query_without_oracle_runs(spark, sf, name):
    assert ENTRIES[name][0](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and entry.queries().keys() >= entry.oracle_sql().keys()


# statistics on small fixtures -------------------------------------------------------------------------------------


def edges(spark, rows_):
    return spark.createDataFrame([(s, d, t, "e", "normal", float(t), i) for i, (s, d, t) in enumerate(rows_)], "src bigint, dst bigint, t bigint, event_type string, label string, value double, id bigint")


def test_burstiness_signs(spark):
    regular = edges(spark, [(1, 2, 100 * k) for k in range(1000)])
    assert stats.burstiness(regular).first().burstiness < -0.9
    t, burst = 0, []
    for k in range(1000):
        t += 100_000 if k % 10 == 0 else 1
        burst.append((1, 2, t))
    assert stats.burstiness(edges(spark, burst)).first().burstiness > 0.4
    assert stats.burstiness(edges(spark, [(1, 2, 5)])).first().burstiness is None


def test_motif_of_a_reply(spark):
    e = edges(spark, [(1, 2, 0), (2, 1, 5), (1, 2, 9), (1, 2, 10_000)])
    assert [(r.motif, r.n) for r in compare.motif_counts(e, 60).collect()] == [(2, 1)]


def test_limits_reset(spark):
    e = edges(spark, [(1, 2, t) for t in (0, 1, 2, 3, 4, 5, 6, 7, 100)] + [(2, 1, 0)])
    for f in (checks.limit_violations, checks.limit_violations_by_groups):
        assert {r.src: r.violations for r in f(e, 4, 10).collect()} == {1: 2, 2: 0}


def test_set_effects_win_over_earlier_changes(spark):
    ch = spark.createDataFrame([(1, 10, 1, 5.0), (1, 30, 3, 2.0), (2, 1, 4, 7.0)], "node bigint, t bigint, id bigint, delta double")
    st = spark.createDataFrame([(1, 20, 2, 100.0), (3, 1, 9, 4.0)], "node bigint, t bigint, id bigint, value double")
    assert {r.node: r.state for r in checks.final_state_with_set(ch, st).collect()} == {1: 102.0, 2: 7.0, 3: 4.0}


def test_identical_samples_have_no_distance(spark):
    a = spark.createDataFrame([("g", float(v % 7)) for v in range(50)], "g string, v double")
    r = compare.two_sample_distances(a, a).first()
    assert (r.ks, r.wasserstein, r.energy) == (0, 0, 0)


def test_top_and_pack(spark):
    assert retrieval.pack("a b " * 600)[0].startswith("a b") and all(len(c) <= 1000 for c in retrieval.pack("word " * 3000))
    assert retrieval.pack("") == [] and retrieval.pack("x\n\n\n\ny") == ["x\n\ny"]


def test_stream_ranks_are_dense(spark):
    e = edges(spark, [(k % 5, k % 3, (k * 7919) % 500_000) for k in range(500)])
    assert sorted(r["rank"] for r in link.stream_ranks(e).collect()) == list(range(1, 501))


def test_unknown_filter_column_is_an_error(spark):
    with pytest.raises(ValueError):
        relational.actor_filter(spark.range(3), {"id": "1"})


# random numbers ---------------------------------------------------------------------------------------------------


def test_draws_match_duckdb_and_means(spark):
    got = [r[0] for r in spark.range(2000).select(H.u(1, F.col("id"), "x")).collect()]
    want = [r[0] for r in duckdb.sql(f"select {H.u_sql(1, 'id', chr(39) + 'x' + chr(39))} from (select unnest(range(2000)) id)").fetchall()]
    assert got == want and abs(sum(got) / 2000 - 0.5) < 0.02
    x = spark.range(20_000)
    a, b = H.u(1, F.col("id"), "a"), H.u(1, F.col("id"), "b")
    m = x.select(F.avg(H.exponential(a, 2.0)), F.avg(H.lognormal(a, b, 0.0, 0.5)), F.avg(H.poisson(a, 3.5)), F.avg(H.pareto(a, 1.0, 3.0)), F.avg(H.geometric(a, 2.0)), F.avg(simulate.poisson_of(a, F.lit(60.0))), F.avg(simulate.poisson_of(a, F.lit(3.5)))).first()
    for got, want in zip(m, (2.0, H.mean_of("log_normal", 0.0, 0.5), 3.5, 1.5, 2.0, 60.0, 3.5), strict=True):
        assert abs(got / want - 1) < 0.04
    assert H.mean_of("pareto", 1.0, 1.0) == math.inf and abs(H.mean_of("zipf", 1.2, 100) - sum(k**-0.2 for k in range(1, 101)) / sum(k**-1.2 for k in range(1, 101))) < 1e-9
    for bad in ([], [0, 0], [1, float("nan")], [1, -1]):
        with pytest.raises(ValueError):
            H.weights_cdf(bad)


def test_generators_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, topology.preferential_attachment(spark, 300, 3).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
    degree = max(sum(1 for s, _ in out[0] if s == v) for v in range(300))
    assert degree > 20 and len(out[0]) > 1600  # hubs


# simulation -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rules():
    return model.load("finance")


def run(spark, rules, **more):
    config = simulate.Config(**({"nodes": 2000, "edges": 20_000, "days": 14} | more))
    return simulate.generate(spark, rules, config)


def test_budget_span_and_order(spark, rules):
    world, e = run(spark, rules, anomalies=False)
    x = e.agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_if(F.col("label") != "normal").alias("bad"), F.min("amount").alias("a")).first()
    c = world.config
    assert abs(x.n / c.edges - 1) < 0.07 and x.lo >= c.epoch and x.hi < c.epoch + c.days * 86_400 and x.bad == 0 and x.a > 0
    hours = {r[0]: r[1] for r in e.groupBy((F.floor(F.col("t") / 3600) % 24).alias("h")).count().collect()}
    assert sum(hours.get(h, 0) for h in range(9, 18)) > 2 * sum(hours.get(h, 0) for h in range(0, 9) if h < 6)


def test_shards_make_the_whole(spark, rules):
    whole = run(spark, rules, nodes=400, edges=1500)[1]
    parts = [run(spark, rules, nodes=400, edges=1500, shard_index=k, shard_count=2)[1] for k in range(2)]
    r = relational.same_rows(whole.drop("anomaly_id"), parts[0].unionAll(parts[1]).drop("anomaly_id")).first()
    assert r.n_a == r.n_b and r.only_a == r.only_b == 0


def test_prevalence_raises_labels(spark, rules):
    n = [run(spark, rules, prevalence=p)[1].where("label <> 'normal'").count() for p in (0.02, 0.1)]
    assert n[1] > 1.8 * n[0] > 0
    mix = run(spark, rules, prevalence=0.1, type_mix={"layering": 1.0})[1].select("label").distinct().collect()
    assert {r.label for r in mix} == {"normal", "layering"}


def test_transport_is_failure_dominated(spark):
    world, e = run(spark, model.load("transport"), nodes=1500, edges=30_000, days=30, prevalence=0.2)
    shares = world.type_shares()
    assert sum(shares.values()) == pytest.approx(1) and sum(shares[f["intent"]] for f in world.rules["failures"]) > 0.8
    labels = {r.label for r in e.select("label").distinct().collect()}
    assert "sensor_dropout" not in labels and len(labels) > 3


def test_tiers_can_be_overridden_and_counted(spark):
    world, e = run(spark, model.load("ecommerce"), nodes=1500, edges=8000, days=20, prevalence=0.2, difficulty=0.0)
    by = {r.label: r for r in e.where("event_type = 'WROTE_REVIEW'").groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("star") == "5").cast("int")).alias("five")).collect()}
    assert by["normal"].five < 0.8 and by["collusion_ring"].five > 0.95 and by["collusion_ring"].n > 5
    assert e.where("star is not null and star not in ('1', '2', '3', '4', '5')").count() == 0
    assert world.final_state(e).where("var = 'cum_rating' and value > 0").count() > 0


@pytest.mark.parametrize("mean,gap", [(2, 300), (0.5, 300), (3, 20_000), (8, 40_000)])
def test_burst_survivors_against_simulation(mean, gap):
    rng, n = np.random.default_rng(5), 100_000
    at, alive, inside = rng.random(n) * 86_400, np.ones(n, bool), 0
    while alive.any():
        alive &= rng.random(n) < mean / (1 + mean)
        at += rng.exponential(gap, n)
        alive &= at < 86_400
        inside += alive.sum()
    assert simulate.burst_survivors(mean, gap) == pytest.approx(inside / n, rel=0.02)


def test_poisson_counts_of_any_mean(spark):
    """Moments, and the inverse of the distribution function at given draws; tables that begin late, and means that differ by row."""
    from chronoloom.functions.hashrand import poisson, poisson_table

    for mean in (0.3, 39.0, 41.0, 499.0, 501.0, 5000.0):
        lo, cdf = poisson_table(mean)
        mass = np.diff([0.0, *cdf])
        k = lo + np.arange(len(cdf))
        assert cdf[-1] > 1 - 1e-9 and (mass * k).sum() == pytest.approx(mean, rel=1e-6) and (mass * (k - mean) ** 2).sum() == pytest.approx(mean, rel=1e-5)
        rows = spark.createDataFrame([((i + 0.5) / 200, mean) for i in range(200)], "x double, mean double")
        out = rows.select("x", poisson(F.col("x"), mean).alias("a"), simulate.poisson_of(F.col("x"), F.col("mean")).alias("b")).collect()
        want = [lo + int(np.searchsorted(cdf, r.x, "right")) for r in out]
        assert [r.a for r in out] == want and sum(r.b != w for r, w in zip(out, want, strict=True)) <= 2  # Stirling's series may turn a tie


def test_spaced_and_excited_arrivals_keep_the_budget(spark, rules):
    other = model.loads(model.dumps(rules))
    for b, timing in zip(other["behaviors"], ({"arrival": model.Tagged("weibull", {"shape": 0.6})}, {"branching_ratio": 0.5, "excitation_decay_s": 600.0}, {}), strict=True):
        b["timing"].update(timing)
    assert not model.validate(other)
    world, e = run(spark, other, anomalies=False, nodes=800, edges=6000)
    rows = e.select("src", "dst", "t").collect()
    assert abs(len(rows) / 6000 - 1) < 0.12 and sorted(rows) == sorted(run(spark, other, anomalies=False, nodes=800, edges=6000)[1].select("src", "dst", "t").collect())
    other["behaviors"][1]["timing"]["branching_ratio"] = 1.0
    assert model.validate(other)


def test_cascades_are_campaigns_of_their_own(spark, rules):
    other = model.loads(model.dumps(rules))
    for a in other["adversaries"]:
        a["cascade_p"] = 1.0 if a["intent"] == "layering" else 0.0
    world = simulate.World(spark, other, simulate.Config(nodes=3000, edges=20_000, days=14, prevalence=0.2))
    rows = {r.id: r for r in world.campaigns().collect()}
    children = [r for r in rows.values() if r.parent is not None]
    n = sum(r.intent == "layering" and r.parent is None for r in rows.values())
    assert len(children) == -(-n // 2) > 1 and sorted(rows) == list(range(len(rows)))
    for r in children:
        assert r.intent == "layering" and r.start_t == rows[r.parent].end_t and r.community == rows[r.parent].community and r.members != rows[r.parent].members
    assert all(a != b for r in rows.values() for a, b in zip(r.members, r.members[1:], strict=False))
    assert sum(r.cascade for r in world.ground_truth().collect()) == len(children)


def test_super_hubs_are_not_recruited(spark):
    world = simulate.World(spark, model.load("crypto"), simulate.Config(nodes=2000, edges=20_000, days=14, prevalence=0.3))
    hot = {k for k, b in enumerate(world.rules["behaviors"]) if b["name"] in ("exchange_hot_wallet", "mev_bot")}
    assert set(world.heavy["eoa"]) == hot
    hubs = {r.actor for r in world.actors.where(F.col("behavior").isin(list(hot))).select("actor").collect()}
    assert len(hubs) > 100 and not hubs & {r.node for r in world.marked().collect()}


def test_final_state_with_settings(spark, rules):
    other = model.loads(model.dumps(rules))
    withdrawal = next(e for e in other["event_types"] if e["name"] == "cash_withdrawal")
    withdrawal["effects"].append(model.Tagged("set_src", {"var": "txn_count", "value": 100.0}))
    assert not model.validate(other)
    world, e = run(spark, other, nodes=300, edges=3000, anomalies=False)
    state = {(r.id, v): r[v] for t in world.types for r in world.nodes(t).collect() for v in [s["name"] for s in world.types[t].get("state") or []]}
    for r in sorted(e.collect(), key=lambda r: (r.t, r.src, r.dst, r.event_type)):
        for f in world.events[r.event_type].get("effects") or []:
            key = (r.dst if f.tag.endswith("dst") else r.src, f["var"])
            state[key] = f["value"] if f.tag.startswith("set") else state[key] + (1 if f.tag.startswith("inc") else (-1 if f.tag.startswith("sub") else 1) * float(r[f["from_attr"]]))
    got = {(r.node, r["var"]): r.value for r in world.final_state(e).collect()}
    assert got.keys() == state.keys() and all(got[k] == pytest.approx(v, abs=1e-4) for k, v in state.items())
    assert any(v >= 100 for (_, name), v in state.items() if name == "txn_count")


@pytest.mark.parametrize("domain", ["crypto", "cyber", "healthcare"])
def test_every_domain_makes_a_valid_stream(spark, domain):
    world, e = run(spark, model.load(domain), nodes=1500, edges=15_000, days=10, prevalence=0.1)
    types = {x["name"]: x for x in world.rules["event_types"]}
    where = F.lit(False)
    for name, x in types.items():
        (s, n), (d, m) = world.layout[x["src"]], world.layout[x["dst"]]
        where = where | ((F.col("event_type") == name) & F.col("src").between(s, s + n - 1) & F.col("dst").between(d, d + m - 1))
    x = e.agg(F.count("*").alias("n"), F.count_if(where).alias("ok"), F.count_if(F.col("label") != "normal").alias("bad"), F.collect_set("label").alias("labels"), F.collect_set("event_type").alias("types")).first()
    assert x.n == x.ok > 8000 and 0 < x.bad < 0.5 * x.n
    assert set(x.labels) <= {"normal", *(a["intent"] for a in world.rules["adversaries"])} and len(x.labels) > 3
    assert set(x.types) >= {ev["event"] for b in world.rules["behaviors"] for ev in b["events"] if ev["weight"] > 0.2}


def test_counted_stages_do_not_follow_the_budget(spark, rules):
    other = model.loads(model.dumps(rules))
    stage = other["adversaries"][0]["stages"][0]
    del stage["activity_multiplier"]
    stage["event_count"] = model.Tagged("constant", {"value": 6.0})
    assert model.validate(other) == []
    worlds = [simulate.World(spark, other, simulate.Config(nodes=500, edges=n, days=10, difficulty=0.0)) for n in (5000, 20_000)]
    a = other["adversaries"][0]
    counted = [w._stage_rate(a, a["stages"][0]) for w in worlds]
    scaled = [w._stage_rate(a, a["stages"][1]) for w in worlds]
    assert counted[0] == pytest.approx(counted[1]) and scaled[1] == pytest.approx(4 * scaled[0], rel=1e-6)


def test_parsers():
    import io
    import zipfile

    from chronoloom.sources import documents as D

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.html", "<p>One &amp; two<script>x</script><p>three")
        f.writestr("b.csv", "k,v\n1,2\n")
    assert dict(D.parse("t.zip", z.getvalue())) == {"t.zip!a.html": "One & two\nthree", "t.zip!b.csv": "k, v\n1, 2"}
    assert dict(D.parse("x.json", b'{"a": {"b": [1, null, "z"]}}')) == {"x.json": "a.b[0]: 1\na.b[2]: z"}
    bundle = b'{"type": "bundle", "objects": [{"type": "attack-pattern", "name": "N", "description": "D", "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}]}, {"type": "attack-pattern", "revoked": true}, {"type": "malware"}]}'
    assert dict(D.parse("s.json", bundle)) == {"s.json": "T1 N\nD"}
    nvd = b'{"vulnerabilities": [{"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "bad"}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}], "cvssMetricV31": [{"cvssData": {"baseScore": 9.1}}]}}}]}'
    assert dict(D.parse("n.json", nvd)) == {"n.json": "CVE-1 (score 9.1): bad"}
    assert dict(D.parse("x.xml", b"<?xml version='1.0'?><a>p<!-- c --><b>q</b></a>")) == {"x.xml": "p\nq"}


def test_files_and_eligible_sources(spark, tmp_path):
    from chronoloom.sources import documents as D

    (tmp_path / "a.md").write_text("# T  x\r\n\r\n\r\n\r\nbody")
    (tmp_path / "b.json").write_text("{broken")
    out = {r.name: r for r in D.read_files(spark, str(tmp_path)).collect()}
    assert out["a.md"].text == "# T x\n\nbody" and out["b.json"].error and out["b.json"].text is None
    m = D.manifest(spark, [{"id": "1", "domain": "d", "format": "html", "tier": "A"}, {"id": "2", "domain": "d", "format": "pdf", "tier": "C"}, {"id": "3", "domain": "e", "format": "csv", "tier": "B", "fetch": False}])
    assert [r.id for r in D.eligible(m).collect()] == ["1"]


def test_failures(spark, rules):
    broken = model.loads(model.dumps(rules))
    broken["adversaries"] = []
    length, tag = model.Tagged("uniform", {"min": 2.0, "max": 5.0}), model.Tagged
    broken["failures"] = [
        {"intent": "frozen", "actor": "account", "mode": tag("stuck_attr", {"event": "transfer", "attr": "amount", "value": -999.0}), "prevalence_weight": 1.0, "rate_per_year": 40.0, "duration_days": length},
        {"intent": "quiet", "actor": "account", "mode": tag("silence", {}), "prevalence_weight": 1.0, "rate_per_year": 40.0, "duration_days": length},
        {"intent": "surge", "actor": "account", "mode": tag("rate_shift", {"factor": 3.0}), "prevalence_weight": 1.0, "rate_per_year": 40.0, "duration_days": length, "cascade_p": 0.5},
    ]
    assert model.validate(broken) == []
    e = run(spark, broken, prevalence=0.2)[1]
    by = {r.label: (r.n, r.a) for r in e.groupBy("label").agg(F.count("*").alias("n"), F.max("amount").alias("a")).collect()}
    assert by["frozen"][1] == -999.0 and by["surge"][0] > 0 and "quiet" not in by


@pytest.mark.parametrize("tag,fields", [("uniform_random", {}), ("small_world", {"k": 4, "beta": 0.1}), ("sbm", {"communities": 3, "p_in_weight": 0.8, "p_out_weight": 0.2}), ("rmat", {"a": 0.57, "b": 0.19, "c": 0.19, "d": 0.05}), ("spatial", {"radius": 0.08}), ("forest_fire", {"forward_p": 0.3, "backward_p": 0.2})])
def test_every_topology_builds_a_world(spark, rules, tag, fields):
    other = model.loads(model.dumps(rules))
    other["relations"][0]["model"] = model.Tagged(tag, fields)
    assert model.validate(other) == []
    assert run(spark, other, nodes=300, edges=1500, days=3)[1].count() > 900


# rule bases -------------------------------------------------------------------------------------------------------


def test_rule_bases_round_trip_and_faults(rules):
    assert model.loads(model.dumps(rules)) == rules and "finance" in model.domains()

    def broken(change):
        r = model.loads(model.dumps(rules))
        change(r)
        return model.validate(r)

    bad = [
        lambda r: r["entity_types"][0].update(population_weight=0),
        lambda r: r["event_types"][0]["attributes"][0]["kind"]["dist"].value.update(sigma=-1),
        lambda r: r["behaviors"][0]["events"][0].update(weight=float("nan")),
        lambda r: [e.update(weight=0) for e in r["behaviors"][0]["events"]],
        lambda r: r["constraints"][1]["check"].value.update(max=float("inf")),
        lambda r: r["control"]["placement"].value.update(n_communities=0),
        lambda r: r.update(surprise=1),
        lambda r: r["behaviors"][0]["timing"].update(diurnal=[1.0] * 23),
        lambda r: r["relations"][1].update(model=model.Tagged("preferential_attachment", {"m": 2})),
        lambda r: r["adversaries"][0]["stages"][0].update(rate_per_day=model.Tagged("constant", {"value": 1.0})),
        lambda r: r["event_types"][0]["effects"].append(model.Tagged("add_to_src", {"var": "nothing", "from_attr": "amount"})),
    ]
    assert all(broken(change) for change in bad)


# sinks ------------------------------------------------------------------------------------------------------------


def test_parquet_and_csv_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(0, 10, 100, "transfer", "normal", -1, 5.5, "wire"), (1, 11, 200, "purchase", "normal", -1, None, "ach"), (2, 12, 300, "transfer", "structuring", 7, 7.25, None)], "src bigint, dst bigint, t bigint, event_type string, label string, anomaly_id bigint, amount double, channel string")
    sinks.write(e, f"{tmp_path}/p", "parquet")
    assert sorted(map(tuple, sinks.read_parquet(spark, f"{tmp_path}/p").collect()), key=str) == sorted(map(tuple, e.collect()), key=str)
    sinks.write(e, f"{tmp_path}/c", "csv", ["amount"])
    back = sinks.read_csv(spark, f"{tmp_path}/c", ["amount"])
    assert sorted(r.amount or 0 for r in back.collect()) == [0, 5.5, 7.25] and back.where("label = 'structuring'").first().anomaly_id == 7
    assert sinks.load_edges(spark, f"{tmp_path}/p", "transfer").count() == 2
    with pytest.raises(ValueError):
        sinks.write(e, f"{tmp_path}/x", "xls")


def test_dirty_csv_and_foreign_lists(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d")
    with open(f"{tmp_path}/d/a.csv", "w") as f:
        f.write("src,dst,t,event_type,label,anomaly_id,amount\nx,1,5,e,normal,-1,\n2,3,zz,e,normal,-1,abc\n")
    got = {(r.src, r.dst, r.t, r.amount) for r in sinks.read_csv(spark, f"{tmp_path}/d", ["amount"]).collect()}
    assert got == {(sinks.BAD_ID, 1, 5, None), (2, 3, sinks.BAD_TIME, None)}
    for name, text in (("edges1.txt", "a b 3\nb c 5\n"), ("edges2.csv", "source,target,time\na,b,3\nb,c,5\n"), ("edges3.txt", "a\tb\t3\nb\tc\t5\n")):
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
        assert sorted(map(tuple, sinks.read_edge_list(spark, f"{tmp_path}/{name}").collect())) == [(0, 1, 3.0), (1, 2, 5.0)]
    assert len(sinks.find_edge_lists(str(tmp_path))) == 3


def test_sketches_are_close(spark):
    e = spark.range(20_000).select((F.col("id") % 3000).alias("src"), F.col("id").alias("dst"))
    exact, about = stats.distinct_counts(e).first(), stats.distinct_estimates(e).first()
    assert all(abs(about[c] / exact[c] - 1) < 0.05 for c in ("n_src", "n_dst", "n_pairs"))


def test_cli(capsys, tmp_path):
    from chronoloom import cli

    assert cli.main(["domains"]) == 0 and "finance" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 0
    assert cli.main(["generate", "--preset", "tiny", "--dry-run", "--out", str(tmp_path)]) == 0


def test_sessions_in_whole_seconds_and_strict_gaps(spark, tmp_path):
    """Pauses of exactly the gap, of less in microseconds alone, equal times, no time, no user."""
    con = duckdb.connect()
    con.execute(f"""copy (select row_number() over () event_id, ts::timestamp ts, u::bigint user_id, 'view' event_type, 1.0::double as value, '{{"k": 1}}' props from (values
        ('2024-01-01 00:00:00', 1), ('2024-01-01 06:00:00', 1), ('2024-01-01 11:59:59', 1), ('2024-01-01 11:59:59', 1),
        ('2024-01-01 00:00:00.9', 2), ('2024-01-01 06:00:00.1', 2), ('2024-01-01 12:00:00', 2), (null, 2), (null, 2),
        ('2024-01-01 00:00:00.1', 3), ('2024-01-01 05:59:59.9', 3), (null, 4), ('2024-01-01 01:00:00', null), ('2024-01-01 02:00:00', null)) t(ts, u))
        to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    run, sql = ENTRIES["sessions"]
    want = rows(["src", "start", "n"], con.execute(sql).fetchall())
    assert rows(["src", "start", "n"], run(spark, str(tmp_path)).select("src", "start", "n").collect()) == want and len(want) == 10


def test_weighted_picks_never_make_units_into_rows(spark):
    """Weights that would be 3 billion units; the picks are those of running totals, a null node's last."""
    weights = [(5, 2_000_000_000), (3, 1), (9, 999_999_990), (None, 9)] + [(k, 1) for k in range(100, 1100)]
    got = topology.weighted_picks(spark, spark.createDataFrame(weights, "node bigint, w bigint"), 3000, 11, "src").collect()
    order = sorted(weights, key=lambda x: (x[0] is None, x[0] or 0))
    ends = np.cumsum([w for _, w in order])
    draws = spark.range(3000).select("id", F.floor(H.u(H.BASELINE, 11, F.col("id")) * F.lit(int(ends[-1]))).alias("x")).collect()
    assert sorted((r.id, r.src) for r in got) == sorted((d.id, order[int(np.searchsorted(ends, d.x, "right"))][0]) for d in draws)
