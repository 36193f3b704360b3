"""Command line: python -m chronoloom.cli domains | generate | stats | validate | doctor."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys


def host() -> dict:
    """What can be known of this machine; unknown is null, not 0."""
    out: dict = {"cpus": os.cpu_count(), "disk_free": shutil.disk_usage(".").free, "memory": None}
    try:
        out["memory"] = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        pass
    return out


# Bytes an edge takes on disk by format, and in memory with its node.
DISK_BYTES = {"parquet": 24, "csv": 64, "graphml": 160}
NODE_BYTES, EDGE_BYTES = 96, 48


def estimate(nodes: int, edges: int, kind: str, cores: int, edges_per_core: float = 50_000.0, partition_mb: int = 128) -> dict:
    """Size and time of a run, and how many shuffle partitions it wants."""
    shuffle = edges * (EDGE_BYTES + 60)
    return {
        "disk_bytes": edges * DISK_BYTES[kind], "state_bytes": nodes * NODE_BYTES + edges * EDGE_BYTES, "seconds": round(edges / (edges_per_core * max(cores, 1)), 1),
        "shuffle_partitions": max(cores, -(-shuffle // (partition_mb << 20))),
    }


def node_count(spark, folder: str, types: list[str]) -> int:
    """Entities in the node tables beside the edges: what ids must be under, whatever the edges hold."""
    return sum(spark.read.parquet(f"{folder}/nodes_{t}").count() for t in types)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronoloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    d = sub.add_parser("domains")
    d.add_argument("--show")
    g = sub.add_parser("generate")
    g.add_argument("--domain", default="finance")
    g.add_argument("--preset", choices=["tiny", "small", "medium", "large", "huge"])
    for name, kind in (("nodes", int), ("edges", int), ("days", int), ("seed", int), ("prevalence", float), ("difficulty", float), ("cascade", float), ("granularity", int), ("shard-index", int), ("shard-count", int)):
        g.add_argument(f"--{name}", type=kind)
    g.add_argument("--no-anomalies", action="store_true")
    g.add_argument("--format", default="parquet", choices=sorted(DISK_BYTES))
    g.add_argument("--dry-run", action="store_true")
    g.add_argument("--out", required=True)
    for name in ("stats", "validate"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--domain", default="finance")
    args = p.parse_args(argv)

    from chronoloom.rules import model

    if args.command == "doctor":
        print(json.dumps(host()))
        return 0
    if args.command == "domains":
        if args.show:
            rules = model.load(args.show)
            print(json.dumps({"id": args.show, "entity_types": [t["name"] for t in rules["entity_types"]], "event_types": [t["name"] for t in rules["event_types"]], "intents": [a["intent"] for a in [*(rules.get("adversaries") or []), *(rules.get("failures") or [])]]}))
        else:
            print("\n".join(model.domains()))
        return 0

    from chronoloom.operators import checks, stats
    from chronoloom.plans import simulate
    from chronoloom.session import build_session
    from chronoloom.sources import sinks

    if args.command == "generate":
        given = {k: getattr(args, k) for k in ("nodes", "edges", "days", "seed", "prevalence", "difficulty", "cascade", "granularity", "shard_index", "shard_count") if getattr(args, k) is not None}
        config = simulate.preset(args.preset, **given) if args.preset else simulate.Config(**given)
        config.anomalies = not args.no_anomalies
        config.validate()
        print(json.dumps(estimate(config.nodes, config.edges, args.format, os.cpu_count() or 1)))
        if args.dry_run:
            return 0
        spark = build_session()
        world, edges = simulate.generate(spark, model.load(args.domain), config)
        for name in world.types:
            world.nodes(name).write.mode("overwrite").parquet(f"{args.out}/nodes_{name}")
        if args.format == "graphml":
            ids = spark.range(sum(n for _, n in world.layout.values()))
            sinks.write(edges.withColumn("id", sinks.F.monotonically_increasing_id()), f"{args.out}/edges", "graphml", world.attribute_names(), ids)
        else:
            sinks.write(edges, f"{args.out}/edges", args.format, world.attribute_names())
        world.ground_truth().write.mode("overwrite").json(f"{args.out}/ground_truth")
        about = {"domain": args.domain, "seed": config.seed, "nodes": config.nodes, "edges": config.edges, "days": config.days, "epoch": config.epoch, "spark": spark.version, "format": args.format}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/meta")
        return 0

    spark = build_session()
    edges = sinks.read_stream_order(spark, args.path)
    if args.command == "stats":
        stats.battery(edges).show(truncate=False)
        return 0
    rules = model.load(args.domain)
    n = node_count(spark, args.path.rstrip("/").rsplit("/", 1)[0], [t["name"] for t in rules["entity_types"]])
    labels = ["normal", *[a["intent"] for a in [*(rules.get("adversaries") or []), *(rules.get("failures") or [])]]]
    verdict = checks.hard_checks(edges, n, [e["name"] for e in rules["event_types"]], labels).first()
    print(json.dumps(verdict.asDict()))
    for c in rules.get("constraints") or []:
        k = c["check"]
        if k.tag == "attr_range":
            found = checks.attribute_range(edges, [(c["name"], k["event"], k["attr"], k.get("min"), k.get("max"))]).first()["violations"]
        elif k.tag in ("rate_limit", "sub_threshold_count"):
            own = edges.where(sinks.F.col("event_type") == k["event"])
            own = checks.near_threshold(own, k["event"], k["attr"], k["floor"], k["threshold"]) if k.tag == "sub_threshold_count" else own
            found = checks.limit_violations_by_groups(own, int(k["k"]), int(k["window_s"])).agg(sinks.F.sum("violations")).first()[0] or 0
        else:
            continue
        print(json.dumps({"constraint": c["name"], "violations": found}))
    return 0 if verdict["verdict"] == "ok" else 1


if __name__ == "__main__":
    sys.exit(main())
