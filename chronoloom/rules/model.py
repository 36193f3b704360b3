"""Rule bases as plain data: loading tagged YAML and validating it.

A rule base is a mapping with meta, entity_types, relations, event_types, behaviors, constraints, adversaries, failures
and control. A variant is written !name {fields} in YAML and is Tagged(name, fields) here. validate() returns every
fault as "path: what is wrong", so that an author sees all of them at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from pathlib import Path

DOMAINS = Path(__file__).parent / "domains"

# The variants of the format and their fields.
DISTRIBUTIONS = {"constant": ["value"], "uniform": ["min", "max"], "normal": ["mean", "std"], "log_normal": ["mu", "sigma"], "exponential": ["rate"], "pareto": ["scale", "shape"], "zipf": ["n", "exponent"], "poisson": ["lambda"]}
KINDS = {"categorical": "values", "ordinal": "tiers", "taxonomy": "paths", "numeric": "dist", "flag": "p"}
TOPOLOGIES = {"preferential_attachment": ["m"], "uniform_random": [], "small_world": ["k", "beta"], "forest_fire": ["forward_p", "backward_p"], "sbm": ["communities", "p_in_weight", "p_out_weight"], "rmat": ["a", "b", "c", "d"], "spatial": ["radius"], "affiliation": ["popularity"]}
SAME_TYPE = {"preferential_attachment", "small_world", "forest_fire"}
EFFECTS = {"add_to_dst": True, "add_to_src": True, "sub_from_src": True, "sub_from_dst": True, "increment_src": False, "increment_dst": False, "set_src": False, "set_dst": False}
COUNTERPARTIES = {"skeleton_neighbor": ["relation"], "repeat_or_neighbor": ["relation", "repeat_p"], "global_popularity": ["entity"], "global_uniform": ["entity"]}
CHECKS = {"attr_range": ["event", "attr"], "state_non_negative": ["entity", "var"], "rate_limit": ["event", "k", "window_s"], "sub_threshold_count": ["event", "attr", "threshold", "floor", "k", "window_s"], "documented": ["rule"]}
SCOPES = {"ring", "chain", "collector", "hub", "normal", "victims", "sources"}
FAILURES = {"silence": [], "stuck_attr": ["event", "attr", "value"], "drift_attr": ["event", "attr", "drift_per_day"], "rate_shift": ["factor"], "noise_attr": ["event", "attr", "dist"]}
PLACEMENTS = {"uniform", "clustered", "time_window", "clustered_bursty"}
RATES = ("activity_multiplier", "rate_per_day", "event_count")
SECTIONS = ["meta", "entity_types", "relations", "event_types", "behaviors", "constraints", "adversaries", "failures", "control"]


@dataclass
class Tagged:
    tag: str
    value: dict = field(default_factory=dict)

    def __getitem__(self, key):
        return self.value[key]

    def get(self, key, default=None):
        return (self.value or {}).get(key, default)


def _yaml():
    import yaml  # an extra: rule bases can also be given as Python data

    class Loader(yaml.SafeLoader):
        pass

    def tagged(loader, suffix, node):
        if isinstance(node, yaml.MappingNode):
            return Tagged(suffix, loader.construct_mapping(node, deep=True))
        if isinstance(node, yaml.SequenceNode):
            return Tagged(suffix, {"items": loader.construct_sequence(node, deep=True)})
        return Tagged(suffix, {})

    Loader.add_multi_constructor("!", tagged)

    class Dumper(yaml.SafeDumper):
        pass

    def show(dumper, x):
        return dumper.represent_mapping(f"!{x.tag}", x.value) if x.value else dumper.represent_scalar(f"!{x.tag}", "")

    Dumper.add_representer(Tagged, show)
    return yaml, Loader, Dumper


def loads(text: str) -> dict:
    yaml, loader, _ = _yaml()
    rules = yaml.load(text, Loader=loader)
    if not isinstance(rules, dict):
        raise ValueError("a rule base is a mapping")
    return rules


def dumps(rules: dict) -> str:
    yaml, _, dumper = _yaml()
    return yaml.dump(rules, Dumper=dumper, sort_keys=False)


def domains() -> list[str]:
    return sorted(p.stem for p in DOMAINS.glob("*.yaml"))


def load(name_or_path: str) -> dict:
    """A built-in domain by name, or a file; valid, or ValueError with every fault."""
    path = DOMAINS / f"{name_or_path}.yaml"
    rules = loads((path if path.exists() else Path(name_or_path)).read_text())
    if faults := validate(rules):
        raise ValueError("\n".join(faults))
    return rules


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


class _Checker:
    def __init__(self, rules: dict):
        self.rules, self.faults = rules, []

    def fault(self, path: str, what: str) -> None:
        self.faults.append(f"{path}: {what}")

    def need(self, ok, path: str, what: str) -> bool:
        if not ok:
            self.fault(path, what)
        return bool(ok)

    def keys(self, x, allowed: set, needed: set, path: str) -> bool:
        if not self.need(isinstance(x, dict), path, "must be a mapping"):
            return False
        for k in x.keys() - allowed:
            self.fault(f"{path}.{k}", "unknown field")
        for k in needed - x.keys():
            self.fault(f"{path}.{k}", "missing")
        return needed <= x.keys()

    def variant(self, x, allowed, path: str) -> bool:
        if not self.need(isinstance(x, Tagged) and x.tag in allowed, path, f"must be one of {', '.join(sorted(allowed))}"):
            return False
        missing = [k for k in (allowed[x.tag] if isinstance(allowed, dict) and isinstance(allowed[x.tag], list) else []) if k not in x.value]
        return self.need(not missing, path, f"{x.tag} needs {', '.join(missing)}")

    def dist(self, x, path: str) -> None:
        if not self.variant(x, DISTRIBUTIONS, path):
            return
        p = x.value
        if not self.need(all(_number(p[k]) for k in DISTRIBUTIONS[x.tag]), path, "parameters must be finite numbers"):
            return
        rules = {
            "uniform": lambda: p["min"] <= p["max"], "normal": lambda: p["std"] >= 0, "log_normal": lambda: p["sigma"] >= 0, "exponential": lambda: p["rate"] > 0,
            "pareto": lambda: p["scale"] > 0 and p["shape"] > 0, "zipf": lambda: p["n"] >= 1 and p["exponent"] > 0, "poisson": lambda: p["lambda"] >= 0,
        }
        self.need(rules.get(x.tag, lambda: True)(), path, f"{x.tag}: parameters out of range")

    def weights(self, names, weights, path: str) -> None:
        ok = isinstance(names, list) and isinstance(weights, list) and len(names) == len(weights) and names
        if self.need(ok, path, "values and weights must be lists of one length"):
            self.need(all(_number(w) and w >= 0 for w in weights) and sum(weights) > 0, path, "weights must be finite, not negative and not all 0")
            self.need(len(set(map(str, names))) == len(names), path, "values repeat")

    def attribute(self, a, path: str) -> None:
        if not self.keys(a, {"name", "kind"}, {"name", "kind"}, path) or not self.variant(a["kind"], KINDS, f"{path}.kind"):
            return
        kind = a["kind"]
        if kind.tag == "numeric":
            self.dist(kind.get("dist"), f"{path}.kind.dist")
        elif kind.tag == "flag":
            self.need(_number(kind.get("p")) and 0 <= kind["p"] <= 1, f"{path}.kind.p", "must be in [0, 1]")
        else:
            self.weights(kind.get(KINDS[kind.tag]), kind.get("weights"), f"{path}.kind")

    def named(self, section: str) -> dict:
        found: dict = {}
        for i, x in enumerate(self.rules.get(section) or []):
            key = "intent" if section in ("adversaries", "failures") else "name"
            if not self.need(isinstance(x, dict) and isinstance(x.get(key), str), f"{section}[{i}]", f"needs a {key}"):
                continue
            self.need(x[key] not in found, f"{section}[{i}]", f"{x[key]} is defined twice")
            found[x[key]] = x
        return found

    def run(self) -> list[str]:
        r = self.rules
        if not self.keys(r, set(SECTIONS), {"meta", "entity_types", "event_types", "behaviors", "control"}, "rules"):
            return self.faults
        self.keys(r["meta"], {"id", "name", "description", "schema_version", "provenance"}, {"id", "name"}, "meta")
        types, relations, events = self.named("entity_types"), self.named("relations"), self.named("event_types")
        self.named("behaviors"), self.named("constraints")
        intents = self.named("adversaries")
        for name, f in self.named("failures").items():
            self.need(name not in intents and name != "normal", f"failures.{name}", "the intent is taken")
            intents[name] = f
        for name, t in types.items():
            path = f"entity_types.{name}"
            self.keys(t, {"name", "population_weight", "attributes", "state"}, {"population_weight"}, path)
            self.need(_number(t.get("population_weight")) and t["population_weight"] > 0, f"{path}.population_weight", "must be over 0")
            for a in t.get("attributes") or []:
                self.attribute(a, f"{path}.{a.get('name') if isinstance(a, dict) else a}")
            for s in t.get("state") or []:
                if self.keys(s, {"name", "init"}, {"name", "init"}, f"{path}.state"):
                    self.dist(s["init"], f"{path}.state.{s['name']}")
        attr = lambda e, a: next((x["kind"] for x in (events.get(e) or {}).get("attributes") or [] if x.get("name") == a), None)
        for name, x in relations.items():
            path = f"relations.{name}"
            self.keys(x, {"name", "src", "dst", "model", "layer", "mean_degree"}, {"src", "dst", "model", "mean_degree"}, path)
            for end in ("src", "dst"):
                self.need(x.get(end) in types, f"{path}.{end}", "no such entity type")
            self.need(_number(x.get("mean_degree")) and x["mean_degree"] > 0, f"{path}.mean_degree", "must be over 0")
            if self.variant(x.get("model"), TOPOLOGIES, f"{path}.model"):
                m = x["model"]
                self.need(m.tag not in SAME_TYPE or x.get("src") == x.get("dst"), f"{path}.model", f"{m.tag} joins one type to itself")
                if m.tag == "rmat":
                    self.need(abs(sum(m[k] for k in "abcd") - 1) < 1e-9, f"{path}.model", "a + b + c + d must be 1")
                if m.tag == "sbm":
                    self.need(m["communities"] >= 1 and m["p_in_weight"] >= 0 and m["p_out_weight"] >= 0 and m["p_in_weight"] + m["p_out_weight"] > 0, f"{path}.model", "needs a community and a weight")
                if m.tag == "spatial":
                    self.need(0 < m["radius"] <= 0.5, f"{path}.model", "radius must be in (0, 0.5]")
                if m.tag == "affiliation":
                    self.dist(m["popularity"], f"{path}.model.popularity")
        for name, e in events.items():
            path = f"event_types.{name}"
            self.keys(e, {"name", "src", "dst", "attributes", "effects"}, {"src", "dst"}, path)
            for end in ("src", "dst"):
                self.need(e.get(end) in types, f"{path}.{end}", "no such entity type")
            for a in e.get("attributes") or []:
                self.attribute(a, f"{path}.{a.get('name') if isinstance(a, dict) else a}")
            for k, fx in enumerate(e.get("effects") or []):
                if self.variant(fx, EFFECTS, f"{path}.effects[{k}]"):
                    side = e.get("dst" if fx.tag.endswith("dst") else "src")
                    self.need(any(s.get("name") == fx.get("var") for s in (types.get(side) or {}).get("state") or []), f"{path}.effects[{k}]", f"{side} has no state {fx.get('var')}")
                    if EFFECTS[fx.tag]:
                        self.need(attr(name, fx.get("from_attr")) is not None, f"{path}.effects[{k}]", f"no attribute {fx.get('from_attr')}")
        for i, b in enumerate(r.get("behaviors") or []):
            self.behavior(b, f"behaviors.{b.get('name', i)}", types, relations, events)
        for c in r.get("constraints") or []:
            path = f"constraints.{c.get('name')}"
            if self.variant(c.get("check"), CHECKS, f"{path}.check"):
                k = c["check"]
                self.need(k.get("event") is None or k["event"] in events, path, "no such event")
                self.need(k.get("attr") is None or attr(k.get("event"), k["attr"]) is not None, path, "no such attribute")
                self.need(all(k.get(x) is None or _number(k[x]) for x in ("min", "max", "k", "window_s", "threshold", "floor")), path, "bounds must be finite")
                self.need(k.get("min") is None or k.get("max") is None or k["min"] <= k["max"], path, "min is over max")
        for a in r.get("adversaries") or []:
            self.adversary(a, f"adversaries.{a.get('intent')}", types, events, attr)
        for f in r.get("failures") or []:
            path = f"failures.{f.get('intent')}"
            self.keys(f, {"intent", "description", "actor", "mode", "prevalence_weight", "rate_per_year", "duration_days", "cascade_p"}, {"actor", "mode", "prevalence_weight", "rate_per_year", "duration_days"}, path)
            self.need(f.get("actor") in types, f"{path}.actor", "no such entity type")
            if self.variant(f.get("mode"), FAILURES, f"{path}.mode"):
                self.need(f["mode"].get("event") is None or attr(f["mode"]["event"], f["mode"].get("attr")) is not None, f"{path}.mode", "no such event or attribute")
            self.dist(f.get("duration_days"), f"{path}.duration_days")
        self.control(r["control"], intents)
        return self.faults

    def behavior(self, b, path, types, relations, events) -> None:
        if not self.keys(b, {"name", "actor", "actor_filter", "timing", "events", "activity"}, {"actor", "timing", "events"}, path):
            return
        self.need(b["actor"] in types, f"{path}.actor", "no such entity type")
        own = {a["name"]: a["kind"] for a in (types.get(b["actor"]) or {}).get("attributes") or []}
        for f in b.get("actor_filter") or []:
            kind = own.get(f.get("attr"))
            ok = isinstance(kind, Tagged) and kind.tag != "numeric" and (kind.tag == "flag" or f.get("value") in kind.get(KINDS[kind.tag], []))
            self.need(ok, f"{path}.actor_filter", f"{f.get('attr')} = {f.get('value')}: no such categorical value")
        t = b["timing"]
        self.need(_number(t.get("rate_per_day")) and t["rate_per_day"] > 0, f"{path}.timing.rate_per_day", "must be over 0")
        for k, n in (("diurnal", 24), ("weekly", 7)):
            if t.get(k) is not None:
                self.need(isinstance(t[k], list) and len(t[k]) == n and all(_number(x) and x >= 0 for x in t[k]) and sum(t[k]) > 0, f"{path}.timing.{k}", f"must be {n} numbers, not all 0")
        self.need(0 <= t.get("burst_p", 0) <= 1, f"{path}.timing.burst_p", "must be in [0, 1]")
        ratio, arrival = t.get("branching_ratio", 0), t.get("arrival")
        self.need(_number(ratio) and 0 <= ratio < 1, f"{path}.timing.branching_ratio", "must be in [0, 1)")
        shaped = not (isinstance(arrival, Tagged) and arrival.tag == "weibull") or (_number(arrival.get("shape")) and arrival["shape"] > 0)
        self.need(shaped, f"{path}.timing.arrival", "the shape must be over 0")
        if self.need(b["events"] and sum(e.get("weight", 0) for e in b["events"]) > 0 and all(_number(e.get("weight")) and e["weight"] >= 0 for e in b["events"]), f"{path}.events", "weights must be finite, not negative and not all 0"):
            for e in b["events"]:
                if not self.need(e.get("event") in events, f"{path}.events", f"no such event: {e.get('event')}"):
                    continue
                ev = events[e["event"]]
                self.need(ev.get("src") == b["actor"], f"{path}.events.{e['event']}", "the event starts at another type")
                if self.variant(e.get("counterparty"), COUNTERPARTIES, f"{path}.events.{e['event']}.counterparty"):
                    c = e["counterparty"]
                    if "relation" in COUNTERPARTIES[c.tag]:
                        rel = relations.get(c["relation"])
                        self.need(rel is not None and rel.get("src") == b["actor"] and rel.get("dst") == ev.get("dst"), f"{path}.events.{e['event']}.counterparty", "the relation must lead from the actor to the event's target type")
                    else:
                        self.need(c["entity"] == ev.get("dst"), f"{path}.events.{e['event']}.counterparty", "must be the event's target type")
        if b.get("activity") is not None:
            self.dist(b["activity"], f"{path}.activity")

    def adversary(self, a, path, types, events, attr) -> None:
        if not self.keys(a, {"intent", "description", "actor", "stages", "camouflage", "prevalence_weight", "ring_size", "cascade_p"}, {"actor", "stages", "camouflage", "prevalence_weight", "ring_size"}, path):
            return
        self.need(a["actor"] in types, f"{path}.actor", "no such entity type")
        self.need(_number(a["camouflage"]) and 0 <= a["camouflage"] <= 1, f"{path}.camouflage", "must be in [0, 1]")
        self.need(_number(a["prevalence_weight"]) and a["prevalence_weight"] >= 0, f"{path}.prevalence_weight", "must not be negative")
        self.dist(a["ring_size"], f"{path}.ring_size")
        for s in a["stages"]:
            at = f"{path}.{s.get('name')}"
            if not self.need(s.get("event") in events, at, "no such event"):
                continue
            e = events[s["event"]]
            self.dist(s.get("duration_days"), f"{at}.duration_days")
            self.need(sum(k in s for k in RATES) == 1, at, f"needs exactly one of {', '.join(RATES)}")
            if isinstance(s.get("scope"), Tagged) and self.need(s["scope"].tag in SCOPES, f"{at}.scope", "no such scope"):
                side = e["dst"] if s["scope"].tag == "sources" else e["src"]
                self.need(side == a["actor"], f"{at}.scope", "the actor isn't on the member's side of the event")
                self.need(s["scope"].tag not in ("ring", "chain", "hub") or e["src"] == e["dst"], f"{at}.scope", f"{s['scope'].tag} needs an event within one type")
                if s["scope"].tag in ("victims", "sources"):
                    self.dist(s["scope"].get("count"), f"{at}.scope.count")
            else:
                self.need(isinstance(s.get("scope"), Tagged), f"{at}.scope", "needs a scope")
            for o in s.get("attr_overrides") or []:
                kind = attr(s["event"], o.get("attr"))
                self.need(isinstance(kind, Tagged), f"{at}.attr_overrides", f"{o.get('attr')}: no such attribute")
                self.dist(o.get("dist"), f"{at}.attr_overrides.{o.get('attr')}")

    def control(self, c, intents) -> None:
        self.keys(c, {"prevalence", "difficulty", "type_mix", "placement", "cascade", "homophily"}, {"prevalence", "difficulty"}, "control")
        self.need(_number(c.get("prevalence")) and 0 <= c["prevalence"] <= 0.5, "control.prevalence", "must be in [0, 0.5]")
        self.need(_number(c.get("difficulty")) and 0 <= c["difficulty"] <= 1, "control.difficulty", "must be in [0, 1]")
        for m in c.get("type_mix") or []:
            self.need(m.get("intent") in intents, "control.type_mix", f"no such intent: {m.get('intent')}")
        p = c.get("placement")
        if p is not None and self.need(isinstance(p, Tagged) and p.tag in PLACEMENTS, "control.placement", f"must be one of {', '.join(sorted(PLACEMENTS))}"):
            if "clustered" in p.tag:
                self.need(p.get("n_communities", 0) >= 1, "control.placement", "needs a community")
            if p.tag in ("time_window", "clustered_bursty"):
                self.need(0 <= p.get("start_frac", -1) < p.get("end_frac", -1) <= 1, "control.placement", "needs 0 <= start_frac < end_frac <= 1")


def validate(rules: dict) -> list[str]:
    return _Checker(rules).run()
