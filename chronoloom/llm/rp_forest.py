"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors collapse first. Each tree splits space at random directions, at the median of a node's sample; a vector
whose projection is within the spill band of the split goes to both sides (Dasgupta and Sinha 2013). The band is SPILL
standard deviations of the projected difference of a pair at the threshold: about a tenth of a node's vectors go both
ways, and a pair at the threshold is parted by 3 % of the splits; over 10 levels a tree keeps 7 of 10 such pairs, and
TREES trees all but one in a thousand. Closer pairs are parted less.

The trees are fitted on a bounded sample of SAMPLE vectors (SAMPLE_VALUES numbers, where vectors are long), those with the
smallest hashes, until a leaf holds at most LEAF of the sample. As a table can be much larger than the sample, leaves that hold more than WIDE vectors get a tree of
their own, fitted on SLOTS of their vectors, in further rounds, until each fits or can't be split (nearly all its vectors
would go both ways); such a leaf is compared in blocks of WIDE. A round divides a leaf by about SLOTS / LEAST_LEAF, so
their number grows with the logarithm of the table. Every vector is indexed; nothing is capped or dropped.

Within leaves all pairs are compared by cosine in double precision and those at or above the threshold are links. Every
row of a leaf knows all leaves of its vector, so a link is counted in the first leaf that both share, and nowhere else. A
leaf gives each of its vectors' number of links and the least vector reachable within the leaf, never the pairs, so what
leaves it is linear in its vectors. n_links counts the copies in linked classes, which aren't expanded into pairs either.

Defined cases: a null vector, one with null or non-finite components, or a zero one has no links; vectors of another
length than the most frequent one are compared with their own length only; a null vec_id is its own component (null)
and no one's partner; rows that share a vec_id count as separate vectors; labels and other columns aren't read.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize
from chronoloom.llm.components import components, roots
from chronoloom.llm.fitting import hash_sample

TREES, LEAF, SAMPLE, WIDE, SLOTS, LEAST_LEAF = 6, 160, 20_000, 1024, 512, 16
SAMPLE_VALUES = 20_000_000
SPILL = 0.4
#: A split is made only if neither side gets more than this share of the vectors. A median split of vectors that aren't near
#: each other gives either side about 0.55; where nearly all lie within the band, a split would only copy them, again and
#: again, so such a leaf stays whole and is compared in blocks.
LARGEST_SIDE = 0.65
#: Rows in a batch that goes back to the JVM.
_BATCH = 5000


@functools.lru_cache(maxsize=8192)
def direction(seed: int, dims: int) -> np.ndarray:
    d = np.random.default_rng(seed).standard_normal(dims)
    return d / np.linalg.norm(d)


class Tree:
    """Flat arrays: seed of the direction and cut of each inner node, children (negative: leaf number + 1, negated)."""

    def __init__(self, seeds, cuts, left, right):
        self.seeds, self.cuts, self.left, self.right = (np.asarray(x, t) for x, t in ((seeds, np.int64), (cuts, np.float64), (left, np.int64), (right, np.int64)))

    def to_bytes(self) -> bytes:
        return np.concatenate([self.seeds, self.cuts.view(np.int64), self.left, self.right]).tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> Tree:
        seeds, cuts, left, right = np.frombuffer(raw, np.int64).reshape(4, -1)
        return Tree(seeds, cuts.view(np.float64), left, right)

    def route(self, x: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf numbers of each row of x; spilled rows have several."""
        out_rows, out_leaves = [], []
        todo = [(0 if len(self.cuts) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out_rows.append(rows)
                out_leaves.append(np.full(len(rows), -node - 1))
                continue
            p = x[rows] @ direction(int(self.seeds[node]), x.shape[1]) - self.cuts[node]
            todo += [(int(self.left[node]), rows[p <= band]), (int(self.right[node]), rows[p > -band])]
        return (np.concatenate(out_rows), np.concatenate(out_leaves)) if out_rows else (np.zeros(0, int), np.zeros(0, int))


def spill_band(dims: int, threshold: float) -> float:
    """A pair at the threshold differs by a vector of length sqrt(2 - 2 t), whose projection on a random unit direction deviates by that / sqrt(dims)."""
    return SPILL * math.sqrt(max(2 - 2 * threshold, 0)) / math.sqrt(dims)


def build_tree(x: np.ndarray, seed: int, band: float, leaf: int) -> Tree:
    seeds, cuts, left, right, leaves, tried = [], [], [], [], 0, 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        for _ in range(4 if len(rows) > leaf else 0):  # a direction along which the node is wider than the band
            tried += 1
            p = x[rows] @ direction(seed * 1_000_003 + tried, x.shape[1])
            cut = float(np.median(p))
            if max((p <= cut + band).sum(), (p > cut - band).sum()) <= LARGEST_SIDE * len(rows):
                split = seed * 1_000_003 + tried, cut, p
                break
        if split is None:
            leaves += 1
            ref = -leaves
        else:
            own, cut, p = split
            ref = len(cuts)
            seeds.append(own)
            cuts.append(cut)
            left.append(0)
            right.append(0)
            todo += [(rows[p <= cut + band], ref, 0), (rows[p > cut - band], ref, 1)]
        if parent is not None:
            (left if side == 0 else right)[parent] = ref
    return Tree(seeds, cuts, left, right)


def unit_rows(column, dims: int) -> np.ndarray:
    """A list column's vectors, normalised in double precision; scaled first, so that squares neither overflow nor vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, dims, k (hash of v) of the vectors that can have links."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).select("vec_id", "v", F.size("v").alias("dims"), F.xxhash64("v").alias("k"))


def _leaf_rows(vecs: DataFrame, dims: int, trees: list[Tree], band: float) -> DataFrame:
    """leaf, rep, v: one row for each leaf that a vector falls in."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column("v"), dims)
            for t, tree in enumerate(trees):
                rows, leaf = tree.route(x, band)
                for k in range(0, len(rows), _BATCH):
                    at = pa.array(rows[k : k + _BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array([f"{t}:{n}:" for n in leaf[k : k + _BATCH].tolist()], pa.string()), b.column("rep").take(at), b.column("v").take(at)], ["leaf", "rep", "v"])

    types = {f.name: f.dataType.simpleString() for f in vecs.schema.fields}
    return vecs.select("rep", "v").mapInArrow(run, f"leaf string, rep {types['rep']}, v {types['v']}")


def _elsewhere(mine: np.ndarray, other: np.ndarray, step: int = 4_000_000) -> np.ndarray:
    """For each row of two tables of leaves (padded with values that the other hasn't): whether a leaf is in both."""
    out = np.zeros(len(mine), bool)
    step = max(1, step // max(mine.shape[1] * other.shape[1], 1))
    for k in range(0, len(mine), step):
        out[k : k + step] = (mine[k : k + step, :, None] == other[k : k + step, None, :]).any((1, 2))
    return out


def _before(leaves: list[np.ndarray], leaf: int, pad: int) -> np.ndarray:
    """The leaves of each row that come before this one."""
    width = max((len(x) for x in leaves), default=0)
    out = np.full((len(leaves), max(width, 1)), pad, np.int64)
    for k, x in enumerate(leaves):
        x = x[x < leaf]
        out[k, : len(x)] = x
    return out


def _compare(threshold: float, dims: int):
    def run(key, tbl):
        ids = tbl.column("rep").combine_chunks().to_numpy(zero_copy_only=False)
        x = unit_rows(tbl.column("v"), dims)
        side, copies = (tbl.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("side", "copies"))
        column, leaf = tbl.column("leaves").combine_chunks(), key[0].as_py()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        leaves = [flat[a:b] for a, b in itertools.pairwise(ends.tolist())]
        before = _before(leaves, leaf, np.iinfo(np.int64).max), _before(leaves, leaf, np.iinfo(np.int64).max - 1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(right)
        right = left if within else right
        others, found_i, found_j = np.zeros(len(ids), np.int64), [ids[:0]], [ids[:0]]
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
            i, j = rows[i], right[j]
            keep = i < j if within else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            first = ~_elsewhere(before[0][i], before[1][j])
            i, j = i[first], j[first]
            others += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            node, root = roots(ids[i], ids[j])  # a forest of these rows' links
            found_i.append(node)
            found_j.append(root)
        node, root = roots(np.concatenate(found_i), np.concatenate(found_j))
        linked = np.flatnonzero(others)
        none = pa.nulls(len(node), pa.int64())
        reps = pa.concat_arrays([pa.array(ids[linked], tbl.schema.field("rep").type), pa.array(node, tbl.schema.field("rep").type)])
        return pa.table({"rep": reps, "others": pa.concat_arrays([pa.array(others[linked]), none]), "root": pa.concat_arrays([pa.nulls(len(linked), reps.type), pa.array(root, reps.type)])})

    return run


def links(reps: DataFrame, dims: int, threshold: float, rounds: int = 8) -> DataFrame:
    """For different vectors (rep, v, copies): rows (rep, others) with numbers of linked vectors, which add up, and rows
    (rep, root) that join the links' components; a written table."""
    band = spill_band(dims, threshold)
    rep_type = reps.schema["rep"].dataType.simpleString()
    # a bounded sample of SAMPLE vectors comes to the driver
    sample = hash_sample(reps.select("rep", "v"), "rep", max(LEAF, min(SAMPLE, SAMPLE_VALUES // dims)), 31).toArrow()
    x = unit_rows(sample.column("v"), dims)
    trees = [build_tree(x, 1000 + t, band, LEAF) for t in range(TREES)]
    wide = materialize(_leaf_rows(reps, dims, trees, band), "rp-leaves")
    held, done = [wide], None
    for r in range(rounds + 1):
        sizes = materialize(wide.groupBy("leaf").agg(F.count("*").alias("n")), "rp-sizes")
        held.append(sizes)
        big = sizes.where(F.col("n") > WIDE)
        last = r == rounds or not big.limit(1).count()
        if not last:
            own = materialize(_own_trees(wide.join(big, "leaf"), dims, band, 7000 + r), "rp-trees")
            held.append(own)
            sizes = sizes.join(own.select("leaf", F.col("tree").isNotNull().alias("again")), "leaf", "left").where(~F.coalesce("again", F.lit(False))).select("leaf", "n")
        kept = wide.select("leaf", "rep").join(sizes.select("leaf", F.ceil(F.col("n") / WIDE).cast("int").alias("blocks")), "leaf")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        wide = materialize(_split_again(wide, own.where("tree is not null"), dims, band), "rp-wide")
        held.append(wide)
    # a vector's leaves: a few for each tree, as only about a tenth of a node's vectors go both ways
    places = done.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("leaf").alias("leaf"), "blocks"))).alias("places"))
    rows = reps.select("rep", "v", "copies").join(places, "rep").withColumn("leaves", F.transform("places", lambda p: p["leaf"]))
    rows = rows.select("rep", "v", "copies", "leaves", F.inline("places")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leaf", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"), "rep", "v", "copies", "leaves")
    found = rows.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold, dims), f"rep {rep_type}, others bigint, root {rep_type}")
    out = materialize(found, "rp-links")
    discard(*held)
    return out


def _own_trees(rows: DataFrame, dims: int, band: float, seed: int) -> DataFrame:
    """leaf, tree: a tree for each leaf (rows: leaf, rep, v, n) from SLOTS of its vectors at most, those that own a hash slot; null if it can't be split."""
    h = F.xxhash64("rep", F.lit(seed))
    sampled = rows.groupBy("leaf", "n", F.pmod(h, F.lit(SLOTS)).alias("s")).agg(F.min_by("v", h).alias("v"))

    def run(key, tbl):
        name, n = key[0].as_py(), key[1].as_py()
        x = unit_rows(tbl.column("v"), dims)
        tree = build_tree(x, zlib.crc32(f"{seed}{name}".encode()), band, max(LEAST_LEAF, len(x) * WIDE // (2 * n)))
        return pa.table({"leaf": pa.array([name], pa.string()), "tree": pa.array([tree.to_bytes() if len(tree.cuts) else None], pa.binary())})

    return sampled.groupBy("leaf", "n").applyInArrow(run, "leaf string, tree binary")


def _split_again(rows: DataFrame, trees: DataFrame, dims: int, band: float) -> DataFrame:
    """Each row of a leaf that has a tree, once for each of the tree's leaves that it falls in."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, names = unit_rows(b.column("v"), dims), np.array(b.column("leaf").to_pylist(), object)
            for name in dict.fromkeys(names):
                mine = np.flatnonzero(names == name)
                tree = Tree.from_bytes(b.column("tree")[int(mine[0])].as_py())
                at, leaf = tree.route(x[mine], band)
                for k in range(0, len(at), _BATCH):
                    own = pa.array(mine[at[k : k + _BATCH]])
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}{n}:" for n in leaf[k : k + _BATCH].tolist()], pa.string()), b.column("rep").take(own), b.column("v").take(own)], ["leaf", "rep", "v"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.join(trees, "leaf").select("leaf", "rep", "v", "tree").mapInArrow(run, f"leaf string, rep {types['rep']}, v {types['v']}")


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    good = materialize(usable(vectors), "rp-unit")
    reps = materialize(good.groupBy("k", "dims", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "rp-reps")
    found = None
    # one forest for each length of vector; lengths are a property of the schema, not of the data's size
    for dims in [r[0] for r in reps.select("dims").distinct().orderBy("dims").collect()]:
        own = links(reps.where(F.col("dims") == dims), dims, threshold)
        found = own if found is None else found.unionAll(own)
    all_ids = vectors.select("vec_id")
    zero = F.lit(0).cast("bigint")
    if found is None:
        return all_ids.select("vec_id", zero.alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    comp = components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    other = found.where("others is not null").groupBy("rep").agg(F.sum("others").alias("others"))
    classes = reps.join(other, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = materialize(classes.select("k", "dims", "v", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "rp-classes")
    linked = good.join(classes, ["k", "dims", "v"]).select("vec_id", "n_links", "component_id")
    none = _unusable(vectors).select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionAll(none)
    return out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), F.col("component_id").cast("bigint").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unusable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0) & (F.size("v") > 0)
    return vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNull() | ~F.coalesce(fine, F.lit(False)))


ORACLE = r"""
with recursive g as (
  select vec_id, embedding::double[] v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
u as (select vec_id, v, sqrt(list_dot_product(v, v)) n from g),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
c as (select distinct vec_id, vec_id reach from embeddings union select c.vec_id, l.b from c join l on l.a = c.reach),
m as (select vec_id, min(reach) component_id from c group by vec_id),
k as (select a vec_id, count(*) n_links from l group by a)
select m.vec_id, coalesce(k.n_links, 0)::bigint n_links, m.component_id, m.vec_id = m.component_id as kept from m left join k using (vec_id)
"""
