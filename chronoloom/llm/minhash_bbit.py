"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets collapse first. Each remaining set gets PERMS minima; BANDS bands of ROWS minima give
candidates, and the low BITS bits of each minimum, packed into words, an estimate of the similarity that is corrected
for chance collisions (Li and Koenig 2010): J = (matches / PERMS - 2^-b) / (1 - 2^-b). Candidates whose estimate is more
than MARGIN (five standard deviations) under the threshold go; the rest are confirmed on full shingle sets.

A bucket never gives all its pairs. First each member is compared with the bucket's least id: linear in the bucket.
Then only buckets whose members still belong to different components are compared further, across components only, in
blocks of BLOCK members, by their packed signatures and by longer ones of FINE_PERMS minima that are made for their
members alone; a pair is given once, in the first bucket that it shares, and only where both estimates pass. So no
bucket has a cap, and a large group of copies of one text costs one comparison a member and band.

With 24 bands of 4, a pair at the threshold 0.85 escapes all bands with probability (1 - 0.85^4)^24 = 2e-8.

Defined cases: a null or empty text or one of white space alone has no shingles and links with nothing; with fewer than
five words the whole sequence is the one shingle; repeated rows and rows that share a doc_id are one document of the
graph but stay separate rows; a null doc_id is never linked, and is its own component (null); other columns aren't read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize, mix64, with_ids, without_ids
from chronoloom.llm.components import components
from chronoloom.llm.shingles import of_text

BANDS, ROWS, BITS = 24, 4, 4
PERMS = BANDS * ROWS
MARGIN, BLOCK = 0.2, 512
#: The longer signatures: so many minima, so many bits of each, and five of their standard deviations.
FINE_PERMS, FINE_BITS, FINE_MARGIN = 1024, 2, 0.066

_rng = np.random.default_rng(1)
_MUL = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_FINE_MUL = _rng.integers(1, 1 << 63, FINE_PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_ADD = _rng.integers(0, 1 << 63, FINE_PERMS, dtype=np.uint64)


def minima(shingles: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """The minima of a non-empty set, 32 bits each; large sets in pieces."""
    best = None
    for k in range(0, len(shingles), 1024):
        part = (shingles[k : k + 1024, None] * mul + add).min(0)
        best = part if best is None else np.minimum(best, part)
    return best >> np.uint64(32)


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix64(key ^ (rows[:, k] * np.uint64(0xFF51AFD7ED558CCD)))
    return key.view(np.int64)


def packed(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    low = (mins & np.uint64((1 << bits) - 1)).reshape(-1, 64 // bits)
    return (low << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits))).sum(1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit key of the set), bands, sig."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            n, k1, k2, bands, sigs = [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = of_text(t)
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                k2.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                m = minima(s) if len(s) else None
                bands.append(None if m is None else band_keys(m))
                sigs.append(None if m is None else packed(m))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, longs), pa.array(sigs, longs)], ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sig array<bigint>")


def mismatches(a: Column, b: Column, perms: int, bits: int) -> Column:
    """How many of the packed values differ, by bit counts: a field counts once, whichever of its bits differ."""
    ones = sum(1 << k for k in range(0, 64, bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    total = F.lit(0)
    for k in range(perms * bits // 64):
        x, shift = a[k].bitwiseXOR(b[k]), 1
        while shift < bits:
            x, shift = x.bitwiseOR(F.shiftrightunsigned(x, shift)), 2 * shift
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def estimate(matched: int | Column, perms: int = PERMS, bits: int = BITS):
    """Similarity from the number of equal values, less those that are equal by chance."""
    return (matched / perms - 2.0**-bits) / (1 - 2.0**-bits)


@functools.cache
def most_mismatches(least_estimate: float, perms: int, bits: int) -> int:
    return max(d for d in range(perms + 1) if estimate(perms - d, perms, bits) >= least_estimate)


def _plausible(threshold: float) -> Column:
    """On columns n_a, n_b, sig_a, sig_b."""
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold - 1e-9)
    return sizes & (mismatches(F.col("sig_a"), F.col("sig_b"), PERMS, BITS) <= most_mismatches(threshold - MARGIN, PERMS, BITS))


def compare_blocks(rows: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of one bucket's two blocks (or one) whose components differ and whose estimates pass, if this is their first shared bucket."""
    side = rows["side"]
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    found_x, found_y = [], []
    for i in x:
        n, comp = rows["n"], rows["component"]
        ok = y[(comp[y] != comp[i]) & (np.minimum(n[y], n[i]) >= np.maximum(n[y], n[i]) * (threshold - 1e-9))]
        if y is x:
            ok = ok[ok > i]
        ok = ok[_differ(rows["sig"][ok] ^ rows["sig"][i], BITS) <= most_mismatches(threshold - MARGIN, PERMS, BITS)]
        ok = ok[rows["bands"][ok, (rows["bands"][ok] == rows["bands"][i]).argmax(1)] == rows["key"]]
        ok = ok[_differ(rows["fine"][ok] ^ rows["fine"][i], FINE_BITS) <= most_mismatches(threshold - FINE_MARGIN, FINE_PERMS, FINE_BITS)]
        found_x.append(np.full(len(ok), i))
        found_y.append(ok)
    a, b = rows["doc_id"][np.concatenate([*found_x, x[:0]])], rows["doc_id"][np.concatenate([*found_y, x[:0]])]
    return np.minimum(a, b), np.maximum(a, b)


def _differ(x: np.ndarray, bits: int) -> np.ndarray:
    shift = 1
    while shift < bits:
        x, shift = x | (x >> np.uint64(shift)), 2 * shift
    return np.bitwise_count(x & np.uint64(sum(1 << k for k in range(0, 64, bits)))).sum(-1)


def fine_signatures(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """c, fine: the longer signatures of the documents in ids (column c); a written table."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fine = [packed(minima(s, _FINE_MUL, _FINE_ADD), FINE_BITS) if len(s := of_text(t)) else None for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fine, pa.list_(pa.int64()))], ["c", "fine"])

    texts = with_ids(docs.select("doc_id", "text"), "doc_id", ids)
    return materialize(texts.mapInArrow(run, f"c {doc_type}, fine array<bigint>").where("fine is not null"), "mh-fine")


def _side(sketch: DataFrame, s: str) -> DataFrame:
    return sketch.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; a written table."""
    ids = materialize(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct(), "mh-ids")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            sets = [of_text(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["c", "s"])

    texts = with_ids(docs.select("doc_id", "text"), "doc_id", ids)
    sets = materialize(texts.mapInArrow(run, f"c {doc_type}, s array<bigint>").where("size(s) > 0"), "mh-sets")
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    out = materialize(both.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b").distinct(), "mh-links")
    discard(ids, sets)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    threshold = percent / 100
    sketch = materialize(sketches(docs), "mh-sketch")
    have = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(have.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "mh-reps")
    member = materialize(have.join(reps, ["k1", "k2"]).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"), F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "mh-member")
    own = member.where("sig is not null").select("doc_id", "n_shingles", "sig", "bands")
    # rows that share a doc_id but not a set are one document: its sets' representatives are linked
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same = materialize(member.join(several.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "mh-same")
    buckets = own.select(F.explode("bands").alias("key"), "doc_id")
    hubs = materialize(buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top").select("key", "hub"), "mh-hubs")
    in_shared = materialize(buckets.join(hubs, "key").select("key", "doc_id", "hub"), "mh-buckets")
    star = in_shared.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = materialize(star.join(_side(own, "a"), "a").join(_side(own, "b"), "b").where(_plausible(threshold)).select("a", "b").distinct(), "mh-star")
    links = confirmed(star, docs, percent)
    found = components(links)
    labels = found.select(F.col("node").alias("doc_id"), "component")
    labelled = materialize(in_shared.join(labels, "doc_id", "left").select("key", "doc_id", "hub", F.coalesce("component", "doc_id").alias("component")), "mh-open")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_keys = materialize(open_keys, "mh-open-keys")
    rest = materialize(labelled.join(open_keys, "key"), "mh-rest")
    members = materialize(rest.select(F.col("doc_id").alias("c")).distinct(), "mh-members")
    fine = fine_signatures(docs, members)
    wide = rest.join(own, "doc_id").join(fine, F.col("doc_id") == F.col("c")).withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), (F.col("blk") > F.col("other")).cast("int").alias("side"), "doc_id", "component", F.col("n_shingles").alias("n"), "sig", "fine", "bands")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def compare(key, tbl):
        rows = {c: tbl.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("side", "doc_id", "component", "n")}
        for c in ("sig", "fine", "bands"):
            rows[c] = tbl.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(tbl.num_rows, -1)
        rows["key"] = np.int64(key[0].as_py()).view(np.uint64)
        a, b = compare_blocks(rows, threshold)
        return pa.table({"a": a, "b": b})

    cross = wide.groupBy("key", "i", "j").applyInArrow(compare, f"a {doc_type}, b {doc_type}")
    cross = materialize(cross.distinct(), "mh-cross")
    more = confirmed(cross, docs, percent)
    if more.limit(1).count() or same.limit(1).count():
        found = components(links.union(more).union(same))
    comp = found.select(F.col("node").alias("rep"), "component")
    out = member.select("doc_id", "n_shingles", "rep").join(comp, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    none = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionAll(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    discard(reps, hubs, in_shared, star, links, labelled, open_keys, rest, members, fine, cross, more)
    return out


def near_dedup_stage(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (similarity 0.8 or more) the row with the least doc_id stays, unchanged.

    Documents without shingles and rows with a null doc_id all stay; of rows that share the doc_id that stays, equal
    texts stay once.
    """
    found = near_duplicates(docs, percent)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("c")).distinct(), "mh-gone")
    out = without_ids(docs, "doc_id", gone)
    several = materialize(found.where("kept and n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("c")).count().where("count > 1").select("c"), "mh-several")
    if several.limit(1).count():
        again = out.join(several, out["doc_id"] == several["c"], "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(several, out["doc_id"] == several["c"], "left_anti").unionByName(again)
    return out


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, s from (
    select doc_id, array_to_string(w[i:i + 4], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0))),
n as (select doc_id, count(*) n from s group by doc_id),
-- a pair with similarity 0.85 shares a shingle among the rarest of either set, so that frequent ones needn't be joined
f as (select s, count(*) df from s group by s),
r as (select s.doc_id, s.s, row_number() over (partition by s.doc_id order by f.df, s.s) k, n.n from s join f using (s) join n using (doc_id)),
p as (select distinct a.doc_id a, b.doc_id b from r a join r b using (s) where a.doc_id < b.doc_id and a.k <= a.n - ceil(0.85 * a.n) + 1 and b.k <= b.n - ceil(0.85 * b.n) + 1 and least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)),
i as (select p.a, p.b, count(*) i from p join s x on x.doc_id = p.a join s y on y.doc_id = p.b and y.s = x.s group by 1, 2),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
e as (select a, b from l union all select b, a from l),
c as (select distinct doc_id, doc_id reach from documents union select c.doc_id, e.b from c join e on e.a = c.reach),
m as (select doc_id, min(reach) component_id from c group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d join m using (doc_id) left join n using (doc_id)
"""
