"""Benchmark decontamination: passages of training texts query a BM25 index of test items.

The inverted index holds the test items; weights are BM25 term weights divided by the item's score for itself, so that a
passage with all of an item's words scores 1. Postings are in item order, in blocks of BLOCK items, with the largest
weight of each term in each block (block-max WAND, Ding and Suel 2011). Each text is cut into passages of twice the
longest item's words, half overlapping, so that any copy of an item lies in one. All passages of a text are queries:
a block is skipped where the sum of its maxima over the passage's terms can't reach the threshold; in the others, WAND
moves the term's cursors from pivot to pivot and scores items in full. Terms so common in the benchmark that all of
them together give no item more than LOW_SHARE are left out of the first step; what they could add is added to its bound.

Every item at or above SCORE is verified: of its five-word shingles (all its words, if fewer) the passage must hold
OVERLAP, and HALF_OVERLAP of those of its question and of its answer. An item's question is its text up to and with
the last question mark, its answer the rest; without such a mark the first and the second half of its words.

Number of items, mean length, document frequencies and the longest item are those of the whole benchmark, counted in
Spark; each item comes with its terms' weights. An index is made on the driver from a shard of about SHARD_ITEMS items and
SHARD_WORDS words at most and broadcast; larger benchmarks go in several shards, one after the other, each against all
texts that are left. As weights and passages don't depend on the shards, neither do the results.

Defined cases: items without words and items with a null id match nothing; a null or empty text has no passages; a
repeated item id keeps each of its texts; repeated documents give a row each; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD, ascii_lower, discard, materialize, words_of

K1, B = 1.2, 0.75
BLOCK, LOW_SHARE, SHARD_ITEMS, SHARD_WORDS = 8, 0.25, 20_000, 4_000_000
#: Least share of an item's own score, of its shingles, and of those of each half.
SCORE, OVERLAP, HALF_OVERLAP = 0.6, 0.8, 0.5
SHINGLE = 5


class Index:
    """terms: word to number. Postings of term t: items[at[t]:at[t+1]] with weights; maxima of blocks likewise in blk_*."""

    def __init__(self, items: list[tuple[int, str, dict[str, float]]], step: int):
        """items: id, text and weight of each term; step: words of the longest item of the benchmark."""
        split = [(i, words_of(t), t, w) for i, t, w in items]
        self.ids = [i for i, _, _, _ in split]
        self.words = [w for _, w, _, _ in split]
        self.cuts = [self._question(w, t) for _, w, t, _ in split]
        n, self.step = len(split), step
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for i, (_, _, _, weights) in enumerate(split):
            for w, x in weights.items():
                postings.setdefault(w.encode("utf-8", "surrogatepass"), []).append((i, x))
        low_sum = np.zeros(n)
        low: set[bytes] = set()
        for w in sorted(postings, key=lambda w: (-len(postings[w]), w)):
            if len(postings[w]) * 20 < n:
                break
            i, x = (np.array(c) for c in zip(*postings[w], strict=True))
            if (low_sum[i] + x).max() <= LOW_SHARE:
                low_sum[i] += x
                low.add(w)
        self.postings = postings
        self.blocks = -(-n // BLOCK)
        self.low_cap = np.array([low_sum[k * BLOCK : (k + 1) * BLOCK].max() for k in range(self.blocks)])
        self.terms = {w: t for t, w in enumerate(sorted(w for w in postings if w not in low))}
        at, blk, top = [0], [], []
        for w in self.terms:
            best: dict[int, float] = {}
            for i, x in postings[w]:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), x)
            blk += best.keys()
            top += best.values()
            at.append(len(blk))
        self.at, self.blk, self.top = np.array(at), np.array(blk, np.int64), np.array(top)

    @staticmethod
    def _question(words: list[bytes], text: str) -> int:
        end = text.rfind("?")
        k = len(words_of(text[: end + 1])) if end >= 0 else 0
        return k if 0 < k < len(words) else (len(words) + 1) // 2

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(passage, block) whose bound reaches SCORE; passage p is the words from p * step, twice step of them."""
        get = self.terms.get
        found = [(p, t) for p, w in enumerate(words) if (t := get(w)) is not None]
        if not found:
            return []
        pos, term = np.array(found).T
        p = pos // self.step
        key = np.unique(np.concatenate([p, p[p > 0] - 1]) * len(self.terms) + np.concatenate([term, term[p > 0]]))
        passage, term = np.divmod(key, len(self.terms))
        n = self.at[term + 1] - self.at[term]
        where = np.repeat(self.at[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        slot, inverse = np.unique(np.repeat(passage, n) * self.blocks + self.blk[where], return_inverse=True)
        bound = np.bincount(inverse, self.top[where]) + self.low_cap[slot % self.blocks]
        return [tuple(divmod(int(s), self.blocks)) for s in slot[bound >= SCORE - 1e-9]]

    def wand(self, terms: set[bytes], block: int, least: float = SCORE) -> list[tuple[int, float]]:
        """Items of the block that score at least so much, found by moving the cursors of the terms' postings from pivot to pivot."""
        lo, hi = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for w in terms:
            if own := [x for x in self.postings.get(w, ()) if lo <= x[0] < hi]:
                cursors.append([0, own, max(x for _, x in own)])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]][0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= least - 1e-9:
                    pivot = c[1][c[0]][0]
                    break
            if pivot is None:
                break
            if cursors[0][1][cursors[0][0]][0] == pivot:
                score = sum(c[1][c[0]][1] for c in cursors if c[1][c[0]][0] == pivot)
                if score >= least - 1e-9:
                    out.append((pivot, score))
                move_to = pivot + 1
            else:
                move_to = pivot
            for c in cursors:
                while c[0] < len(c[1]) and c[1][c[0]][0] < move_to:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return out

    def overlap(self, item: int, passage: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's distinct shingles, and of its question's and answer's, that the passage holds."""
        words, cut = self.words[item], self.cuts[item]
        size = min(SHINGLE, len(words))
        have = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
        grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        share = lambda s: len(s & have) / len(s) if s else 1.0
        return share(set(grams)), share(set(grams[: max(cut - size + 1, 1)])), share(set(grams[min(cut, len(grams) - 1) :]))

    def leaks(self, text: str | None) -> list[tuple[int, float, float]]:
        """(item id, score, overlap) of the items that the text holds."""
        words, best = words_of(text), {}
        for passage, block in self.candidates(words):
            part = words[passage * self.step : (passage + 2) * self.step]
            for item, score in self.wand(set(part), block):
                whole, question, answer = self.overlap(item, part)
                if whole >= OVERLAP and question >= HALF_OVERLAP and answer >= HALF_OVERLAP:
                    best[item] = max(best.get(item, (0.0, 0.0)), (whole, score))
        return [(self.ids[i], score, whole) for i, (whole, score) in sorted(best.items())]


def weighted_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, n (words), step (words of the longest item), weights (term to share of the item's score for itself) of each different item; a written table.

    idf and mean length are those of the whole benchmark; only words and counts are shuffled, and numbers of one row broadcast."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), F.lit(1))
    items = items.withColumn("w", words).withColumn("n", F.size("w")).where("n > 0").withColumn("row", F.xxhash64("item_id", "text"))
    items = materialize(items.select("row", "item_id", "text", "n", "w"), "bm-items")
    whole = items.agg(F.count("*").cast("double").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("step"))
    tf = items.select("row", "n", F.explode("w").alias("term")).groupBy("row", "n", "term").agg(F.count("*").alias("tf"))
    tf = materialize(tf, "bm-terms")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    both = tf.join(df, "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    by_item = both.withColumn("x", raw).groupBy("row", "step").agg(F.array_sort(F.collect_list(F.struct("term", "x"))).alias("terms"))
    own = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["x"])
    weights = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], t["x"] / F.col("own"))))
    scored = by_item.withColumn("own", own).select(F.col("row").alias("r"), "step", weights.alias("weights"))
    out = materialize(items.join(scored, F.col("row") == F.col("r")).select("row", "item_id", "text", "n", "step", "weights"), "bm-weights")
    discard(items, tf)
    return out


def indexes(benchmark: DataFrame):
    """An Index for each shard of about SHARD_ITEMS items and SHARD_WORDS words at most."""
    items = weighted_items(benchmark)
    n, size, step = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.max("step")).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-size // SHARD_WORDS))
    for s in range(shards):
        rows = items.where(F.pmod("row", F.lit(shards)) == s).orderBy("item_id", "text").select("item_id", "text", "weights").toArrow()
        yield s == shards - 1, Index([(r["item_id"], r["text"], dict(r["weights"])) for r in rows.to_pylist()], step or 1)
    discard(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap for each test item that a document holds."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema, out = f"doc_id {doc_type}, item_id bigint, score double, overlap double", None
    for last, index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                ids, found = b.column("doc_id"), [shared.value.leaks(t) for t in b.column("text").to_pylist()]
                at = [k for k, f in enumerate(found) for _ in f]
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64())], ["doc_id", "item_id", "score", "overlap"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        if not last:  # one shard at a time in the workers' memory
            found = materialize(found, "bm-found")
            shared.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def decon_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.round(F.max("overlap"), 6).alias("overlap"))


def decon_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents that hold a test item go; the others stay as they are. Decided row by row, without a join."""
    held = None
    for last, index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:  # one shard at a time in the workers' memory
            docs = materialize(docs, "bm-left")
            shared.destroy()
            discard(*([held] if held is not None else []))
            held = docs
    return docs


ORACLE = r"""
with dw as (select distinct doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents where text is not null),
ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from dw where len(w) >= 5)),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from benchmark where text is not null),
bs as (select item_id, (len(w) + 1) // 2 cut, i, array_to_string(w[i:i + 4], ' ') s from (select item_id, w, unnest(range(1, len(w) - 3)) i from bw where len(w) >= 5)),
bt as (select item_id, count(distinct s) n, count(distinct case when i <= greatest(cut - 4, 1) then s end) q, count(distinct case when i > cut then s end) a from bs group by item_id),
m as (select ds.doc_id, bs.item_id, count(distinct bs.s) n, count(distinct case when bs.i <= greatest(bs.cut - 4, 1) then bs.s end) q, count(distinct case when bs.i > bs.cut then bs.s end) a from bs join ds using (s) group by 1, 2)
select m.doc_id, m.item_id, round(m.n / bt.n, 6) as overlap from m join bt using (item_id)
where m.n >= 0.8 * bt.n and m.q >= 0.5 * bt.q and m.a >= 0.5 * bt.a
"""
