"""Corpus retrieval: chunks, BM25, hashed vectors, dense top-k, fusion, verification."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as T

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, key: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """key, term, tf, len; only: the terms that are wanted (column term), which are joined before anything is counted."""
    t = docs.select(key, T.tokens(F.coalesce("text", F.lit(""))).alias("w")).select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    t = t if only is None else t.join(only, "term", "left_semi")
    return t.groupBy(key, "term", "len").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each query text, among those that score above 0.

    Only the queries' terms leave the corpus: tokens are filtered by a semi join on the distinct query terms before they
    are counted; Spark broadcasts those where the table is small.
    """
    q = queries.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    stats = docs.select(F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    postings = term_counts(docs, only=q.select("term").distinct())
    weighted = postings.join(document_frequencies(postings), "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scores = q.join(weighted.select("term", "doc_id", w.alias("w")), "term").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")
    return top(scores, "item_id", "doc_id", "score", k)


def top(scores: DataFrame, group: str, key: str, score: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashed_vectors(docs: DataFrame, dims: int = 384, key: str = "doc_id") -> DataFrame:
    """key, bucket, v: signed counts of character trigrams, hashed, normalised; sparse, one row for each bucket that isn't 0."""
    padded = F.concat(F.lit("  "), F.lower(T.flat(F.coalesce("text", F.lit("")))), F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring(F.col("p"), i, F.lit(3)))
    g = docs.select(key, padded.alias("p")).select(key, F.explode(grams).alias("g"))
    counts = g.groupBy(key, "g").agg(F.count("*").alias("c"))
    v = counts.groupBy(key, T.bucket_of(F.col("g"), dims).cast("int").alias("bucket")).agg(F.sum(F.col("c") * T.sign_of(F.col("g"))).alias("v")).where("v <> 0")
    return v.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine. The filter comes before the ranking, so nothing is over-fetched.

    queries (query_id, q) is a stated set and much smaller than the table; Spark broadcasts it where its size allows.
    """
    v = vectors if where is None else vectors.where(where)
    pairs = v.join(queries, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return top(pairs, "query_id", "vec_id", "score", k)


def fuse(lists: list[DataFrame], group: str, key: str, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (group, rank, key)."""
    both = None
    for x in lists:
        part = x.select(group, key, (1 / (F.lit(c) + F.col("rank"))).alias("s"))
        both = part if both is None else both.unionAll(part)
    return both.groupBy(group, key).agg(F.round(F.sum("s"), 9).alias("score"))


def rerank(found: DataFrame, section_hit: Column, source_hit: Column, group: str, key: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(section_hit.cast("int")), F.desc(source_hit.cast("int")), F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w))


def vote(found: DataFrame, group: str, label: str) -> DataFrame:
    """The label with the largest sum of scores in each group; ties by label."""
    s = found.groupBy(group, label).agg(F.round(F.sum("score"), 9).alias("s"))
    w = Window.partitionBy(group).orderBy(F.desc("s"), label)
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").select(group, label, "s")


def quotes_found(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quote_id, found: whether the quote is in the chunk that it names, white space flattened."""
    x = quotes.join(chunks.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "left")
    return x.select("quote_id", F.coalesce(F.contains(T.flat(F.col("text")), T.flat(F.col("quote"))), F.lit(False)).alias("found"))


def row_group_chunks(rows: DataFrame, line: Column, order: str, size: int = 20, header: str = "") -> DataFrame:
    """chunk, text: header and up to `size` lines. The order column is a dense row number from 1."""
    x = rows.select(F.floor((F.col(order) - 1) / size).cast("bigint").alias("chunk"), F.col(order).alias("o"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda r: r["line"]), "\n")
    return x.groupBy("chunk").agg(F.concat(F.lit(header + "\n"), body).alias("text"))


def pack(text: str, limit: int = 1000, overlap: int = 150, tail: int = 200) -> list[str]:
    """Paragraphs packed greedily into chunks of at most limit characters, each starting with the end of the one before.

    Paragraphs over the limit are cut at the last space of their second half; a last chunk under `tail` joins the one
    before if that keeps under the limit.
    """
    parts: list[str] = []
    for p in (x.strip() for x in text.split("\n\n")):
        while len(p) > limit:
            cut = p.rfind(" ", limit // 2, limit)
            cut = cut if cut > 0 else limit
            parts.append(p[:cut].strip())
            p = p[cut:].strip()
        if p:
            parts.append(p)
    chunks: list[str] = []
    held = ""
    for p in parts:
        if held and len(held) + 2 + len(p) > limit:
            chunks.append(held)
            back = held[-overlap:]
            back = back[back.find(" ") + 1 :] if " " in back else ""
            held = f"{back} {p}" if back and len(back) + 1 + len(p) <= limit else p
        else:
            held = f"{held}\n\n{p}" if held else p
    if held:
        if chunks and len(held) < tail and len(chunks[-1]) + 2 + len(held) <= limit:
            chunks[-1] += "\n\n" + held
        else:
            chunks.append(held)
    return chunks


def chunk_texts(docs: DataFrame, limit: int = 1000) -> DataFrame:
    """doc_id, seq, chunk. Packing looks at one text at a time, in order, so it runs as a Python function over Arrow batches."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(i, n, c) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for n, c in enumerate(pack(t or "", limit))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "seq", "chunk"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, seq int, chunk string")
