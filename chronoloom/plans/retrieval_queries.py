"""Queries of the retrieval family, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.operators import retrieval as R
from chronoloom.sources.tables import load

QUERIES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = (run, sql)


def docs(spark, d):
    return load(spark, d, "documents")


def items(spark, d):
    return load(spark, d, "benchmark")


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
add("tokenize", lambda spark, d: docs(spark, d).select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("n"), F.md5(F.array_join(T.tokens(F.coalesce("text", F.lit(""))), " ").cast("binary")).alias("h")),
    f"select doc_id, len({_TOK})::int n, md5(array_to_string({_TOK}, ' ')) h from documents")
add("bm25_stats", lambda spark, d: R.document_frequencies(R.term_counts(docs(spark, d))).groupBy("df").agg(F.count("*").alias("terms")),
    f"with t as (select distinct doc_id, unnest({_TOK}) term from documents), f as (select term, count(*) df from t group by 1) select df, count(*) terms from f group by 1")
_BM25 = f"""t as (select doc_id, len({_TOK}) len, unnest({_TOK}) term from documents), c as (select doc_id, term, len, count(*) tf from t group by 1, 2, 3),
st as (select count(*) n, avg(len({_TOK})) avgdl from documents), q as (select distinct item_id, unnest({_TOK}) term from benchmark),
f as (select term, count(*) df from c group by 1), w as (select c.term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl)) w from c join f using (term), st),
s as (select item_id, doc_id, round(sum(w), 6) score from q join w using (term) group by 1, 2)"""


def _bm25(spark, d, k=10):
    return R.bm25_top(docs(spark, d), items(spark, d), k)


add("bm25_topk", lambda spark, d: _bm25(spark, d).select("item_id", "rank", "doc_id"), f"with {_BM25}, r as (select item_id, doc_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from s where score > 0) select item_id, rank, doc_id from r where rank <= 10")
_GRAMS = """p as (select item_id, '  ' || lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) || '  ' p from benchmark),
g as (select item_id, substr(p, i::int, 3) g from (select item_id, p, unnest(range(1, length(p) - 1)) i from p)), c as (select item_id, g, count(*) c from g group by 1, 2),
v as (select item_id, (('0x' || substr(md5(g), 1, 8))::ubigint % 384)::int bucket, sum(c * case when ('0x' || substr(md5(g), 9, 1))::int >= 8 then -1 else 1 end) v from c group by 1, 2)"""
add("hash_embed", lambda spark, d: R.hashed_vectors(items(spark, d), key="item_id").select("item_id", "bucket", F.round("v", 6).alias("v")),
    f"with {_GRAMS} select item_id, bucket, round(v / sqrt(sum(v * v) over (partition by item_id)), 6) v from v where v <> 0")
_QV = "vec_id % 50 = 0"


def _dense(spark, d, where=None):
    v = load(spark, d, "embeddings")
    return R.dense_top(v, v.where(_QV).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5, where)


_COS = """s as (select q.vec_id query_id, e.vec_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]) * list_dot_product(q.embedding::double[], q.embedding::double[])), 6) score
from embeddings e join embeddings q on q.vec_id % 50 = 0 and e.vec_id <> q.vec_id {w}), r as (select query_id, vec_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)"""
add("dense_topk", lambda spark, d: _dense(spark, d).select("query_id", "rank", "vec_id"), f"with {_COS.format(w='')} select query_id, rank, vec_id from r where rank <= 5")
add("dense_topk_filtered", lambda spark, d: _dense(spark, d, F.col("label") == 1).select("query_id", "rank", "vec_id"), f"with {_COS.format(w='where e.label = 1')} select query_id, rank, vec_id from r where rank <= 5")
add("rrf_fusion", lambda spark, d: R.top(R.fuse([_bm25(spark, d, 40), _bm25(spark, d, 40).withColumn("rank", 41 - F.col("rank")).where("doc_id % 2 = 0")], "item_id", "doc_id"), "item_id", "doc_id", "score", 10).select("item_id", "rank", "doc_id"),
    f"""with {_BM25}, r as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0),
u as (select item_id, doc_id, 1 / (60 + rank) x from r where rank <= 40 union all select item_id, doc_id, 1 / (60 + 41 - rank) from r where rank <= 40 and doc_id % 2 = 0),
z as (select item_id, doc_id, round(sum(x), 9) score from u group by 1, 2), y as (select item_id, doc_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from z) select item_id, rank, doc_id from y where rank <= 10""")  # fmt: skip
add("domain_vote", lambda spark, d: R.vote(_bm25(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id"), "item_id", "lang").select("item_id", "lang"),
    f"with {_BM25}, r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0), v as (select item_id, lang, round(sum(score), 9) s from r join documents using (doc_id) where rank <= 10 group by 1, 2), k as (select *, row_number() over (partition by item_id order by s desc, lang) k from v) select item_id, lang from k where k = 1")
add("rerank", lambda spark, d: R.rerank(_bm25(spark, d).join(docs(spark, d).select("doc_id", "lang", "source"), "doc_id"), F.col("lang") == "en", F.col("source") == "src0", "item_id", "doc_id").select("item_id", "rank", "doc_id"),
    f"with {_BM25}, r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) select item_id, (row_number() over (partition by item_id order by (lang = 'en')::int desc, (source = 'src0')::int desc, score desc, doc_id))::int as rank, doc_id from r join documents using (doc_id) where rank <= 10")
_clean = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
add("clean_ws", lambda spark, d: docs(spark, d).select("doc_id", F.md5(T.clean_white_space(F.col("text")).cast("binary")).alias("h")), f"select doc_id, md5({_clean.format(x='text')}) h from documents")
_html = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?i)</?(p|div|li|tr|br|h[1-6]|ul|table|article|footer|nav)[^>]*>', chr(10), 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<', 'g'), '&amp;', '&', 'g')"
add("html_text", lambda spark, d: load(spark, d, "pages").select("page_id", F.md5(T.html_text(F.col("html")).cast("binary")).alias("h")), f"select page_id, md5({_clean.format(x=_html)}) h from pages")
_AM = r"'\$?[0-9]{1,3}(?:,[0-9]{3})+|\$[0-9]+|[0-9]{4,}'"
add("amount_extract", lambda spark, d: docs(spark, d).select("doc_id", F.posexplode(T.amounts(F.col("text"))).alias("k", "amount")), f"select doc_id, (unnest(range(len(a))))::int k, unnest(a) amount from (select doc_id, regexp_extract_all(text, {_AM}) a from documents)")
add("amount_forms", lambda spark, d: load(spark, d, "orders").select("o_orderkey", T.grouped(F.round(F.col("o_totalprice")).cast("bigint")).alias("form"), T.holds_amount(F.concat(F.lit("a sum of $ "), T.grouped(F.col("o_orderkey")), F.lit(" paid")), F.col("o_orderkey")).alias("found")),
    "select o_orderkey, format('{:,}', round(o_totalprice)::bigint) form, true as found from orders")
add("quote_verify", lambda spark, d: R.quotes_found(docs(spark, d).select(F.col("doc_id").alias("quote_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("chunk_id"), F.substring("text", 20, 60).alias("quote")), docs(spark, d)),
    r"with q as (select doc_id quote_id, case when doc_id % 3 = 0 then doc_id + 1 else doc_id end chunk_id, substr(text, 20, 60) quote from documents) select quote_id, coalesce(contains(regexp_replace(text, '\s+', ' ', 'g'), regexp_replace(quote, '\s+', ' ', 'g')), false) as found from q left join documents on doc_id = chunk_id")
add("csv_chunks", lambda spark, d: R.row_group_chunks(load(spark, d, "customer").withColumn("o", F.col("c_custkey") + 1 - F.lit(0)), F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment"), "o", 20, "key,name,segment").select("chunk", F.md5(F.col("text").cast("binary")).alias("h")),
    "select (c_custkey // 20)::bigint chunk, md5('key,name,segment' || chr(10) || string_agg(concat_ws(',', c_custkey, c_name, c_mktsegment), chr(10) order by c_custkey)) h from customer group by 1")
add("url_names", lambda spark, d: load(spark, d, "pages").select("page_id", T.file_name_of(F.col("url")).alias("name")), r"select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9.\-]+', '_', 'g') as name from pages")
add("text_chunks", lambda spark, d: R.chunk_texts(docs(spark, d)))
add("json_props", lambda spark, d: load(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")), "select event_id, (props->>'$.k')::bigint k from events")
add("human_bytes", lambda spark, d: load(spark, d, "documents").select("doc_id", T.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size")),
    "select doc_id, case when n >= 1099511627776 then format('{:,.1f}', n / 1099511627776.0) || ' TiB' when n >= 1073741824 then format('{:,.1f}', n / 1073741824.0) || ' GiB' when n >= 1048576 then format('{:,.1f}', n / 1048576.0) || ' MiB' when n >= 1024 then format('{:,.1f}', n / 1024.0) || ' KiB' else format('{:,.1f}', n / 1.0) || ' B' end as size from (select doc_id, n_chars * n_chars n from documents)")
