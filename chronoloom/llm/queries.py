"""The queries op1 to op10: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from chronoloom.llm import bm25_decon, ctx_mix_lm, curriculum_mix, html_wrapper, langid_ecoc, line_align, minhash_bbit, quality_pu, rp_forest, warc_segments
from chronoloom.llm.common import table
from chronoloom.session import shipping


def op1_quality_pu(spark, sf_dir):
    return quality_pu.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_langid_ecoc(spark, sf_dir):
    return langid_ecoc.language_digest(table(spark, sf_dir, "documents"))


def op3_html_wrapper(spark, sf_dir):
    return html_wrapper.html_digest(table(spark, sf_dir, "pages"))


def op4_warc_segments(spark, sf_dir):
    return warc_segments.warc_digest(table(spark, sf_dir, "pages"))


def op5_line_align(spark, sf_dir):
    return line_align.line_digest(table(spark, sf_dir, "documents"))


def op6_minhash_bbit(spark, sf_dir):
    return minhash_bbit.near_duplicates(table(spark, sf_dir, "documents"))


def op7_rp_forest(spark, sf_dir):
    return rp_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_curriculum_mix(spark, sf_dir):
    return curriculum_mix.mix_digest(table(spark, sf_dir, "documents"))


def op9_bm25_decon(spark, sf_dir):
    return bm25_decon.decon_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ctx_mix_lm(spark, sf_dir):
    return ctx_mix_lm.score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: shipping(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return {"op4_warc_segments": warc_segments.ORACLE, "op6_minhash_bbit": minhash_bbit.ORACLE, "op7_rp_forest": rp_forest.ORACLE, "op8_curriculum_mix": curriculum_mix.ORACLE, "op9_bm25_decon": bm25_decon.ORACLE}
