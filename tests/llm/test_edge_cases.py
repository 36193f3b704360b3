"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import math

import pytest

import corpus_pipeline
from chronoloom.llm import bm25_decon, ctx_mix_lm, curriculum_mix, html_wrapper, langid_ecoc, line_align, minhash_bbit, quality_pu, rp_forest, warc_segments

LONG = "word " * 60_000
#: Extra columns take names that operators use inside.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, c bigint, k string, gone array<int>, a bigint, b bigint, th bigint, size bigint, leaks int, quality_score double, __v binary, label int"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, 1, "k", [1], 1, 2, 3, 4, 5, 0.1, b"x", 1)


ROWS = [
    doc(1, "the quick brown fox jumps over the lazy dog near the river bank today"),
    doc(2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    doc(2, "the quick brown fox jumps over the lazy dog near the river bank today"),
    doc(3, None),
    doc(4, ""),
    doc(5, " \n\t ", None, None),
    doc(None, "a text without an id that is also here for all to read and see", "fr"),
    doc(6, "short"),
    doc(7, LONG, "de"),
    doc(8, "12345 !!! ???", "en", None),
    doc(9, "première ligne ñandú über\nthe quick brown fox jumps over the lazy dog near the river bank today\n\nlast", "fr"),
    doc(10, "nul\x00byte and   separators é 漢字 in a text", None),
    doc(11, "entirely different words make this one stand apart from every other row here"),
]
LABEL_ROWS = [(1, 1, 0, "x"), (2, None, 0, None), (2, 1, None, None), (7, 0, 0, None), (None, 1, 1, "y"), (11, 1, 0, None), (11, 1, 0, None), (99, 1, 0, "not there")]
ITEMS = [(1, "which animal jumps over the lazy dog? the quick brown fox"), (2, None), (None, "no id"), (3, ""), (4, "short"), (4, "short")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABEL_ROWS, LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_quality(spark, docs, labels):
    for rows, lab in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        out = quality_pu.quality_digest(rows, lab).collect()
        assert len(out) == rows.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in out)
    kept = quality_pu.quality_stage(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert kept.count() <= len(ROWS)
    assert quality_pu.quality_stage(docs, labels.limit(0)).count() == len(ROWS)  # 0.5 for all


def test_language(spark, docs):
    out = langid_ecoc.language_digest(docs).collect()
    assert len(out) == len(ROWS)
    found = {r.doc_id: r.lang_pred for r in out}
    assert found[3] == found[4] == found[5] == found[8] == "und"
    assert langid_ecoc.language_digest(docs.limit(0)).count() == 0
    one = langid_ecoc.language_digest(docs.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in one} <= {"en", "und"}


def test_pages(spark):
    cols = "page_id bigint, url string, html string, host string, template string, sha string, first bigint, text string"
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>One&nbsp;two  three<p>Four</article></body></html>"
    rows = [(1, "http://x.example/1", page), (2, None, page), (None, "http://x.example/2", page), (3, "http://x.example/3", None), (4, "", ""), (5, "no url at all", "<p>" * 5000 + "deep"), (6, "http://y.example", "plain text < 5 & more"), (1, "http://x.example/1", page), (7, "http://z.example/", "<article><p>" + LONG)]
    pages = spark.createDataFrame([(*r, "h", "t", "s", 1, "x") for r in rows], cols)
    text = {r.page_id: r for r in html_wrapper.html_digest(pages).collect()}
    assert text[1].text == text[2].text == text[None].text == "Title & more One two three Four"
    assert text[3].text == text[4].text == "" and text[3].n_chars == 0
    assert text[5].text == "deep" and text[6].text == "plain text < 5 & more"
    assert text[7].n_chars == len(LONG.strip())
    assert html_wrapper.html_digest(pages.limit(0)).count() == 0
    out = warc_segments.warc_digest(pages).collect()
    assert len(out) == len(rows) and all(r.error is None for r in out)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in out)
    assert kinds == [(-1, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert warc_segments.warc_digest(pages.limit(0)).count() == 0


def test_lines(spark, docs):
    out = line_align.dedup_lines(docs, "cut")
    assert out.count() == len(ROWS)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [ROWS[0][1]] and by[2] == ["", ""]  # rows that share an id aren't compared with each other
    assert by[9] == ["première ligne ñandú über\n\nlast"] and by[3] == [None] and by[7] == [LONG]
    stage = line_align.line_dedup_stage(docs)
    assert stage.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in stage.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert stage.where("doc_id = 9").first().n_chars == len(by[9][0])
    assert line_align.line_digest(docs.limit(0)).count() == 0 and line_align.line_dedup_stage(docs.limit(0)).count() == 0


def test_near_duplicates(spark, docs):
    out = {}
    for r in minhash_bbit.near_duplicates(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert len(out[2]) == 2 and all(r.component_id == 1 and not r.kept for r in out[2])
    assert out[3][0].n_shingles == out[4][0].n_shingles == out[5][0].n_shingles == 0 and out[5][0].component_id == 5
    assert out[6][0].n_shingles == 1 and out[7][0].n_shingles == 1 and out[None][0].component_id is None and out[None][0].kept
    stage = minhash_bbit.near_dedup_stage(docs)
    assert stage.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in stage.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert minhash_bbit.near_dedup_stage(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 2")
    assert minhash_bbit.near_dedup_stage(twice).count() == 1


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [0.0, 1.0], 0), (12, [1.0, 0.1], 0), (3, [1.0, 0.0], 0)]
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
        out = {}
        for r in rp_forest.near_vectors(frame).collect():
            out.setdefault(r.vec_id, []).append(r)
        assert out[1][0].n_links == out[2][0].n_links == out[12][0].n_links == 4 and out[12][0].component_id == 1
        assert len(out[3]) == 2 and all(out[i][0].n_links == 0 and out[i][0].component_id == i for i in (4, 5, 6, 7, 8, 9, 10, 11))
        assert out[None][0].n_links == 0 and out[None][0].kept
        assert rp_forest.near_vectors(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 1e300], 0), (2, [1e-300, 1e-300], 0)], "vec_id bigint, embedding array<double>, label int")
    assert all(r.n_links == 1 for r in rp_forest.near_vectors(huge).collect())


def test_mixing(spark, docs):
    out = curriculum_mix.mix_digest(docs).collect()
    assert len(out) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert all(r.size == 0 for r in out if r.doc_id in (3, 4, 5))
    assert curriculum_mix.mix_digest(docs.limit(0)).count() == 0
    nothing = curriculum_mix.mix_digest(docs.where("doc_id in (3, 4, 5)")).collect()
    assert all(r.taken == 0 and r.position is None for r in nothing)


def test_decontamination(spark, docs, items):
    held = spark.createDataFrame([doc(20, "Well, which animal jumps over the lazy dog? the quick brown fox, it is said"), *ROWS], DOCS)
    out = [(r.doc_id, r.item_id) for r in bm25_decon.find_leaks(held, items).collect()]
    assert (6, 4) in out and not any(i in (2, 3, None) for _, i in out)
    stage = bm25_decon.decon_stage(docs, items)
    assert stage.schema == docs.schema and sorted(r.doc_id or -1 for r in stage.collect()) == [-1, 1, 2, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert bm25_decon.decon_stage(docs, items.limit(0)).count() == len(ROWS) and bm25_decon.find_leaks(docs.limit(0), items).count() == 0


def test_language_model(spark, docs):
    out = ctx_mix_lm.score(docs).collect()
    assert len(out) == len(ROWS) and all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1
    assert len({round(r.score, 9) for r in out if r.doc_id == 2}) == 1
    assert ctx_mix_lm.score(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, sf, tmp_path):
    spark.createDataFrame(LABEL_ROWS, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
