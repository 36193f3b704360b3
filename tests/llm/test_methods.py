"""Each operator against brute force, an exact round trip, or held-out accuracy, on small fixtures."""

import base64
import copy
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from chronoloom.llm import bm25_decon, common, components, ctx_mix_lm, curriculum_mix, html_wrapper, langid_ecoc, line_align, minhash_bbit, queries, quality_pu, rp_forest, shingles, warc_segments

SF = "/root/testdata/sf0.01"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# 1 quality --------------------------------------------------------------------------------------------------------


def test_prior_is_the_least_tail_ratio():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
        u = np.where(rng.random(4000) < share, rng.normal(2, 1, 4000), n)
        assert abs(quality_pu.estimate_prior(p, u) - share) < 0.06


def test_nnpu_separates_without_negative_labels():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (900, 5)), rng.normal(-1.5, 1, (900, 5))
    one = lambda x: np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    u = np.vstack([good[300:], bad[:400]])
    w = quality_pu.fit_nnpu(one(good[:300]), one(u), 0.6)
    assert (one(rng.normal(1.5, 1, (500, 5))) @ w > 0).mean() > 0.95
    assert (one(rng.normal(-1.5, 1, (500, 5))) @ w > 0).mean() < 0.05


def test_quality_on_held_out_rows(spark):
    out = quality_pu.quality_digest(common.table(spark, SF, "documents"), common.table(spark, SF, "labels")).toPandas()
    labels = common.table(spark, SF, "labels").toPandas()
    m = out.merge(labels, on="doc_id")
    assert (m.held_out == m.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = m[m.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and held[held.quality == 1].predicted.mean() > 0.97


def test_samples_stay_bounded_where_ids_are_repeated(spark, monkeypatch):
    """Three hundred documents and labels that share one id give one row to each sample."""
    rows = [(7, f"Text number {k} of many, with words.") for k in range(300)] + [(100 + k, f"Another text {k}.") for k in range(40)]
    labels = [(7, 1, 0)] * 300 + [(100 + k, k % 2, 0) for k in range(40)]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    sent = []
    real = quality_pu.fitting.vectors_of
    monkeypatch.setattr(quality_pu.fitting, "vectors_of", lambda *a: (r := real(*a), sent.append(len(r[0])))[0])
    assert quality_pu.quality_digest(docs, marks).count() == 340 and sent[0] <= 82
    monkeypatch.setattr(quality_pu, "UNLABELLED", 5)
    monkeypatch.setattr(quality_pu, "POSITIVES", 3)
    quality_pu.fit(docs, marks)
    assert sent[1] == 8


@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_features_of_long_texts_are_counted_in_pieces(piece, monkeypatch):
    rng = random.Random(73)
    texts = ["", "a", " ", "Ab", "".join(rng.choice("abcÄé漢 .,\n\tXYZ019-") for _ in range(300))]
    for module in (quality_pu, langid_ecoc):
        want = [module.features(t) for t in texts]
        monkeypatch.setattr(module, "_PIECE", piece)
        assert all(np.allclose(module.features(t), w) for t, w in zip(texts, want, strict=True))


# 2 language -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9, 20])
def test_codewords_are_apart(k):
    code = langid_ecoc.codewords(k)
    gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert code.shape[0] == k and min(gaps) >= max(1, code.shape[1] // 4)


def test_decoding_corrects_one_wrong_bit():
    code = langid_ecoc.codewords(4)
    model = langid_ecoc.EcocModel(list("abcd"), code, None, None)
    for i in range(4):
        for b in range(code.shape[1]):
            margins = 3.0 * code[i]
            margins[b] = -margins[b]
            assert model.decode(margins)[0] == i
    assert model.decode(np.zeros(code.shape[1]))[2]  # no evidence: ambiguous


@pytest.mark.parametrize("text,letter", [("½ ²", False), ("Ⅷ ⅷ", False), ("12 _ 3,4", False), ("", False), (None, False), ("٣", False), ("a", True), ("1 漢", True), ("ª", True), ("ʰ", True), ("!! é", True)])
def test_only_letters_have_a_language(text, letter):
    import unicodedata

    assert any(unicodedata.category(c)[0] == "L" for c in text or "") == letter
    found = langid_ecoc.EcocModel(["xx"], langid_ecoc.codewords(1), None, None).predict([text])
    assert found == ([["xx"], [1.0], [False]] if letter else [["und"], [0.0], [False]])


def test_language_on_held_out_rows(spark):
    docs = common.table(spark, SF, "documents")
    m = langid_ecoc.language_digest(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (m[m.held_out].lang == m[m.held_out].lang_pred).mean() > 0.98


# 3 pages ----------------------------------------------------------------------------------------------------------


def test_tree_matching_counts_the_largest_ordered_match():
    t = lambda label, *kids: [label, [], list(kids)]
    a = t("r", t("a", t("x")), t("b"), t("c"))
    assert html_wrapper.match(a, a) == 5
    assert html_wrapper.match(a, t("r", t("b"), t("c"))) == 3
    assert html_wrapper.match(a, t("r", t("c"), t("b"))) == 2  # order counts
    assert html_wrapper.match(a, t("q")) == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a>About</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><article><h2>{title}</h2><p>{one}<p>Tom &amp; Jerry &lt;3 caf&eacute; &#8364;<ul><li>x<li>y</ul><div class="share">Share this</div><div>Follow our channel</div></article>
<aside>Popular</aside><section id="comments"><p>First!</p></section></div><form><input value="q">Search</form><footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_surroundings():
    html = PAGE.format(title="A   title", one="One\n\t two")
    assert html_wrapper.extract(html) == "A title One two Tom & Jerry <3 café € x y Follow our channel"


def test_template_text_is_dropped():
    pages = [PAGE.format(title=f"Title {k}", one=f"body {k} " * (k + 2)) for k in range(5)]
    import json

    template = json.dumps(html_wrapper.induce(pages))
    text = html_wrapper.extract(PAGE.format(title="New", one="fresh"), template)
    assert "Follow our channel" not in text and text.startswith("New fresh Tom & Jerry")
    assert html_wrapper.induce(pages[:1]) is None  # nothing to compare it with


@pytest.mark.parametrize("html,want", [("<p>a<b>b</b>c</p>d", "abc d"), ("a<!-- x --><br>b", "a b"), ("<p>x</p><p class='ad'>no</p>y", "x y"), ("text <unfinished", "text"), ("<script>a", ""), ("a &am", "a &am"), ("<div hidden>n</div>m", "m"), ("<main>m</main>x", "m"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3")])
def test_small_pages(html, want):
    assert html_wrapper.extract(html) == want


def test_divs_without_classes_are_aligned():
    import json

    def page(k, n, body=""):
        paragraphs = [f"<p>text {k} {i}</p>" for i in range(n)]
        paragraphs.insert(k % (n + 1), "<p>Subscribe to our letter</p>")
        return f"<html><body><div>Home Shop Contact</div><div id=a{k}>{body}{''.join(paragraphs)}</div><div>All rights reserved</div></body></html>"

    template = json.dumps(html_wrapper.induce([page(k, k + 1) for k in range(6)]))
    assert html_wrapper.extract(page(9, 3), template) == "text 9 0 text 9 1 text 9 2"


def test_all_articles_and_what_stands_around_them_in_main():
    assert html_wrapper.extract("<div>menu</div><article>first</article><article>the second</article><aside>x</aside>") == "first the second"
    assert html_wrapper.extract("<main><h1>T</h1><p>lead</p><article>body</article></main><div>x</div><article>more</article>") == "T lead body more"


def test_elements_at_any_depth():
    deep = lambda x, n: "<div>" * n + x + "</div>" * n
    page = "<body><div><article>" + deep("one<div class=ad>no</div>two", 160) + "three</article></div>out</body>"
    assert html_wrapper.extract(page) == "one two three"
    assert html_wrapper.extract("<body><article>" + deep("x", 20_000) + "y</article>z</body>") == "x y"


@pytest.mark.parametrize("html,want", [
    ("<div class=wrap><header>Site name</header><p>Hello there.</div>", "Hello there."),
    ("<div><article><header><h1>T</h1></header>body</article></div>", "T body"),
    ("<article>one</article><div>between</div><article>a longer second one</article>", "one a longer second one"),
    ("<main>long text of main<article>Short card</article></main>", "long text of main Short card"),
    ("<article>a<div class=notice-board-history>b</div><div class='cookie-notice x'>c</div><div id=ad-slot-2>d</div><p class=share-buttons>e</p><i class=advert>f</i>g</article>", "a b g"),
    ("<article>a<p class=advertising-law>b</p><p class=menu_item>c</p><p class=commentary>d</p></article>", "a b d"),
])
def test_what_the_contract_names(html, want):
    assert html_wrapper.extract(html) == want


def test_templates_decide_what_is_content(spark):
    """The same pages without and with others of their layout: constants go, slots stay, wherever they stand."""

    def page(k, n):
        return f"<body><div>Shop Home {n}</div><div><h3>Weather news {n}</h3><p>lead {k} of {n}</p></div><article><h1>Title {k}</h1><div>Filed under history</div><p>story {k}</p></article><div>Read our letter</div></body>"

    rows = [(k, "http://one.example/x", page(k, 1)) for k in range(1)] + [(10 + k, f"http://two.example/{k}", page(k, 2)) for k in range(2)] + [(100 + k, f"http://many.example/{k}", page(k, 3)) for k in range(90)]
    rows += [(50 + k, f"http://same.example/{k}", "<body><div>all alike</div></body>") for k in range(3)] + [(60 + k, f"http://odd.example/{k}", f"<body><p>{k} and</p><p>{k + 1}</p></body>") for k in range(2)]
    out = {r.page_id: r.text for r in html_wrapper.html_digest(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert out[0] == "Title 0 Filed under history story 0"  # nothing to compare it with: its article
    assert all(out[10 + k] == f"lead {k} of 2 Title {k} story {k}" for k in range(2)) and all(out[100 + k] == f"lead {k} of 3 Title {k} story {k}" for k in range(90))
    assert all(out[50 + k] == "all alike" for k in range(3)) and [out[60], out[61]] == ["0 and 1", "1 and 2"]


def test_pages_against_a_plain_reading(spark):
    """All pages of the given table: what the standard library's parser finds in their one article, by blocks."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.text = False, []

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag not in html_wrapper.INLINE or tag == "br":
                self.text.append(" " if self.inside else "")

        def handle_endtag(self, tag):
            self.handle_starttag(tag, [])
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            self.text.append(data if self.inside else "")

    table = common.table(spark, SF, "pages")
    out = {r.page_id: r for r in queries.queries()["op3_html_wrapper"](spark, SF).collect()}
    for r in table.collect():
        reader = Article()
        reader.feed(r.html)
        reader.close()
        want = " ".join("".join(reader.text).split())
        assert (out[r.page_id].text, out[r.page_id].n_chars, out[r.page_id].url) == (want, len(want), r.url)


def test_template_is_constant_on_all_pages_of_a_layout(spark):
    def page(k):
        by = "By Staff" if k % 40 else f"By Guest {k}"
        return f"<body><div class=top>Home Shop</div><article><div class=by>{by}</div><p>text {k}</p><div class=more>Read on</div></article></body>"

    rows = [(k, f"http://big.example/{k}", page(k)) for k in range(200)]
    rows += [(1000 + k, f"http://big.example/x{k}", f"<body><table><tr><td>other {k}</table><div class=end>The end</div></body>") for k in range(5)]
    rows += [(2000 + k, f"http://small.example/{k}", f"<body><div class=a>Shop</div><div class=b>text {k}</div></body>") for k in range(4)]
    out = {r.page_id: r.text for r in html_wrapper.html_digest(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert all(out[k] == (f"By Staff text {k}" if k % 40 else f"By Guest {k} text {k}") for k in range(200))
    assert all(out[1000 + k] == f"other {k}" for k in range(5)) and all(out[2000 + k] == f"text {k}" for k in range(4))


# 4 WARC -----------------------------------------------------------------------------------------------------------


def test_segments_and_chunks_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 100, 20_000):
        payload = "".join(rng.choice("aé漢\r\n\x00 ") for _ in range(n)).encode()
        data = b"".join(r + b"\r\n\r\n" for r in warc_segments.page_records(7, "http://x/ü", payload, None, segment=512))
        records = list(warc_segments.parse_archive(data))
        if len(records) == 1:
            row = warc_segments._decoded(*records[0], True)
        else:
            rows = [{"page_id": h.get("x-page-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "number": int(h["warc-segment-number"]), "total": int(h.get("warc-segment-total-length", 0)) or None, "block": b} for h, b in records]
            row = warc_segments.reassemble(rows)
            assert warc_segments.reassemble(rows[:-1])[-1] and warc_segments.reassemble(rows[1:])[-1]  # missing segments are errors
            rows[1]["block"] += b"x"
            assert "total" in warc_segments.reassemble(rows)[-1]
        assert row[4] == len(payload) and row[5] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and row[6].encode() == payload


def test_bad_chunks_are_errors():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc_segments.http_body(head + b"3\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc_segments.http_body(b"HTTP/1.1 200 OK\r\n\r\nraw") == b"raw"
    for bad in (b"4\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc_segments.http_body(head + bad)


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", ("<p>é" * (i % 5) * 4000) or None) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc_segments.write_archives(pages, f"file://{tmp_path}/w", segment=1024)
    back = {int(r.page_id): r for r in warc_segments.read_archives(spark, f"file://{tmp_path}/w").collect()}
    for i, url, html in rows:
        r = back[i]
        assert r.error is None and r.url == url and r.payload_digest == warc_segments.digest_of((html or "").encode())
        assert (r.record_type, r.refers_to) == (("response", None) if i < 5 else ("revisit", str(i % 5)))
        assert i >= 5 or r.html == (html or "")
    warc_segments.write_archives(pages, f"file://{tmp_path}/v", least_bytes=1)
    kinds = {int(r.page_id): r.record_type for r in warc_segments.read_archives(spark, f"file://{tmp_path}/v").collect()}
    assert kinds[5] == kinds[35] == "response" and kinds[6] == "revisit"


def test_segments_of_repeated_rows_stay_apart(spark, tmp_path):
    """Rows with one page_id, or none, and one long payload: each is a record of its own, in a group of its own."""
    html = "<p>é" * 3000
    rows = [(3, "http://h/3", html)] * 20 + [(None, "http://h/n", "<b>x" * 3000)] * 20
    warc_segments.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), f"file://{tmp_path}/w", segment=1024)
    back = warc_segments.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(back) == 40 and all(r.error is None and r.record_type == "response" for r in back)
    assert all(r.html == (html if r.page_id else "<b>x" * 3000) for r in back)


# 5 lines ----------------------------------------------------------------------------------------------------------


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(25))]
        b = a[: rng.randrange(len(a) + 1)] + [rng.randrange(30) for _ in range(rng.randrange(15))]
        rng.random() < 0.3 and rng.shuffle(b)
        pairs = line_align.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)
    a = rng.sample(range(1000), 60)
    b = a[:20] + rng.sample(range(2000, 3000), 10) + a[30:]
    assert len(line_align.patience(a, b)) == longest_common(a, b) == 50


def test_lines_against_brute_force(spark):
    """Every line of enough words is left somewhere, in its first document; later documents lose exactly the lines that an earlier one has (as here order agrees).

    Lines of under five words go only as a part of a longer block, so they aren't compared."""
    rng = random.Random(6)
    pool = [" ".join(words(rng, rng.randrange(6, 20))) for _ in range(40)]
    docs = []
    for i in range(80):
        picked = sorted(rng.sample(range(40), 4))
        own = [" ".join([f"own{i}", *words(rng, 8)]) for _ in range(3)]
        docs.append((i, "\n".join([own[0], *[pool[k] for k in picked[:2]], "", own[1], *[pool[k].upper() for k in picked[2:]], "ok", own[2]])))
    out = {r.doc_id: r.text for r in line_align.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    seen: set = set()
    for i, text in docs:
        want = [x for x in text.split("\n") if len(x.split()) >= 5 and x.lower() not in seen]
        assert [x for x in out[i].split("\n") if len(x.split()) >= 5] == want, i
        seen |= {x.lower() for x in text.split("\n")}


def test_a_shared_passage_in_many_documents(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"start {i} of this text here\n{passage}\nend {i} of this text here") for i in range(300)]
    out = {r.doc_id: r.text for r in line_align.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()}
    assert passage in out[0] and not any(passage in out[i] for i in range(1, 300)) and out[9] == "start 9 of this text here\nend 9 of this text here"


def test_permuted_and_short_lines_against_all_pairs(spark):
    """Every document against every earlier one: no run of five words that an earlier one has is left, and nothing else goes."""
    rng = random.Random(8)
    a, b = "a1 a2 a3 a4 a5", "b1 b2 b3 b4 b5"
    docs = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{b}\n{a}")]
    docs += [(10 + k, f"s{k} t{k}\nfiller {k}") for k in range(4)]  # each owns a line of the block in 25 and 29
    docs += [(i, f"own{i} x\n" + "\n".join(f"s{k} t{k}" for k in range(4)) + f"\nend{i}") for i in (25, 29)]
    pool = [" ".join(words(rng, rng.randrange(1, 8))) for _ in range(60)]
    for i in range(30, 90):
        picked = [x for _ in range(3) for k in [rng.randrange(57)] for x in pool[k : k + 3]]
        rng.random() < 0.4 and rng.shuffle(picked)
        picked.insert(rng.randrange(len(picked)), "")
        docs.append((i, "\n".join([*picked, f"only {i}"])))
    want, earlier = {}, set()
    for i, text in docs:
        lines = [k for k, x in enumerate(text.split("\n")) if x]
        split, gone, mine = text.split("\n"), set(), set()
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                block = tuple(split[k] for k in lines[p:q])
                if sum(len(x.split()) for x in block) >= 5:
                    mine.add(block)
                    gone |= set(lines[p:q]) if block in earlier else set()
        earlier |= mine
        want[i] = "\n".join(x for k, x in enumerate(split) if k not in gone)
    out = {r.doc_id: r.text for r in line_align.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    assert out == want and out[3] == "" and out[29] == "own29 x\nend29"


# 6 MinHash --------------------------------------------------------------------------------------------------------


def test_shingles_are_exact():
    rng = random.Random(7)
    for n in (0, 1, 4, 5, 6, 300):
        w = words(rng, n, 20)
        text = " \t".join(x.upper() if rng.random() < 0.3 else x for x in w) + "\n"
        want = {tuple(w[k : k + 5]) for k in range(max(1, n - 4))} if n else set()
        assert len(shingles.of_text(text)) == len(want)
    assert shingles.of_text("a b c").tolist() == shingles.of_text("A\tb\x0bC ").tolist()
    long = " ".join(words(rng, 400_000, 10**6))
    parts = [shingles.word_hashes(x.encode()) for x in long.split(" ")[:50]]
    assert (shingles.word_hashes(long.encode())[:50] == np.concatenate(parts)).all() and len(shingles.word_hashes(long.encode())) == 400_000


def test_words_of_any_length_and_place():
    rng = random.Random(71)
    step = shingles._STEP
    long = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(1000)) * (step // 1000 * 2 + 2)
    other = long[:70_000] + bytes(reversed(long[70_000:70_008])) + long[70_008:]
    h = lambda raw: shingles.word_hashes(raw).tolist()
    assert len({h(long)[0], h(other)[0], h(long[:-1])[0], h(long + b"a")[0]}) == 4 and h(long.upper()) == h(long)
    for n in (step - 1, step, step + 1, 3 * step):  # lengths and offsets at and across the steps
        word = (long * 2)[:n]
        for at in (0, 1, step - 1, step, step + 1):
            assert h(b"x " + b" " * at + word + b" y") == h(b"x") + h(word) + h(b"y"), (n, at)
    text = b" ".join(w.encode() for w in words(rng, 20_000, 10**6))
    want = h(text)
    for small in (7, 64, 4096):
        shingles._STEP = small
        try:
            assert h(text) == want
        finally:
            shingles._STEP = step


def test_estimate_corrects_chance_matches():
    rng = np.random.default_rng(8)
    for share in (0.0, 0.5, 0.9):
        common_part, n = rng.integers(0, 2**63, 2000, dtype=np.uint64), 2000
        k = int(n * 2 * share / (1 + share)) if share else 0
        a, b = np.concatenate([common_part[:k], rng.integers(0, 2**63, n - k, dtype=np.uint64)]), np.concatenate([common_part[:k], rng.integers(0, 2**63, n - k, dtype=np.uint64)])
        fine = [minhash_bbit.packed(minhash_bbit.minima(x, minhash_bbit._FINE_MUL, minhash_bbit._FINE_ADD), 2).view(np.uint64) for x in (a, b)]
        differ = minhash_bbit._differ(fine[0] ^ fine[1], 2)
        assert abs(minhash_bbit.estimate(1024 - int(differ), 1024, 2) - share) < 0.07


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = words(rng, rng.randrange(30, 200), 5000)
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                base = copy  # chains
            rows.append((rng.randrange(10**6), " ".join(copy)))
    rows = list({i: (i, t) for i, t in rows}.values())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    for percent in (85, 80):
        want = brute_components(sets, percent)
        got = {r.doc_id: r for r in minhash_bbit.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def brute_roots(edges):
    least = {x: x for e in edges for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


@pytest.mark.parametrize("chunk", [components.CHUNK, None])
def test_components_against_brute_force(spark, chunk, monkeypatch):
    """Chains of a thousand links in every order, hubs, loops, repeated links and random graphs, with few rounds."""
    n, rng, rounds = 1000, random.Random(72), []
    orders = [list(range(n)), list(range(n))[::-1], [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)], rng.sample(range(n), n)]
    edges = [(x + 10_000 * k, y + 10_000 * k) for k, ids in enumerate(orders) for x, y in itertools.pairwise(ids)]
    edges += [(50_000, 50_000 + k) for k in range(300)] + [(60_300, 60_000 + k) for k in range(300)] + [(70_000, 70_000), (70_001, 70_002), (70_001, 70_002)]
    edges += [(80_000 + rng.randrange(400), 80_000 + rng.randrange(400)) for _ in range(300)]
    rng.shuffle(edges)
    star = components.star_round
    monkeypatch.setattr(components, "star_round", lambda x: (rounds.append(1), star(x))[1])
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(6), chunk).collect()}
    assert out == {x: c for x, c in brute_roots([e for e in edges if e[0] != e[1]]).items()} and len(rounds) < 25


def test_components_of_no_links(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0
    found = components.components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in found} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_near_duplicates_in_a_chain(spark):
    """Documents each of which is near its neighbours alone, with ids that fall away from the least one."""
    base = [f"v{k}" for k in range(400)]
    rows = []
    for k in range(40):
        base = base[6:] + [f"n{k}x{i}" for i in range(6)]
        rows.append((1000 - k if k else 1, " ".join(base)))
    got = minhash_bbit.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {1}


# 7 vectors --------------------------------------------------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(300, 32))
    x = np.concatenate([centres, centres[:150] + rng.normal(size=(150, 32)) * 0.12, centres[:60] + rng.normal(size=(60, 32)) * 0.05, np.repeat(centres[:1], 40, 0), centres[5:6] * 3])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    out = {r.vec_id: r for r in rp_forest.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= s.sum(1)).all() and got.sum() >= 0.98 * s.sum()


def test_links_of_a_cluster_are_counted_once_and_leave_no_pairs(spark, monkeypatch):
    """A cluster of different vectors, copies of some, in blocks and several trees: exact counts, and rows linear in the vectors."""
    monkeypatch.setattr(rp_forest, "WIDE", 60)
    rng = np.random.default_rng(12)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 200, 0) + rng.normal(size=(200, 16)) * 0.01, rng.normal(size=(50, 16))])
    x = np.concatenate([x, x[:30], x[:5]])
    made, real = [], rp_forest.links
    monkeypatch.setattr(rp_forest, "links", lambda *a: (r := real(*a), made.append(r.count()))[0])
    out = {r.vec_id: r for r in rp_forest.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T >= 0.95
    assert all(out[i].n_links == s[i].sum() - 1 for i in range(len(x)))
    assert all(out[i].component_id == 0 for i in (*range(200), *range(250, 285))) and made[0] < 60 * 250 < 200 * 199 // 2


def test_wide_leaves_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "WIDE", 40)
    monkeypatch.setattr(rp_forest, "LEAF", 10**6)
    monkeypatch.setattr(rp_forest, "TREES", 3)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(120, 16))
    x = np.concatenate([centres, centres[:60] + rng.normal(size=(60, 16)) * 0.05, np.repeat(centres[:1], 70, 0) + rng.normal(size=(70, 16)) * 0.01])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    out = {r.vec_id: r for r in rp_forest.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= s.sum(1)).all() and got.sum() >= 0.9 * s.sum()


# 8 mixing ---------------------------------------------------------------------------------------------------------


def test_targets_and_positions(spark):
    docs = common.table(spark, SF, "documents")
    placed = curriculum_mix.place_documents(docs).toPandas()
    by = placed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (by["size"] == by.own).all() and (abs(by.taken - by.target) <= 1).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3 and (placed.taken <= 2 * placed["size"]).all()
    plan = curriculum_mix.schedule(curriculum_mix.place_documents(docs)).toPandas()
    assert plan.position.is_monotonic_increasing and plan.position.between(0, 1).all() and plan.words.sum() == placed.taken.sum()


def test_due_time_inverts_the_demand(spark):
    from pyspark.sql import functions as F

    rows = [(u / 20, s) for u in range(21) for s in (-0.9, -0.5, 0.0, 0.5, 0.9)]
    out = spark.createDataFrame(rows, "u double, s double").select("u", "s", curriculum_mix.due_time(F.col("u"), F.col("s")).alias("t")).collect()
    assert all(abs(r.t + r.s * (r.t**2 - r.t) - r.u) < 1e-9 for r in out)


def test_sources_that_are_too_small_stop_at_twice_their_size(spark):
    rows = [(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 1000, "c"), (4, "d " * 5, None)]
    out = {r.doc_id: r for r in curriculum_mix.mix_digest(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[1].taken == 20 and out[4].taken == 10 and abs(out[2].taken - 1.0 * (1.5 * 2015 - 30) / 3) <= 1


def test_the_stage_has_a_place_for_each_pass(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = curriculum_mix.mix_stage(docs).collect()
    want = {(r.doc_id, r["pass"], r.words, r.position) for r in curriculum_mix.schedule(curriculum_mix.place_documents(docs)).collect()}
    assert {(r.doc_id, x["pass"], x.words, x.position) for r in rows for x in r.passes} == want and any(len(r.passes) == 2 for r in rows)
    assert all(sum(x.words for x in r.passes) == r.taken and (r.taken > 0 or r.position is None) for r in rows) and len(rows) == docs.count()


# 9 decontamination ------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, rng.randrange(12, 50), 900))) for k in range(60)] + [(60, "only three words"), (61, "Is it so? Yes it is so indeed today")]
    rows = []
    for i in range(200):
        body = words(rng, rng.randrange(20, 400), 900)
        if i % 4 == 0:
            held = items[rng.randrange(len(items))][1].split()
            if i % 8 == 0 and len(held) > 20:
                held[rng.randrange(len(held))] = "changed"
            if i % 12 == 0:
                held = held[: len(held) // 2]
            at = rng.randrange(len(body))
            body = body[:at] + held + body[at:]
        rows.append((i, " ".join(body).upper() if i % 3 == 0 else " ".join(body)))
    want = set()
    for i, t in rows:
        w = t.lower().split()
        for k, text in items:
            q = text.lower().split()
            size = min(5, len(q))
            have = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
            grams = [tuple(q[j : j + size]) for j in range(len(q) - size + 1)]
            if len(set(grams) & have) >= 0.8 * len(set(grams)):
                want.add((i, k))
    out = {(r.doc_id, r.item_id) for r in bm25_decon.decon_digest(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert out == want and len(want) > 20


def test_weights_are_bm25_over_the_whole_benchmark(spark):
    rng = random.Random(74)
    items = [(k, " ".join(words(rng, rng.randrange(1, 30), 50)).upper()) for k in range(80)] + [(5, "w1 w2"), (6, " "), (None, "w3"), (7, None)]
    items += [items[0]] * 3
    got = {(r.item_id, r.text): r.weights for r in bm25_decon.weighted_items(spark.createDataFrame(items, "item_id bigint, text string").repartition(3)).collect()}
    whole = [(i, t, t.lower().split()) for i, t in dict.fromkeys(items) if i is not None and t and t.strip()]
    n, mean = len(whole), sum(len(w) for _, _, w in whole) / len(whole)
    df = Counter(w for _, _, ws in whole for w in set(ws))
    assert got.keys() == {(i, t) for i, t, _ in whole}
    for i, t, ws in whole:
        raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()}
        assert got[i, t].keys() == raw.keys() and all(math.isclose(got[i, t][w], x / sum(raw.values())) for w, x in raw.items())


@pytest.mark.parametrize("limit", ["SHARD_ITEMS", "SHARD_WORDS"])
def test_results_do_not_depend_on_the_shards(spark, monkeypatch, limit):
    rng = random.Random(75)
    items = [(k, " ".join(words(rng, rng.randrange(3, 40), 90))) for k in range(60)] + [(3, "an id that is repeated with another text")]
    rows = [(i, " ".join(words(rng, rng.randrange(40), 90) + items[rng.randrange(len(items))][1].split() + words(rng, 20, 90))) for i in range(120)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    run = lambda: (sorted(map(tuple, bm25_decon.find_leaks(docs, bench).collect())), sorted(r.doc_id for r in bm25_decon.decon_stage(docs, bench).collect()))
    whole = run()
    monkeypatch.setattr(bm25_decon, limit, 15 if limit == "SHARD_ITEMS" else 400)
    assert len(list(bm25_decon.indexes(bench))) > 3 and len(whole[0]) > 100
    (a, b), (c, d) = whole, run()
    assert b == d and [x[:2] for x in a] == [x[:2] for x in c] and np.allclose([x[2:] for x in a], [x[2:] for x in c])


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(13)
    items = [(k, " ".join(words(rng, 12, 60))) for k in range(100)]
    index = bm25_decon.Index([(k, t, {w: rng.random() / 8 for w in set(t.split())}) for k, t in items], 12)
    for _ in range(200):
        terms = {w.encode() for w in words(rng, 15, 60)}
        for least in (0.2, 0.4, 0.6):
            want = {i for i in range(100) if sum(x for w in terms for j, x in index.postings.get(w, ()) if j == i) >= least - 1e-9}
            got = {i for b in range(index.blocks) for i, _ in index.wand(terms, b, least)}
            assert got == want


# 10 language model ------------------------------------------------------------------------------------------------


def test_symbol_probabilities_add_up():
    rng = np.random.default_rng(14)
    counts = rng.integers(0, 100, 40)
    model = ctx_mix_lm.BitModel(counts, ctx_mix_lm.WORD_TABLES)
    symbols = rng.integers(0, 40, 5000)
    context = [ctx_mix_lm._hash(np.roll(symbols, k + 1)) for k in range(6)]
    into = model.new_counts()
    model.count(symbols, context, into)
    model.set_counts(into[:, 0].copy(), into[:, 1].copy())
    model.learn(symbols, context)
    model.finish()
    for at in (0, 17, 4000):
        p = 10 ** model.log10_probabilities(np.arange(40), [np.repeat(c[at], 40) for c in context])
        assert abs(p.sum() - 1) < 1e-3


def test_order_in_the_text_is_learned():
    symbols = np.tile([0, 1, 2, 3, 4, 5, 6, 7], 2000)
    context = [ctx_mix_lm._hash(np.roll(symbols, k + 1)) for k in range(6)]
    model = ctx_mix_lm.BitModel(np.bincount(symbols), ctx_mix_lm.WORD_TABLES)
    into = model.new_counts()
    model.count(symbols, context, into)
    model.set_counts(into[:, 0].copy(), into[:, 1].copy())
    model.learn(symbols, context)
    model.finish()
    assert -model.log10_probabilities(symbols, context).mean() / math.log10(2) < 0.2  # of 3 bits


def test_base_scores_are_exact(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in common.words_of(t))
    c["<end>"] = len(train)
    n, v = sum(c.values()), len(c)
    for r in ctx_mix_lm.score(docs).collect():
        w = [*common.words_of(dict(rows)[r.doc_id]), "<end>"]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(c[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_tables_grow_with_the_counted_bits(spark):
    limit = ctx_mix_lm.TABLE_BITS
    assert ctx_mix_lm.grown(ctx_mix_lm.WORD_TABLES, limit) == ctx_mix_lm.WORD_TABLES
    assert sum(1 << s for s in ctx_mix_lm.grown(ctx_mix_lm.WORD_TABLES, 64 * limit)) > 60 * sum(1 << s for s in ctx_mix_lm.WORD_TABLES)
    model = ctx_mix_lm.BitModel(np.ones(40), ctx_mix_lm.WORD_TABLES)
    rng = np.random.default_rng(15)
    tables = [model.new_counts() for _ in range(2)]
    for table, n in zip(tables, (300, 400_000), strict=True):  # few cells, and all
        np.add.at(table.reshape(-1), rng.integers(0, table.size, n), 1)
        table[-1] = n
    rows = [tuple(r.values()) for t in tables for b in ctx_mix_lm._table_rows(t) for r in b.to_pylist()]
    ctx_mix_lm._gather(spark.createDataFrame(rows, ctx_mix_lm._TABLE), model)
    assert (np.stack([model.n0, model.n1], 1) == tables[0] + tables[1]).all()


def test_identities_of_rarer_words_follow_their_contexts(spark, monkeypatch):
    """Words outside the HEAD, and spelled words, are told from the word before: their texts cost less than shuffled ones."""
    monkeypatch.setattr(ctx_mix_lm, "HEAD", 10)
    rng = random.Random(16)
    pairs = [(f"first{k}", f"second{k * 7 % 400}") for k in range(400)]
    rare = [(f"name{k}", f"zq{rng.randrange(10**6)}") for k in range(60)]  # under LEAST_COUNT
    docs = [(i, " ".join(w for p in (rng.sample(pairs, 20) + [rare[k] for k in (i % 60, (i + 30) % 60) if i < 120]) for w in p)) for i in range(600)]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5 == 1]
    shuffled = {}
    for i in held:
        a = rng.sample(pairs, 20)
        docs.append((i, " ".join(w for p in a for w in p)))
        b = [y for _, y in a]
        rng.shuffle(b)
        k = next(n for n in itertools.count(2000 + 1000 * len(shuffled)) if zlib.crc32(str(n).encode()) % 5 == 1)
        shuffled[i] = k
        docs.append((k, " ".join(w for (x, _), y in zip(a, b, strict=True) for w in (x, y))))
    got = {r.doc_id: r.score for r in ctx_mix_lm.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum(got[i] for i in held) > 0.8 * sum(got[k] for k in shuffled.values())


def test_spelled_words_follow_the_word_before():
    words = [b"alpha", b"bravo"] * 300
    before = np.tile([7, 8], 300)
    letters, first = ctx_mix_lm._letters(words)
    model = ctx_mix_lm.BitModel(np.bincount(letters, minlength=257), ctx_mix_lm.LETTER_TABLES)
    contexts = ctx_mix_lm.letter_contexts(letters, first, before)
    into = model.new_counts()
    model.count(letters, contexts, into)
    model.set_counts(into[:, 0].copy(), into[:, 1].copy())
    model.learn(letters, contexts)
    model.finish()
    right = model.log10_probabilities(letters, contexts).sum()
    assert right > 0.5 * model.log10_probabilities(letters, ctx_mix_lm.letter_contexts(letters, first, before[::-1])).sum()


def test_weights_are_learned_from_long_texts(spark, monkeypatch):
    seen = []
    learn = ctx_mix_lm.BitModel.learn
    monkeypatch.setattr(ctx_mix_lm.BitModel, "learn", lambda self, symbols, *a, **k: (seen.append(len(symbols)), learn(self, symbols, *a, **k))[1])
    docs = spark.createDataFrame([(i, "some words of a long text " * 2000) for i in range(4)], "doc_id bigint, text string")
    ctx_mix_lm.fit(docs, ctx_mix_lm.token_counts(docs))
    assert max(seen) > 12_000


def test_large_tables_are_files(spark):
    """Tables of 30 million slots take no memory of the process, and a model that is sent to tasks doesn't carry them."""
    anon = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024
    model = ctx_mix_lm.BitModel(np.ones(40), ctx_mix_lm.grown(ctx_mix_lm.WORD_TABLES, 16 * ctx_mix_lm.TABLE_BITS))
    symbols = np.tile(np.arange(40), 500)
    context = [ctx_mix_lm._hash(np.roll(symbols, k + 1)) for k in range(6)]
    held = anon()
    into = model.new_counts()
    model.count(symbols, context, into)
    model.set_counts(into[:, 0], into[:, 1])
    assert anon() - held < 100 < into.nbytes / 2**20
    assert into.sum() == 6 * model.length[symbols].sum() and len(pickle.dumps(model)) < 100_000


def test_counts_as_bytes_are_close():
    n = np.unique(np.geomspace(1, 10**9, 5000).astype(np.int64))
    got = ctx_mix_lm._COUNT_OF[ctx_mix_lm._count_codes(n)]
    assert (got[n < 16] == n[n < 16]).all() and (abs(got / n - 1) < 0.07).all() and ctx_mix_lm._count_codes(np.zeros(1))[0] == 0


def test_weights_are_learned_from_all_training_texts(spark, monkeypatch):
    """What the tasks learned from, joined, is every bit of every training text, whatever the sample that learning begins with."""
    monkeypatch.setattr(ctx_mix_lm, "SAMPLE_TEXTS", 1)
    learned = []
    join = ctx_mix_lm.BitModel.join
    monkeypatch.setattr(ctx_mix_lm.BitModel, "join", lambda self, parts: (learned.append((self, parts)), join(self, parts))[1])
    rng = random.Random(17)
    docs = spark.createDataFrame([(i % 150, " ".join(rng.choice(["one", "two", "three", f"x{rng.randrange(10**6)}"]) for _ in range(i % 40))) for i in range(200)] + [(500, None)], "doc_id bigint, text string")
    lm = ctx_mix_lm.fit(docs.repartition(5), ctx_mix_lm.token_counts(docs))
    assert [m for m, _ in learned] == [lm.words, lm.letters] and all(len(parts) > 1 for _, parts in learned)
    for model, parts in learned:
        assert sum(gates.sum() for _, gates, _, _ in parts) == sum(hits.sum() for _, _, hits, _ in parts) == model.coded_bits > 0


def test_bits_of_a_code_share_lines_of_slots():
    """The LEVELS bits from each line's first have different slots of one line, in each context; codes of other symbols have the same."""
    model, wide = ctx_mix_lm.BitModel(np.geomspace(1, 10**6, 300), ctx_mix_lm.WORD_TABLES), 2**ctx_mix_lm.LEVELS
    context = ctx_mix_lm._hash(np.full(300, 5))
    n, depth, node, place, bit = model.expand(np.arange(300))
    of = np.repeat(np.arange(300), n)
    assert n.max() > 2 * ctx_mix_lm.LEVELS
    slot = model.slots(5, context, n, node, place)
    for key in set(zip(of.tolist(), (depth // ctx_mix_lm.LEVELS).tolist(), strict=True)):
        mine = slot[(of == key[0]) & (depth // ctx_mix_lm.LEVELS == key[1])]
        assert len(set(mine // wide)) == 1 and len(set(mine)) == len(mine)
    prefix = {}
    for s, d, x in zip(of.tolist(), depth.tolist(), slot.tolist(), strict=True):
        start = model.start[s]
        assert prefix.setdefault(tuple(model.bits[start : start + d]), x) == x


def test_passes_over_texts_equal_their_array_code(spark, monkeypatch):
    """Counts, what is learned, and scores of the JVM's passes: those of the array code over the same texts. None of the passes runs in Python workers, where they took 2.5 times the CPU budget."""
    monkeypatch.setattr(ctx_mix_lm, "HEAD", 20)
    monkeypatch.setattr(ctx_mix_lm, "_BITS", 1 << 40)
    rng = random.Random(18)
    word = lambda: rng.choice([f"Word{rng.randrange(300)}", "THE", "of", f"\u00e9t\u00e9{rng.randrange(10**5)}", "x" * rng.randrange(1, 90), "\u00c4\u00df\U0001f600"])
    texts = [rng.choice([" ", "\t", "\n\x0b", "\x0c\r ", "\u00a0 "]).join(word() for _ in range(rng.randrange(300))) for _ in range(120)] + ["", None, "  ", "one " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    training = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    made, over = [], ctx_mix_lm.bitcode.over_texts

    def kept(rows, which, arrays, schema):
        made.append((which, arrays, over(rows, which, arrays, schema)))
        return made[-1][2]

    monkeypatch.setattr(ctx_mix_lm.bitcode, "over_texts", kept)
    started, join = [], ctx_mix_lm.BitModel.join
    monkeypatch.setattr(ctx_mix_lm.BitModel, "join", lambda self, parts: (started.append((copy.copy(self), self.table, parts)), join(self, parts))[1])
    tokens = ctx_mix_lm.token_counts(docs)
    lm = ctx_mix_lm.fit(docs, tokens)
    assert [which for which, _, _ in made] == [ctx_mix_lm.bitcode.COUNT, ctx_mix_lm.bitcode.LEARN]
    assert all("Arrow" not in df._jdf.queryExecution().executedPlan().toString() for _, _, df in made)
    held = list(itertools.chain(*ctx_mix_lm._batches_of(training, lm)))
    ids, contexts = ctx_mix_lm.word_contexts([i for _, _, i in held], lm.class_of)
    parts = list(ctx_mix_lm._spelled(held))
    symbols = np.concatenate([x for x, _, _ in parts])
    of_letters = [np.concatenate(c) for c in zip(*(c for _, _, c in parts), strict=True)]
    for (before, table, learned), (x, c) in zip(started, ((ids, contexts), (symbols, of_letters)), strict=True):
        into = before.new_counts()
        before.count(x, c, into)
        codes = 256 * ctx_mix_lm._count_codes(into[:, 0]) + ctx_mix_lm._count_codes(into[:, 1])
        assert (table == codes).all() and into.sum() > 0
        before.table = codes
        want = before.learn(x, c, 0.005, 8192)
        ((weights, *got),) = learned
        assert np.allclose(weights, before.weights, atol=1e-4)
        for a, b in zip(got, want, strict=True):
            assert a.sum() == b.sum() and np.allclose(a, b, atol=1 + 1e-4 * b.sum())
    monkeypatch.setattr(ctx_mix_lm, "fit", lambda *_: lm)
    written, materialize = {}, ctx_mix_lm.materialize
    monkeypatch.setattr(ctx_mix_lm, "materialize", lambda df, what: written.setdefault(what, materialize(df, what)))
    got = {r.doc_id: r for r in ctx_mix_lm.score(docs).collect()}
    assert made[-1][0] == ctx_mix_lm.bitcode.SCORE
    part = {r.doc_id: r for r in written["lm-part"].collect()}
    for k, t in enumerate(texts):
        (((_, own, i),),) = ctx_mix_lm._batches_of([t], lm)
        logp = lm.words.log10_probabilities(*ctx_mix_lm.word_contexts([i], lm.class_of)).sum()
        spell = [lm.letters.log10_probabilities(x, c).sum() for x, _, c in ctx_mix_lm._spelled([(0, own, i)])]
        assert math.isclose(part[k].logp, logp, rel_tol=1e-4) and math.isclose(sum(r.spell for r in part[k].rest), sum(spell), rel_tol=1e-4, abs_tol=1e-9)
        assert [r.h for r in part[k].rest] == [xxhash.xxh64_intdigest(own[j], 42) - (1 << 64) * (xxhash.xxh64_intdigest(own[j], 42) >> 63) for j in np.flatnonzero(i == 0)]
        assert got[k].n_tokens == len(i) and part[k].size == len((t or "").encode())


# all --------------------------------------------------------------------------------------------------------------


def test_each_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda x: int(x[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def test_mix_digest_is_the_sorted_schedule(spark):
    """op8's rows come in the curriculum's order, untaken ones last, and sum up the schedule's passes."""
    rows = [(k, " ".join(["w"] * (k % 7)), "abc"[k % 3]) for k in range(300)] + [(7, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = curriculum_mix.mix_digest(docs).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(got, key=lambda r: (r.position is None, r.position or 0, r.doc_id))]
    plan = curriculum_mix.schedule(curriculum_mix.place_documents(docs)).toPandas()
    assert plan["pass"].max() == 1 and sum(r.taken for r in got) == plan.words.sum() and len(got) == len(rows)
    first = plan[plan["pass"] == 0]
    assert sorted((r.doc_id, r.position) for r in got if r.taken) == sorted(zip(first.doc_id, first.position, strict=True))


@pytest.mark.parametrize("name", ["op4_warc_segments", "op6_minhash_bbit", "op7_rp_forest", "op8_curriculum_mix", "op9_bm25_decon"])
def test_queries_equal_their_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns[:2])
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in want.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, equal_nan=True)
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
