"""Ordinary web text: long URLs and tokens, stray brackets, bad bytes, long
phrases, repeated ids, gaps, wrong types."""

import time

import pytest
from pyspark.sql import functions as F

from scoutline.functions import text as X
from scoutline.operators import aggregates as AG
from scoutline.operators import entities as EN
from scoutline.operators import embed as embed_module
from scoutline.operators import matching, outreach
from scoutline.operators.embed import embed_with
from scoutline.operators.preprocess import preprocess
from scoutline.plans import roles
from scoutline.sources.files import extract_text
from scoutline.sources.index import read_index
from scoutline.streaming.index_stream import index_texts

from conftest import SF_SMALL


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col("t")).first()[0]


def test_long_urls_and_tokens(spark):
    begin = time.time()
    assert one(spark, X.remove_urls, "a https://x.org/" + "p" * 200_000 + " b") == "a  b"
    assert one(spark, X.remove_emails, "t" * 200_000 + " a@b.c z") == "t" * 200_000 + "  z"
    assert one(spark, X.remove_emails, "x" * 200_000 + "@b.c z") == " z"
    assert "q" * 200_000 in one(spark, X.clean_text, "see http://a.b/c " + "q" * 200_000 + " .")
    assert time.time() - begin < 60


def test_url_characters(spark):
    assert one(spark, X.remove_urls, "http://a.b/~x https://a_b/%7Ey?z=1&w=(2)*!,;: end") == "~x  end"


def test_stray_brackets_are_text(spark):
    text = "Revenue < 5M this year while margins stay > 20% <b>bold</b><!-- c --><br/>x"
    assert one(spark, X.html_to_text, text) == "Revenue < 5M this year while margins stay > 20%  bold   x"


def test_bad_bytes_give_empty_text(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"ok \xff")), ("b.txt", bytearray("é".encode())), ("c.txt", None)],
                               "path string, content binary")
    assert {r.path: r.raw_text for r in extract_text(df).collect()} == {"a.txt": "", "b.txt": "é", "c.txt": ""}


def test_gazetteer_forms_agree(spark, monkeypatch):
    gaz = spark.createDataFrame([("World Wide Web Consortium", "ORG"), ("Web", "PRODUCT"), ("Ann Lee", "PERSON"),
                                 ("A B C D E F", "ORG")], "phrase string, label string")
    docs = spark.createDataFrame([(1, "The World Wide Web Consortium met Ann Lee."), (1, "A B C D E F and Ann  Lee"),
                                  (2, None), (2, "")], "doc_id long, text string")
    forms = []
    for limit in (10_000, 1):
        monkeypatch.setattr(EN, "INLINE_MAX_PHRASES", limit)
        forms.append([sorted(map(str, f.collect())) for f in (
            EN.gazetteer_entities(docs, gaz), EN.extract_entities(docs, gaz), preprocess(docs, gazetteer=gaz))])
    assert forms[0] == forms[1]
    assert len(forms[0][0]) == 4 and "World Wide Web Consortium" in "".join(forms[0][0])


def test_next_row_over_gaps(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 9, "c")], "k int, o int, t string")
    assert {r.o: r.next for r in AG.next_row(df, "k", "o", "t").collect()} == {0: "b", 5: "c", 9: None}


def test_wrong_types_are_quarantined(spark):
    raws = ['{"final_score": 0.9}', '{"final_score": "0.9"}', "5", "[1]", "!{}", "{}"]
    got = outreach.parse_evaluation(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw")
    assert {r.raw: r.error is None for r in got.collect()} == dict(zip(raws, [True, False, False, False, False, True]))
    kept = matching.min_score_filter(got, 0.0)
    assert sorted(r.raw for r in kept.collect()) == sorted([raws[0], raws[5]])


def test_every_customer_and_part_takes_part(spark):
    c, p = roles.candidates(spark, SF_SMALL), roles.companies(spark, SF_SMALL)
    assert c.count() == roles.read(spark, SF_SMALL, "customer").count()
    assert p.count() == roles.read(spark, SF_SMALL, "part").count()
    assert p.where(F.size("embedding") != 64).count() == 0


def test_character_references(spark):
    text = "it&#8217;s &eacute;t&#xE9; &euro;5 &amp;lt; &#146; &#0; &#xD800; &#1114112; &nope; &amp &lt;b&gt; & x&"
    want = "it’s été €5 &lt; ’ &#0; &#xD800; &#1114112; &nope; & <b> & x&"
    assert one(spark, X.html_to_text, text) == want
    assert one(spark, X.html_to_text, "") == "" and one(spark, X.html_to_text, None) is None


@pytest.mark.parametrize("html,want", [
    ('<a title="x > y" href="u">link</a>', " link "), ("<a title='a > b'>c</a>", " c "),
    ('<img alt = "1 > 0 < 2"/>after', " after"), ("<p don't>it's</p> 5 > 3", " it's  5 > 3"),
    ('<a title="never closed>text</a>', " text "), ('<a b="c"d=\'e>f\'>g', " g"), ("a < b > c", "a < b > c"),
    ("<!-- \"quoted > \" -->x<script>if (a > \"</p>\") b</script>y", " x y"), ("<b", "<b"), ("1 <2> 3", "1 <2> 3"),
    ("&copy2024 &notit; &notin; &eacute &AMP;&lt3", "©2024 ¬it; ∉ é &<3"), ("&#8364 &#x20AC5 &#00000000065;", "€ \U00020ac5 A"),
    ("R&D AT&T &lang &lang; &bsolb; ?a=1&b=2", "R&D AT&T &lang ⟨ ⧅ ?a=1&b=2"), ("&#99999999999;", "&#99999999999;"),
    ("&NotEqualTilde;", "\u2242\u0338")])
def test_quoted_attributes_and_references(spark, html, want):
    assert one(spark, X.html_to_text, html) == want


def test_long_attributes_and_unclosed_tags(spark):
    long = "x > " * 50_000
    assert one(spark, X.html_to_text, f'<a title="{long}">link</a>') == " link "
    assert one(spark, X.html_to_text, "<a " + "b='c > d' " * 50_000 + ">e") == " e"
    unclosed = "<a " + "b='c' " * 50_000
    assert one(spark, X.html_to_text, unclosed) == unclosed


def test_one_bad_text_costs_its_own_row(spark):
    def make():
        def embedder(texts):
            if "bad" in texts:
                raise ValueError("no vector")
            return [[float(len(t)), 1.0] for t in texts]
        return embedder

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", None, "ccc"])], "id int, t string").coalesce(1)
    got = {r.id: (r.embedding, r.embedding_error) for r in
           embed_with(docs, "t", make, sleep=lambda s: None).collect()}
    assert got == {0: ([1.0, 1.0], None), 1: (None, "ValueError: no vector"), 2: ([0.0, 1.0], None), 3: ([3.0, 1.0], None)}


def test_failed_embeddings_are_set_aside_and_added_later(spark, tmp_path):
    def make(broken):
        def maker():
            def embedder(texts):
                if broken and any("two" in t for t in texts):
                    raise RuntimeError("down")
                return [[1.0] for _ in texts]
            return embedder
        return maker

    monkey = embed_module.with_retry
    embed_module.with_retry = lambda fn, **kw: fn
    try:
        docs = spark.createDataFrame([("d/a.pdf", "text one"), ("d/b.pdf", "text two"), ("d/c.pdf", "")], "path string, raw_text string")
        out = str(tmp_path / "index")
        assert index_texts(docs, out, embedder=make(True)) == 1
        failed = spark.read.parquet(f"{out}-failed").collect()
        assert [(r.path, r.embedding_error) for r in failed] == [("d/b.pdf", "RuntimeError: down")]
        assert index_texts(docs, out, embedder=make(False)) == 1
        assert sorted(r.path for r in read_index(spark, out).collect()) == ["d/a.pdf", "d/b.pdf"]
    finally:
        embed_module.with_retry = monkey
