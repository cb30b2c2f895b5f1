"""Hand-made cases for cleaning, sentences, sections, ids and names."""

from pyspark.sql import functions as F

from scoutline.functions import sections as S
from scoutline.functions import text as X
from scoutline.operators.preprocess import sanitize_metadata

SAMPLE = ("(Photo credit: X) See https://a.b/c?d=1 or mail a@b.co. For more information, call us.\n"
          "About Acme\nAcme is x.")


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_clean_reference_order(spark):
    assert one(spark, X.normalize_text(F.col("t")), SAMPLE) == (
        "Photo credit X See httpsa.bc?d1 or mail ab.co. For more information, call us. About Acme Acme is x.")
    assert one(spark, X.clean_text(F.col("t"), mode="reference"), SAMPLE) == \
        "Photo credit X See httpsa.bc?d1 or mail ab.co."


def test_clean_default_order(spark):
    assert one(spark, X.clean_text(F.col("t")), SAMPLE) == "See or mail"


def test_clean_is_idempotent(spark):
    once = one(spark, X.clean_text(F.col("t")), SAMPLE + " Café ﬁn")
    assert one(spark, X.clean_text(F.col("t")), once) == once


def test_nfkd(spark):
    assert one(spark, X.normalize_text(F.col("t")), "Café ﬁn １２") == "Cafe fin 12"


def test_html_to_text(spark):
    html = '<html><head><style>p{x:1}</style><script>var t="</p>";</script></head>' \
           '<body><!-- note --><p>A &amp; B&copy;</p><p>C &quot;D&quot;</p></body></html>'
    got = one(spark, X.collapse_ws(X.html_to_text(F.col("t"))), html).strip()
    assert got == 'A & B© C "D"'


def sections_of(spark, text, mode="effective"):
    sents = X.split_sentences(F.col("t"))
    return one(spark, S.classify_sections(sents, S.SECTION_KEYWORDS, mode), text)


def test_sections_hit_plus_next(spark):
    got = sections_of(spark, "We raised a round. It was big. The team grew.")
    assert got == {"funding_info": "We raised a round. It was big.", "team_info": "The team grew."}


def test_sections_adjacent_hits_repeat(spark):
    got = sections_of(spark, "Our team won. The team grew. End.")
    assert got["team_info"] == "Our team won. The team grew. The team grew. End."


def test_sections_substring_hit(spark):
    assert "team_info" in sections_of(spark, "A steam engine.")


def test_ai_keyword_modes(spark):
    assert "technical_info" not in sections_of(spark, "It uses AI.", mode="reference")
    assert "technical_info" in sections_of(spark, "It uses AI.")
    assert "technical_info" not in sections_of(spark, "They raised money.")


def test_section_present_order(spark):
    sents = X.split_sentences(F.col("t"))
    sec = S.classify_sections(sents)
    assert one(spark, S.section_present(sec), "The team raised a round.") == "team_info,funding_info"


def test_word_and_sentence_counts(spark):
    assert one(spark, X.word_count(F.col("t")), "  a  b\tc\n") == 3
    assert one(spark, X.word_count(F.col("t")), "") == 0
    assert one(spark, F.size(X.split_sentences(F.col("t"))), "One. Two! Three? four") == 4


def test_amounts(spark):
    assert one(spark, X.extract_amounts(F.col("t")), "$5 million and 5 km 3,000.5bn x") == \
        ["$5 million", "5", "3,000.5bn"]


def test_doc_id(spark):
    df = spark.createDataFrame([("x/acme.v2.pdf", "hello")], "p string, t string")
    assert df.select(X.doc_id(F.col("p"), F.col("t"))).first()[0] == "acme.v2_5d41402a"
    stems = spark.createDataFrame([(".pdf",), ("a",), ("a.b.c",)], "n string") \
        .select(X.file_stem(F.col("n"))).collect()
    assert [r[0] for r in stems] == [".pdf", "a", "a.b"]


def test_sanitize(spark):
    df = spark.createDataFrame([([1, 2], None, True, 1.5)], "a array<int>, b string, c boolean, d double")
    r = sanitize_metadata(df).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("1,2", "", True, 1.5)


def test_drop_empty_text(spark):
    df = spark.createDataFrame([("",), (None,), (" ",)], "text string")
    assert [r[0] for r in X.drop_empty_text(df).collect()] == [" "]


def test_allowed_file(spark):
    names = ["a.PDF", "a.docx", "a", "a.pdf.exe", ".pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(X.allowed_file(F.col("n"))).collect()]
    assert got == [True, True, False, False, True]


def test_stored_name(spark):
    df = spark.createDataFrame([("my résumé (1).pdf",)], "n string") \
        .withColumn("ts", F.to_timestamp(F.lit("2024-03-05 07:08:09")))
    assert df.select(X.stored_name(F.col("n"), F.col("ts"))).first()[0] == "20240305_070809_my_rsum_1.pdf"


def test_cut_about_modes(spark):
    text = "Intro line.\nAbout Acme\nAcme makes x.\nLast line."
    assert one(spark, X.cut_about(F.col("t"), line_wise=True), text) == "Intro line.\n\nLast line."
    # Reference form: 'About' up to the next line, then only if that line
    # ends the text.
    assert one(spark, X.cut_about(F.col("t")), "x About Acme\nend") == "x "
    assert one(spark, X.cut_more_info(F.col("t"), line_wise=True), "a\nFor more information: b\nc") == "a\n\nc"
    assert one(spark, X.cut_more_info(F.col("t")), "a For more information b c") == "a "


def test_search_text_modes(spark):
    from scoutline.functions.prompts import search_text
    df = spark.createDataFrame([("cv", ["Dev"], ["AI/ML", "FinTech"], ["Remote"])],
                               "r string, roles array<string>, ind array<string>, loc array<string>")
    eff = df.select(search_text("r", "roles", "ind", "loc")).first()[0]
    ref = df.select(search_text("r", "roles", "ind", "loc", mode="reference")).first()[0]
    assert eff == ("Resume: cv\n        Desired Role: Dev\n        Preferred Industries: AI/ML, FinTech"
                   "\n        Preferred Locations: Remote")
    assert ref == "Resume: cv\n        Desired Role: \n        Preferred Industries: AI/ML, FinTech" \
                  "\n        Preferred Locations:"


def test_html_plan_holds_no_table_of_names(spark):
    """The names of HTML 5 stay out of the plan, where every copy of them was folded and kept by the driver."""
    df = spark.createDataFrame([("a",)], "t string").select(X.html_to_text("t"))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CounterClockwiseContourIntegral" not in optimized and len(optimized) < 5_000


def test_references_of_any_form(spark):
    cases = {"&#65279;x": "x", "&#x1F600;&#128512": "\U0001F600\U0001F600", "&#00000000000000000065;": "A",
             "&#xFFFFFFFFFFFFFFFFFFFFFFFF;": "&#xFFFFFFFFFFFFFFFFFFFFFFFF;", "&notit;&notin;&ampx": "\xacit;∉&x",
             "&&lt;&": "&<&", "&#129;&#128;": "\x81€", "&CounterClockwiseContourIntegral;": "∳"}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select(X.html_to_text("t"), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
