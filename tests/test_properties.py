"""Property tests: the Spark text expressions agree with Python's ``re``
(the reference's engine) on random Unicode text; cleaning is idempotent."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoutline.functions import text as X

ALPHABET = list("abcXYZ019 .,!?-_@()/:;'\"") + ["\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85",
                                                 "\xa0", " ", "　", " ", "é", "ß", "Ω",
                                                 "́", "ﬁ", "１", "😀", "字", "Ⅻ", "٣"]
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=20, max_size=40)


def run(spark, texts, col):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", col.alias("o")).collect())]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_collapse_and_strip_match_python(spark, texts):
    got = run(spark, texts, X.strip_special(X.collapse_ws(F.col("t"))))
    want = [re.sub(r"[^\w\s.,!?-]", "", re.sub(r"\s+", " ", t)) for t in texts]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_word_count_matches_python_split(spark, texts):
    assert run(spark, texts, X.word_count(F.col("t"))) == [len(t.split()) for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_sentences_match_python(spark, texts):
    clean = run(spark, texts, X.normalize_text(F.col("t")))
    got = run(spark, clean, F.array_join(X.split_sentences(F.col("t")), "|"))
    want = ["|".join(s for s in (x.strip(" ") for x in re.findall(r"[^.!?]+[.!?]*", c)) if s) for c in clean]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_clean_text_idempotent(spark, texts):
    once = run(spark, texts, X.clean_text(F.col("t")))
    assert run(spark, once, X.clean_text(F.col("t"))) == once
