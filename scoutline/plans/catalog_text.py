"""Registered queries for cleaning, sentences, sections, entities, ids and
document metadata, with their DuckDB oracles.  Every query reads whole
tables (documents, pages, nation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions import sections as S
from scoutline.functions import text as X
from scoutline.operators import aggregates as AG
from scoutline.operators import entities as EN
from scoutline.operators import sentence_model as SM
from scoutline.operators import preprocess as PP
from scoutline.plans import roles
from scoutline.plans.sqlfrag import q as sq

# Frequent syllables of the invented test prose, so that every section type
# is exercised (the default press-release keywords barely occur in it).
TEST_KEYWORDS = {
    "company_description": ["tion"],
    "product_details": ["ment", "eau"],
    "technical_info": ["ing", "AI"],
    "team_info": ["lich", "team"],
    "funding_info": ["the", "round"],
}
# Gazetteer phrases that occur in the test prose (license lines and a
# recurring name); nation names from the ``nation`` table are added as places.
TEST_GAZETTEER = [("Apache", "ORG"), ("MIT", "ORG"), ("GNU", "ORG"),
                  ("Apache License", "PRODUCT"), ("MIT License", "PRODUCT"),
                  ("General Public License", "PRODUCT"), ("CC BY NC", "PRODUCT"),
                  ("Stteen Erachtz", "PERSON")]


def _docs(spark, sf):
    return roles.read(spark, sf, "documents")


def _pages(spark, sf):
    return roles.read(spark, sf, "pages")


def gazetteer(spark, sf) -> DataFrame:
    lit = spark.createDataFrame(TEST_GAZETTEER, "phrase string, label string")
    places = roles.read(spark, sf, "nation").select(F.col("n_name").alias("phrase"), F.lit("GPE").alias("label"))
    return lit.unionByName(places)


def _doc_col(fn, name):
    def run(spark, sf):
        return _docs(spark, sf).select("doc_id", fn(F.col("text")).alias(name))
    return run


def q_html_to_text(spark, sf):
    return _pages(spark, sf).select("page_id", X.html_to_text("html").alias("text"))


def q_nfkd_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip_special(X.collapse_ws(X.nfkd("text"))).alias("text"))


def q_remove_urls(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", X.remove_urls("url").alias("url"), X.remove_urls("html").alias("html"))


def q_cut_more_info(spark, sf):
    return _docs(spark, sf).select("doc_id", X.cut_more_info(X.collapse_ws("text")).alias("text"))


def q_clean_pages(spark, sf):
    return _pages(spark, sf).select("page_id", X.clean_text("html").alias("clean_text"))


def q_split_sentences(spark, sf):
    s = X.split_sentences(X.clean_text("text"))
    return _docs(spark, sf).select("doc_id", F.size(s).cast("int").alias("n"),
                                   F.array_join(s, " | ").alias("sentences"))


def q_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", X.word_count(X.clean_text("text")).alias("word_count"))


def q_sentence_count(spark, sf):
    return _docs(spark, sf).select("doc_id", X.sentence_count(X.split_sentences(X.clean_text("text")))
                                   .alias("sentence_count"))


def q_classify_sections(spark, sf):
    d = PP.clean_and_split(_docs(spark, sf), keywords=TEST_KEYWORDS)
    cols = [S.section_value("key_sections", n).alias(n) for n in TEST_KEYWORDS]
    return d.select("doc_id", *cols, S.section_present("key_sections", list(TEST_KEYWORDS)).alias("section_present"))


def q_extract_amounts(spark, sf):
    a = F.array_distinct(X.extract_amounts(X.html_to_text("text")))
    return _docs(spark, sf).select("doc_id", F.size(a).cast("int").alias("n"),
                                   F.array_join(a, ",").alias("amounts"))


def q_doc_id(spark, sf):
    d = _docs(spark, sf)
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
    return d.select(F.col("doc_id").alias("row_id"), X.doc_id(path, F.col("text")).alias("doc_id"))


def q_dedupe_by_id(spark, sf):
    d = _docs(spark, sf)
    cid = X.doc_id(F.lit("docs/release.pdf"), F.col("text"))
    return AG.dedupe_by_id(X.drop_empty_text(d).select(cid.alias("content_id"), F.col("doc_id").alias("first_doc"), "lang"),
                           "content_id", "first_doc")


def q_drop_empty_text(spark, sf):
    return X.drop_empty_text(_docs(spark, sf)).select("doc_id", "n_chars")


def q_allowed_file(spark, sf):
    p = _pages(spark, sf)
    name = X.file_name(F.regexp_replace("url", r"[?#].*$", ""))
    return p.select("page_id", name.alias("name"),
                    X.allowed_file(name, ["html", "htm", "php"]).alias("allowed"))


def q_gazetteer_entities(spark, sf):
    e = EN.gazetteer_entities(_docs(spark, sf), gazetteer(spark, sf))
    return e.select("doc_id", *[F.array_join(n, ",").alias(n)
                                for n in ["organizations", "people", "locations", "products"]])


def q_preprocess(spark, sf):
    p = PP.preprocess(_docs(spark, sf), gazetteer=gazetteer(spark, sf))
    return p.select("doc_id", *PP.METADATA_FIELDS)


INDEX_CLOCK = "2024-01-31 00:00:00"


def q_index_metadata(spark, sf):
    d = _docs(spark, sf).withColumn(
        "path", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))))
    p = PP.preprocess(d, gazetteer=gazetteer(spark, sf))
    m = PP.index_metadata_row(p, path_col="path", processed_at=INDEX_CLOCK)
    return m.select("doc_id", "filename", F.date_format("processed_date", "yyyy-MM-dd HH:mm:ss").alias("processed_date"),
                    "word_count", "sentence_count", "section_present", "mentioned_people")


def q_extract_entities(spark, sf):
    d = _docs(spark, sf).withColumn("decoded", X.html_to_text("text"))
    e = EN.extract_entities(d, gazetteer(spark, sf), text_col="text", raw_col="decoded")
    return e.select("doc_id", *[F.array_join(n, ",").alias(n)
                                for n in ["organizations", "people", "locations", "products", "amounts"]])


def q_section_coverage(spark, sf):
    p = PP.preprocess(_docs(spark, sf).select("doc_id", "source", "text"), keywords=TEST_KEYWORDS)
    return (p.groupBy("source")
            .agg(F.count(F.lit(1)).alias("docs"),
                 F.sum(F.col("has_technical_info").cast("int")).alias("technical"),
                 F.sum(F.col("has_funding_info").cast("int")).alias("funding"),
                 F.sum(F.size("sentences")).alias("sentences")))


def q_sanitize_metadata(spark, sf):
    d = _docs(spark, sf)
    raw = d.select("doc_id",
                   F.split("source", "c").alias("parts"),
                   F.when(F.col("lang") == "en", F.lit(None).cast("string")).otherwise(F.col("lang")).alias("lang"),
                   (F.col("n_chars") > 1000).alias("long_doc"),
                   (F.col("n_chars") / F.lit(1000.0)).alias("kchars"))
    return PP.sanitize_metadata(raw)


def q_abbreviation_counts(spark, sf):
    """Word types of all documents with and without a final period, and how likely they are abbreviations."""
    counts = SM.token_counts(_docs(spark, sf))
    scores = SM.abbreviation_scores(counts).select("type", (F.col("score") >= SM.ABBREVIATION_SCORE).alias("abbreviation"))
    return counts.join(scores, "type", "left").select(
        "type", "with_period", "without_period", F.coalesce("abbreviation", F.lit(False)).alias("abbreviation"))


def q_learned_sentences(spark, sf):
    """The documents' sentences, split with a model learned from them."""
    docs = _docs(spark, sf)
    model = SM.learn_sentence_model(docs)
    return docs.select("doc_id", X.split_sentences(F.col("text"), model).alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


QUERIES = {
    "abbreviation_counts": q_abbreviation_counts,
    "learned_sentences": q_learned_sentences,
    "html_to_text": q_html_to_text,
    "nfkd_clean": q_nfkd_clean,
    "collapse_ws": _doc_col(X.collapse_ws, "text"),
    "strip_special": _doc_col(X.strip_special, "text"),
    "remove_captions": _doc_col(X.remove_captions, "text"),
    "remove_urls": q_remove_urls,
    "remove_emails": _doc_col(X.remove_emails, "text"),
    "cut_more_info": q_cut_more_info,
    "clean_text": _doc_col(lambda c: X.clean_text(c), "clean_text"),
    "clean_text_reference": _doc_col(lambda c: X.clean_text(c, mode="reference"), "clean_text"),
    "clean_pages": q_clean_pages,
    "split_sentences": q_split_sentences,
    "word_count": q_word_count,
    "sentence_count": q_sentence_count,
    "classify_sections": q_classify_sections,
    "extract_amounts": q_extract_amounts,
    "doc_id": q_doc_id,
    "dedupe_by_id": q_dedupe_by_id,
    "drop_empty_text": q_drop_empty_text,
    "allowed_file": q_allowed_file,
    "gazetteer_entities": q_gazetteer_entities,
    "preprocess": q_preprocess,
    "section_coverage": q_section_coverage,
    "sanitize_metadata": q_sanitize_metadata,
    "index_metadata": q_index_metadata,
    "extract_entities": q_extract_entities,
}


# --------------------------------------------------------------- DuckDB side
# The same patterns as the Spark side, applied by RE2.

def rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {sq(pattern)}, {sq(repl)}, 'g')"


def s_html(e: str) -> str:
    for p in X.HTML_DROP_PATTERNS:
        e = rx(e, p, " ")
    for ent, ch in X.HTML_ENTITIES:
        e = f"replace({e}, {sq(ent)}, {sq(ch)})"
    return e


def s_collapse(e):
    return rx(e, X.WS + "+", " ")


def s_strip(e):
    return rx(e, X.SPECIAL_PATTERN)


def s_trim(e):
    return rx(e, "^" + X.WS + "+|" + X.WS + "+$")


def s_normalize(e, recollapse=False):
    t = s_strip(s_collapse(f"strip_accents({e})"))
    return s_trim(rx(t, X.SPACE_RUN, " ") if recollapse else t)


def s_boilerplate(e, line_wise):
    e = rx(rx(rx(e, X.CAPTION_PATTERN), X.URL_PATTERN), X.EMAIL_PATTERN)
    if line_wise:
        e = rx(rx(e, "(?im)For more information.*$"), "(?im)^About .*\n.*$")
    else:
        e = rx(rx(e, X.MORE_INFO_PATTERN), X.ABOUT_PATTERN)
    return s_trim(e)


def s_clean(e, mode="effective"):
    e = s_html(e)
    if mode == "reference":
        return s_trim(s_boilerplate(s_normalize(e), False))
    return s_normalize(s_boilerplate(e, True), recollapse=True)


def s_sentences(e):
    return (f"list_filter(list_transform(regexp_extract_all({e}, {sq(X.SENTENCE_PATTERN)}), "
            f"lambda s: trim(s)), lambda s: s <> '')")


def s_words(e):
    return f"CAST(len(list_filter(string_split(trim({s_collapse(e)}), ' '), lambda w: w <> '')) AS INTEGER)"


def s_amounts(e):
    found = (f"list_transform(regexp_extract_all({e}, {sq(X.AMOUNT_PATTERN)}), "
             f"lambda x: {rx('x', X.AMOUNT_TAIL)})")
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def s_hit(x, kws, mode="effective"):
    tests = []
    for k in kws:
        if k != k.lower():
            if mode == "effective":
                tests.append(f"regexp_matches({x}, {sq(S.acronym_pattern(k))})")
            continue
        tests.append(f"contains(lower({x}), {sq(k)})")
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def s_section(sents, kws):
    picked = (f"flatten(list_transform({sents}, lambda x, i: CASE WHEN {s_hit('x', kws)} "
              f"THEN {sents}[i:i+1] ELSE []::VARCHAR[] END))")
    return f"(CASE WHEN len({picked}) > 0 THEN trim(array_to_string({picked}, ' ')) END)"


def s_sections_select(sents, keywords):
    cols = []
    for n, kws in keywords.items():
        cols.append(f"COALESCE({s_section(sents, kws)}, '') AS {n}")
    names = list(keywords)
    flags = ", ".join(f"CASE WHEN {n} <> '' THEN {sq(n)} END" for n in names)
    present = f"concat_ws(',', {flags})"
    return cols, present


def _gaz_sql():
    vals = ", ".join(f"({sq(p)}, {sq(lab)})" for p, lab in TEST_GAZETTEER)
    return f"""gaz AS (
  SELECT DISTINCT array_to_string(regexp_extract_all(phrase, {sq(EN.TOKEN_PATTERN)}), ' ') AS phrase, label
  FROM (SELECT * FROM (VALUES {vals}) v(phrase, label)
        UNION ALL SELECT n_name, 'GPE' FROM nation))"""


def _ents_sql(src: str, text: str) -> str:
    """CTEs toks, grams, hits, ents over ``src(doc_id, {text})``."""
    return f"""toks AS (SELECT doc_id, regexp_extract_all({text}, {sq(EN.TOKEN_PATTERN)}) AS tok FROM {src}),
grams AS (
  SELECT doc_id, i AS pos, array_to_string(tok[i:i + n - 1], ' ') AS phrase
  FROM toks CROSS JOIN (VALUES (1), (2), (3)) ns(n),
       LATERAL (SELECT unnest(range(1, len(tok) - n + 2)) AS i)),
hits AS (SELECT g.doc_id, gaz.label, g.phrase, min(g.pos) AS pos
         FROM grams g JOIN gaz ON g.phrase = gaz.phrase GROUP BY ALL),
ents AS (
  SELECT doc_id,
    string_agg(phrase, ',' ORDER BY pos, phrase) FILTER (WHERE label = 'ORG') AS organizations,
    string_agg(phrase, ',' ORDER BY pos, phrase) FILTER (WHERE label = 'PERSON') AS people,
    string_agg(phrase, ',' ORDER BY pos, phrase) FILTER (WHERE label = 'GPE') AS locations,
    string_agg(phrase, ',' ORDER BY pos, phrase) FILTER (WHERE label = 'PRODUCT') AS products
  FROM hits GROUP BY doc_id)"""


def _classify_sql():
    cols, present = s_sections_select("sents", TEST_KEYWORDS)
    return f"""
WITH c AS (SELECT doc_id, {s_clean('text')} AS clean FROM documents),
s AS (SELECT doc_id, {s_sentences('clean')} AS sents FROM c),
x AS (SELECT doc_id, {', '.join(cols)} FROM s)
SELECT *, {present} AS section_present FROM x"""


def _preprocess_sql():
    cols, present = s_sections_select("sents", S.SECTION_KEYWORDS)
    return f"""
WITH {_gaz_sql()},
c AS (SELECT doc_id, {s_html('text')} AS decoded FROM documents),
c2 AS (SELECT doc_id, decoded, {s_normalize(s_boilerplate('decoded', True), recollapse=True)} AS clean_text FROM c),
s AS (SELECT doc_id, decoded, clean_text, {s_sentences('clean_text')} AS sents FROM c2),
{_ents_sql('s', 'clean_text')},
x AS (SELECT doc_id, clean_text, sents, {s_amounts('decoded')} AS amounts, {', '.join(cols)} FROM s)
SELECT x.doc_id,
  {s_words('clean_text')} AS word_count,
  CAST(len(sents) AS INTEGER) AS sentence_count,
  technical_info <> '' AS has_technical_info,
  funding_info <> '' AS has_funding_info,
  COALESCE(e.organizations, '') AS mentioned_organizations,
  COALESCE(e.people, '') AS mentioned_people,
  COALESCE(e.locations, '') AS mentioned_locations,
  {present} AS section_present,
  array_to_string(amounts, ',') AS extracted_amounts,
  company_description, product_details, technical_info, team_info, funding_info
FROM x LEFT JOIN ents e ON x.doc_id = e.doc_id"""


def _index_metadata_sql():
    return f"""SELECT doc_id, CAST(doc_id AS VARCHAR) || '.pdf' AS filename, {sq(INDEX_CLOCK)} AS processed_date,
  word_count, sentence_count, section_present, mentioned_people
FROM ({_preprocess_sql()}) p"""


def _coverage_sql():
    cols, _ = s_sections_select("sents", TEST_KEYWORDS)
    return f"""
WITH c AS (SELECT doc_id, source, {s_clean('text')} AS clean FROM documents),
s AS (SELECT doc_id, source, {s_sentences('clean')} AS sents FROM c),
x AS (SELECT doc_id, source, sents, {', '.join(cols)} FROM s)
SELECT source, count(*) AS docs,
       CAST(sum(CAST(technical_info <> '' AS INTEGER)) AS BIGINT) AS technical,
       CAST(sum(CAST(funding_info <> '' AS INTEGER)) AS BIGINT) AS funding,
       CAST(sum(len(sents)) AS BIGINT) AS sentences
FROM x GROUP BY source"""


_PATH = "source || '/' || CAST(doc_id AS VARCHAR) || '.pdf'"


def _stem(name):
    return f"regexp_extract({name}, '^(.+?)(\\.[^.]*)?$', 1)"


def _fname(path):
    return f"regexp_extract({path}, '([^/]*)$', 1)"


ORACLE = {
    "abbreviation_counts": f"""
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(COALESCE(text, ''), {sq(X.WS + '+')}), lambda x: x <> '')) AS w
           FROM documents),
t AS (SELECT regexp_replace(lower(w), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}.]+$', '', 'g') AS t FROM w),
c AS (SELECT regexp_replace(t, '\\.+$', '') AS type, count(*) FILTER (WHERE t LIKE '%.') AS k,
             count(*) FILTER (WHERE NOT t LIKE '%.') AS r FROM t WHERE regexp_matches(t, '\\p{{L}}') GROUP BY 1),
s AS (SELECT *, sum(k) OVER () / sum(k + r) OVER () AS p, length(type) - length(replace(type, '.', '')) AS dots FROM c)
SELECT type, k AS with_period, r AS without_period,
       k > 0 AND round(-2 * (k * ln(greatest(p, 1e-12)) + r * ln(greatest(1 - p, 1e-12)) - k * ln(0.99) - r * ln(0.01))
         * exp(-(length(type) - dots)) * (dots + 1) * pow(length(type) - dots, -r::DOUBLE), 6) >= {SM.ABBREVIATION_SCORE} AS abbreviation
FROM s""",
    "html_to_text": f"SELECT page_id, {s_html('html')} AS text FROM pages",
    "nfkd_clean": f"SELECT doc_id, {s_strip(s_collapse('strip_accents(text)'))} AS text FROM documents",
    "collapse_ws": f"SELECT doc_id, {s_collapse('text')} AS text FROM documents",
    "strip_special": f"SELECT doc_id, {s_strip('text')} AS text FROM documents",
    "remove_captions": f"SELECT doc_id, {rx('text', X.CAPTION_PATTERN)} AS text FROM documents",
    "remove_urls": f"SELECT page_id, {rx('url', X.URL_PATTERN)} AS url, {rx('html', X.URL_PATTERN)} AS html FROM pages",
    "remove_emails": f"SELECT doc_id, {rx('text', X.EMAIL_PATTERN)} AS text FROM documents",
    "cut_more_info": f"SELECT doc_id, {rx(s_collapse('text'), X.MORE_INFO_PATTERN)} AS text FROM documents",
    "clean_text": f"SELECT doc_id, {s_clean('text')} AS clean_text FROM documents",
    "clean_text_reference": f"SELECT doc_id, {s_clean('text', 'reference')} AS clean_text FROM documents",
    "clean_pages": f"SELECT page_id, {s_clean('html')} AS clean_text FROM pages",
    "split_sentences": f"""
WITH s AS (SELECT doc_id, {s_sentences(s_clean('text'))} AS sents FROM documents)
SELECT doc_id, CAST(len(sents) AS INTEGER) AS n, array_to_string(sents, ' | ') AS sentences FROM s""",
    "word_count": f"SELECT doc_id, {s_words(s_clean('text'))} AS word_count FROM documents",
    "sentence_count": f"SELECT doc_id, CAST(len({s_sentences(s_clean('text'))}) AS INTEGER) AS sentence_count FROM documents",
    "classify_sections": _classify_sql(),
    "extract_amounts": f"""
WITH a AS (SELECT doc_id, {s_amounts(s_html('text'))} AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n, array_to_string(a, ',') AS amounts FROM a""",
    "doc_id": f"""SELECT doc_id AS row_id,
  {_stem(_fname(_PATH))} || '_' || substr(md5(text), 1, 8) AS doc_id FROM documents""",
    "dedupe_by_id": f"""
SELECT 'release_' || substr(md5(text), 1, 8) AS content_id, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang
FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1""",
    "drop_empty_text": "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND text <> ''",
    "allowed_file": f"""
WITH n AS (SELECT page_id, {_fname(rx('url', '[?#].*$'))} AS name FROM pages)
SELECT page_id, name,
  COALESCE(contains(name, '.') AND lower(split_part(name, '.', -1)) IN ('html', 'htm', 'php'), false) AS allowed
FROM n""",
    "gazetteer_entities": f"""
WITH {_gaz_sql()},
{_ents_sql('documents', 'text')}
SELECT d.doc_id, COALESCE(e.organizations, '') AS organizations, COALESCE(e.people, '') AS people,
       COALESCE(e.locations, '') AS locations, COALESCE(e.products, '') AS products
FROM documents d LEFT JOIN ents e ON d.doc_id = e.doc_id""",
    "preprocess": _preprocess_sql(),
    "section_coverage": _coverage_sql(),
    "index_metadata": _index_metadata_sql(),
    "extract_entities": f"""
WITH {_gaz_sql()},
{_ents_sql('documents', 'text')},
a AS (SELECT doc_id, {s_amounts(s_html('text'))} AS a FROM documents)
SELECT d.doc_id, COALESCE(e.organizations, '') AS organizations, COALESCE(e.people, '') AS people,
       COALESCE(e.locations, '') AS locations, COALESCE(e.products, '') AS products,
       array_to_string(a.a, ',') AS amounts
FROM documents d LEFT JOIN ents e ON d.doc_id = e.doc_id JOIN a ON d.doc_id = a.doc_id""",
    "sanitize_metadata": """
SELECT doc_id,
  COALESCE(array_to_string(string_split_regex(source, 'c'), ','), '') AS parts,
  COALESCE(CASE WHEN lang = 'en' THEN NULL ELSE lang END, '') AS lang,
  n_chars > 1000 AS long_doc,
  CAST(n_chars AS DOUBLE) / 1000.0 AS kchars
FROM documents""",
}
