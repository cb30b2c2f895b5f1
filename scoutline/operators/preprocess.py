"""Document preprocessing: clean -> sentences -> sections -> entities ->
metadata, as one projection chain per document (no shuffle except the
entity join, which carries ids and short phrases only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutline.functions import sections as S
from scoutline.functions import text as X
from scoutline.operators.entities import with_entities

ENTITY_LISTS = ["organizations", "people", "locations", "products", "amounts"]
METADATA_FIELDS = ["word_count", "sentence_count", "has_technical_info", "has_funding_info",
                   "mentioned_organizations", "mentioned_people", "mentioned_locations",
                   "section_present", "extracted_amounts", "company_description",
                   "product_details", "technical_info", "team_info", "funding_info"]


def clean_and_split(docs: DataFrame, *, text_col: str = "text", mode: str = "effective",
                    keywords: dict = S.SECTION_KEYWORDS, html: bool = True, sentence_model=None) -> DataFrame:
    """Adds ``clean_text``, ``sentences`` (computed once), ``key_sections``
    and ``amounts`` (from the decoded text, before special characters go)."""
    raw = X.html_to_text(F.col(text_col)) if html else F.col(text_col)
    return (docs.withColumn("_decoded", raw)
            .withColumn("clean_text", X.clean_text("_decoded", mode=mode, html=False))
            .withColumn("sentences", X.split_sentences("clean_text", sentence_model))
            .withColumn("_lower", F.transform("sentences", F.lower))
            .withColumn("key_sections", S.classify_sections("sentences", keywords, mode, "_lower"))
            .withColumn("amounts", F.array_distinct(X.extract_amounts("_decoded")))
            .drop("_decoded", "_lower"))


def doc_metadata(df: DataFrame) -> DataFrame:
    """The 14 stored metadata fields from text, sections and entity lists."""
    sec = F.col("key_sections")
    cols = {
        # clean_text holds no whitespace but ' ' (collapsed before special
        # characters were stripped, which can leave double spaces).
        "word_count": F.size(F.filter(F.split("clean_text", " "), lambda w: w != "")).cast("int"),
        "sentence_count": X.sentence_count("sentences"),
        "has_technical_info": S.has_section(sec, "technical_info"),
        "has_funding_info": S.has_section(sec, "funding_info"),
        "mentioned_organizations": F.array_join("organizations", ","),
        "mentioned_people": F.array_join("people", ","),
        "mentioned_locations": F.array_join("locations", ","),
        "section_present": S.section_present(sec),
        "extracted_amounts": F.array_join("amounts", ","),
    }
    for name in S.SECTION_NAMES:
        cols[name] = S.section_value(sec, name)
    return df.withColumns(cols)


def preprocess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               mode: str = "effective", gazetteer: DataFrame | None = None,
               keywords: dict = S.SECTION_KEYWORDS, html: bool = True, sentence_model=None) -> DataFrame:
    """One record per document: clean text, sections, entity lists and the
    flat metadata fields.  ``sentence_model`` is one that ``learn_sentence_model`` took from the corpus."""
    base = clean_and_split(docs, text_col=text_col, mode=mode, keywords=keywords, html=html,
                           sentence_model=sentence_model)
    if gazetteer is not None:
        base = with_entities(base, "clean_text", gazetteer)
    else:
        base = base.withColumns({n: F.array().cast("array<string>")
                                 for n in ["organizations", "people", "locations", "products"]})
    out = doc_metadata(base)
    return out.withColumn("extracted_entities", F.struct(*[F.col(n) for n in ENTITY_LISTS]))


def sanitize_metadata(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Make every column a store-compatible scalar, chosen from the schema:
    arrays -> CSV of their elements, null -> '' (strings), struct/map -> JSON,
    scalars kept."""
    out = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            out.append(F.col(f.name))
            continue
        c = F.col(f.name)
        dt = f.dataType
        if isinstance(dt, T.ArrayType):
            e = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "")
            out.append(F.coalesce(e, F.lit("")).alias(f.name))
        elif isinstance(dt, (T.StructType, T.MapType)):
            out.append(F.coalesce(F.to_json(c), F.lit("")).alias(f.name))
        elif isinstance(dt, T.StringType):
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        elif isinstance(dt, (T.BooleanType, T.IntegerType, T.LongType, T.DoubleType,
                             T.FloatType, T.ShortType, T.ByteType)):
            out.append(c)
        else:
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def index_metadata_row(df: DataFrame, *, path_col: str = "path", processed_at) -> DataFrame:
    """Stored metadata: filename + processed date + the metadata fields +
    entities as JSON.  The clock is an argument so reruns repeat."""
    return df.select(
        "*",
        X.file_name(F.col(path_col)).alias("filename"),
        F.lit(processed_at).cast("timestamp").alias("processed_date"),
        F.to_json("extracted_entities").alias("entities"))
