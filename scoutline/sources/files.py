"""Document sources: folder scans, byte decoding, page assembly."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutline.functions.text import html_to_text
from scoutline.session import ship_package

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def scan_documents(spark: SparkSession, directory: str, glob: str = "*.pdf") -> DataFrame:
    """Files directly inside ``directory`` whose name matches ``glob``
    (case-sensitive, not recursive), as (path, modificationTime, length,
    content).  Files are split into tasks by the file source; nothing is
    listed on the driver beyond Spark's own file index."""
    return (spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "false")
            .load(directory))


#: Why a file has no text.
NO_CONTENT, BAD_BYTES, BAD_TYPE = "no content", "not UTF-8", "unsupported type"
EXTRACTOR_FAILED, NO_TEXT = "extractor failed", "no text"
FAILURES = [NO_CONTENT, BAD_BYTES, BAD_TYPE, EXTRACTOR_FAILED, NO_TEXT]


def extract_text(df: DataFrame, extractor: Callable[[bytes], str] | None = None, *,
                 content_col: str = "content", path_col: str = "path", out: str = "raw_text",
                 reason: str | None = None) -> DataFrame:
    """Bytes -> text; a failure gives '' (the row is kept, so failures are
    counted, not lost).  ``reason`` names a column for the one of ``FAILURES`` that
    holds for the file, null where it has text.

    Without an extractor: UTF-8 text, with HTML decoded for .html/.htm
    names, and '' for other binary formats.  With one (e.g. a PDF decoder),
    it runs per Arrow batch in ``mapInPandas``."""
    if extractor is None:
        # Null (so '') where the bytes are not UTF-8: one bad file never stops the job.
        txt = F.try_validate_utf8(F.col(content_col).cast("string"))
        low = F.lower(F.col(path_col))
        html, plain = low.endswith(".html") | low.endswith(".htm"), low.endswith(".txt") | low.endswith(".md")
        decoded = F.when(html, html_to_text(txt)).when(plain, txt).otherwise(F.lit(""))
        done = df.withColumn(out, F.coalesce(decoded, F.lit("")))
        if reason is None:
            return done
        why = (F.when(F.col(content_col).isNull(), NO_CONTENT).when(~F.coalesce(html | plain, F.lit(False)), BAD_TYPE)
               .when(txt.isNull(), BAD_BYTES).when(F.col(out) == "", NO_TEXT))
        return done.withColumn(reason, why)

    ship_package(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += f", `{out}` string" + (f", `{reason}` string" if reason else "")

    def safe(b):
        if b is None:
            return "", NO_CONTENT
        try:
            t = extractor(b)
        except Exception:  # noqa: BLE001
            return "", EXTRACTOR_FAILED
        t = t if isinstance(t, str) else ""
        return t, None if t else NO_TEXT

    def run(batches):
        for pdf in batches:
            done = [safe(b) for b in pdf[content_col]]
            new = {out: [t for t, _ in done], **({reason: [r for _, r in done]} if reason else {})}
            yield pdf.assign(**{c: pd.Series(v, index=pdf.index, dtype=object) for c, v in new.items()})
    return df.mapInPandas(run, schema)
