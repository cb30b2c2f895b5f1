"""Statistics of whole documents, computed over Arrow slices with numpy, and
the ratio features that the quality operators learn from.

A null or empty text has zero in every count; ratios over nothing are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import buffer, cut, mix, owner, per_document, slices, strings, windows, words, _SPACE

REPEAT_WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines",
          "n_distinct", "n_top", "n_upper", "n_digits", "n_punct"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:")] = True

#: Feature -> (numerator, denominator) among COUNTS.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "distinct_ratio": ("n_distinct", "n_words"),
    "top_ratio": ("n_top", "n_words"),
    "upper_ratio": ("n_upper", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"),
    "punct_ratio": ("n_punct", "n_words"),
}
FEATURES = [*RATIOS, "log_words"]


def feature_columns(stats: str = "stats") -> dict[str, Column]:
    """The features as Spark columns over a struct of COUNTS."""
    out = {name: F.when(F.col(f"{stats}.{low}") > 0, F.col(f"{stats}.{up}") / F.col(f"{stats}.{low}")).otherwise(0.0)
           for name, (up, low) in RATIOS.items()}
    return out | {"log_words": F.log1p(F.col(f"{stats}.n_words").cast("double"))}


def feature_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The features as a matrix (rows x FEATURES) inside a task."""
    ratios = [np.divide(counts[up], counts[low], out=np.zeros(len(counts[up])), where=counts[low] > 0)
              for up, low in RATIOS.values()]
    return np.stack([*ratios, np.log1p(counts["n_words"].astype(float))], axis=1)


def _counts_of_codes(codes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each document and the count of its most frequent one."""
    n = len(ranges) - 1
    key, count = np.unique((owner(ranges).astype(np.int64) << 32) | codes, return_counts=True)
    doc = key >> 32
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, count)
    return np.bincount(doc, minlength=n), top


def _repeated_words(codes: np.ndarray, ranges: np.ndarray, size: int) -> np.ndarray:
    """Words of each document inside a window of ``size`` words that the
    document holds twice or more.  Hashes find candidates, words confirm."""
    hashes, at, spans = windows(mix(codes.astype(np.uint64) + np.uint64(1)), ranges, size)
    mark = np.zeros(len(codes) + 1, np.int64)
    if len(at):
        doc = owner(spans)
        key = hashes ^ mix(doc.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        first, second = order[:-1][same], order[1:][same]
        equal = doc[first] == doc[second]
        for j in range(size):
            equal &= codes[at[first] + j] == codes[at[second] + j]
        hit = np.zeros(len(at), bool)
        hit[first[equal]] = hit[second[equal]] = True
        for d in np.unique(np.concatenate([doc[first[~equal]], doc[second[~equal]]])):   # a hash clash: compare all
            own = range(spans[d], spans[d + 1])
            seen: dict[bytes, list[int]] = {}
            for w in own:
                seen.setdefault(codes[at[w]:at[w] + size].tobytes(), []).append(w)
            hit[list(own)] = False
            hit[[w for ws in seen.values() if len(ws) > 1 for w in ws]] = True
        np.add.at(mark, at[hit], 1)
        np.add.at(mark, at[hit] + size, -1)
    return per_document((np.cumsum(mark[:-1]) > 0).astype(np.int64), ranges)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each document and those with a word that equal an earlier line."""
    n = len(offsets) - 1
    ended = np.insert(data, offsets[1:], 10)
    ends = offsets + np.arange(n + 1)
    first = np.zeros(len(ended), bool)
    first[1:] = ended[:-1] == 10
    starts, ranges = cut(ended, ends, first)
    codes = strings(ended, starts).dictionary_encode().indices.to_numpy()
    full = np.add.reduceat(~_SPACE[ended], starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    key, count = np.unique((owner(ranges).astype(np.int64) << 32 | codes)[full], return_counts=True)
    repeats = np.bincount(key >> 32, weights=count - 1, minlength=n).astype(np.int64)
    return np.diff(ranges), repeats


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = buffer(texts)
    space = _SPACE[data]
    lead = (data & 0xC0) != 0x80                     # first byte of a code point
    codes, ranges, _ = words(data, offsets)
    lines, dup_lines = _duplicate_lines(data, offsets)
    distinct, top = _counts_of_codes(codes, ranges)

    def total(flags):
        return per_document(flags.astype(np.int8), offsets)

    return {"n_words": np.diff(ranges), "word_chars": total(lead & ~space), "n_symbols": total(_SYMBOL[data]),
            "n_dup_lines": dup_lines, "n_repeat_words": _repeated_words(codes, ranges, REPEAT_WINDOW),
            "n_chars": total(lead), "n_lines": lines, "n_distinct": distinct, "n_top": top,
            "n_upper": total((data >= 65) & (data <= 90)), "n_digits": total((data >= 48) & (data <= 57)),
            "n_punct": total(_PUNCT[data])}


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                    score=None) -> DataFrame:
    """``row`` (struct of the columns ``keep``, by default all) and ``stats``
    (struct of COUNTS) for every row of ``docs``; with ``score``, a function of the
    feature matrix, also ``probability``."""
    keep = docs.columns if keep is None else keep
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for b in slices(batches, "text"):
            counts = count_texts(b.column("text"))
            out = {"row": b.column("row"),
                   "stats": pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], COUNTS)}
            if score is not None:
                out["probability"] = pa.array(score(feature_matrix(counts)), pa.float64())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = f"row {slim.schema['row'].dataType.simpleString()}, stats struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"
    return shared.ready(slim).mapInArrow(run, schema + (", probability double" if score is not None else ""))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, allowed: Column | None = None,
                    id_col: str = "doc_id", text_col: str = "text"):
    """(features, labels) of at most ``max_rows`` labelled documents as numpy
    arrays, chosen by a hash of the id.  Several labels of one id count as the
    smallest; null labels and ids are left out."""
    ids = labels.select(F.col(id_col).alias("label_id"), F.col("quality").alias("label")).dropna()
    if allowed is not None:
        ids = ids.where(allowed)
    chosen = (ids.groupBy("label_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = slim.join(F.broadcast(chosen), slim["id"] == F.col("label_id"))     # at most max_rows rows
    stats = with_statistics(rows, keep=["id", "label"])
    table = (stats.select("row.id", "row.label", *[c.alias(k) for k, c in feature_columns().items()])
             .orderBy(F.xxhash64("id"), "id", *FEATURES).limit(max_rows).toPandas())
    return table[FEATURES].to_numpy(float), table["label"].to_numpy(float)
