"""Fuzzy search for short licence notices.

A-Z is lower-cased and words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` are set one space
apart.  A notice may be found with up to ``errors`` character edits: split into
``errors + 1`` pieces, at least one piece stands unedited (pigeonhole), so exact
hits of the pieces give all candidate places.  The regex library's
bounded-error matching verifies each candidate and counts its edits; among
overlapping places of the method's own matches the one with fewest edits stays.
Places of the base phrases are the matches without edits, always all reported.

The work is one pass over the texts without a shuffle; memory is one slice of
texts.  Defined results: a null or empty text has no words, no places, empty
label strings and score 0; repeated rows, and those with null or
repeated ids, are scanned each on its own; other columns of any name do no harm.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import FOLD, buffer, slices


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int = 0       # character edits allowed
    base: bool = False    # its exact places are the base places


# The base phrases and their labels.
BASE = [
    Notice("mit", "under the mit license", 2, True),
    Notice("apache-2", "apache license version 2", 2, True),
    Notice("cc-by-nc", "cc by nc", 0, True),
]

# Further short notices, as words.
NOTICES = BASE + [
    Notice("gpl-3", "gnu general public license version 3", 3),
    Notice("gpl-2", "gnu general public license version 2", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mpl-2", "mozilla public license version 2", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by-sa", "creative commons attribution sharealike", 4),
    Notice("agpl-3", "gnu affero general public license", 3),
    Notice("gfdl", "gnu free documentation license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cddl", "common development and distribution license", 3),
    Notice("boost", "boost software license version 1", 3),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 5),
    Notice("artistic-2", "the artistic license 2 0", 2),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 4),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("proprietary", "all rights reserved", 1),
]

SPANS = "array<struct<label:string,start:bigint,end:bigint,edits:int,base:boolean>>"
RESULT = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"


def pieces(phrase: str, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` pieces of near equal length with their offsets."""
    raw = phrase.encode()
    at = [round(i * len(raw) / (errors + 1)) for i in range(errors + 2)]
    return [(i, raw[i:j]) for i, j in zip(at, at[1:])]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every document as a newline followed by its folded words, each after one
    space; and each document's start in that buffer (with the end)."""
    n = len(offsets) - 1
    starts = offsets[:-1] + 2 * np.arange(n)
    out = FOLD[np.insert(data, np.repeat(offsets[:-1], 2), 32)]
    out[starts] = 10
    blank = out == 32
    keep = ~blank
    keep[:-1] |= blank[:-1] & (out[1:] != 32) & (out[1:] != 10)
    moved = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.append(moved[starts], moved[-1])


def _matcher(n: Notice):
    return regex.compile(rb"(?b)(?<=[ ])(?:%s){e<=%d}(?=[ \n])" % (n.phrase.encode(), n.errors))


def _exact(text: bytes, phrase: bytes):
    at = text.find(b" " + phrase)
    while at >= 0:
        end = at + 1 + len(phrase)
        if text[end] in b" \n":
            yield at + 1, end
        at = text.find(b" " + phrase, at + 1)


def _fuzzy(text: bytes, n: Notice, matcher):
    """Verified places (start, end, edits) around the exact hits of the pieces."""
    found = {}
    for offset, piece in pieces(n.phrase, n.errors):
        at = text.find(piece)
        while at >= 0:
            lo = max(0, at - offset - n.errors)
            hi = at - offset + len(n.phrase) + n.errors
            begin, stop = text.rfind(b"\n", lo, at) + 1, text.find(b"\n", at, hi + 1)
            m = matcher.search(text, max(lo, begin), hi + 1 if stop < 0 else stop + 1)
            if m:
                edits = sum(m.fuzzy_counts)
                if edits < found.get(m.start(), (0, n.errors + 1))[1]:
                    found[m.start()] = (m.end(), edits)
            at = text.find(piece, at + 1)
    return [(s, e, k) for s, (e, k) in found.items()]


def _settled(matches: list[tuple]) -> list[tuple]:
    """Base places always stay; others by fewest edits, without overlaps."""
    taken = sorted(m for m in matches if m[4])
    starts = [m[0] for m in taken]
    for m in sorted((m for m in matches if not m[4]), key=lambda m: (m[3], m[0] - m[1], m[0], m[2])):
        i = bisect_right(starts, m[0])
        if (not i or taken[i - 1][1] <= m[0]) and (i == len(taken) or taken[i][0] >= m[1]):
            taken.insert(i, m)
            starts.insert(i, m[0])
    return taken


def scan_texts(texts: pa.Array, notices: list[Notice]) -> dict[str, list]:
    data, offsets = buffer(texts)
    buf, starts = spaced(data, offsets)
    text = buf.tobytes() + b"\n"
    matches: dict[int, list] = defaultdict(list)

    def owner(at: int) -> int:
        return int(np.searchsorted(starts, at, side="right")) - 1

    for n in notices:
        exact = list(_exact(text, n.phrase.encode()))
        for s, e in exact:
            matches[owner(s)].append((s, e, n.label, 0, n.base, 1.0))
        if n.errors:
            matcher = _matcher(n)
            for s, e, k in _fuzzy(text, n, matcher):
                if k:
                    matches[owner(s)].append((s, e, n.label, k, False, 1 - k / len(n.phrase)))
    blanks = np.concatenate([[0], np.cumsum(buf == 32, dtype=np.int32)])
    out = {"n_words": (blanks[starts[1:]] - blanks[starts[:-1]]).astype(np.int64), **{k: [None] * len(texts) for k in (
        "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}}
    for d in range(len(texts)):
        own = _settled(matches[d]) if d in matches else []
        word = lambda at: int(blanks[at] - blanks[starts[d]]) - 1
        base = [m for m in own if m[4]]
        out["n_base"][d] = len(base)
        out["first_word"][d] = min((word(m[0]) for m in base), default=None)
        out["last_word"][d] = max((word(m[0]) for m in base), default=None)
        out["base_labels"][d] = ",".join(sorted({m[2] for m in base}))
        out["labels"][d] = ",".join(sorted({m[2] for m in own}))
        out["score"][d] = float(max((m[5] for m in own), default=0.0))
        out["spans"][d] = [{"label": m[2], "start": word(m[0]), "end": word(m[1] - 1) + 1, "edits": m[3], "base": m[4]}
                           for m in own]
    return out


def license_scan(docs: DataFrame, notices: list[Notice] | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the columns of ``RESULT``; ``spans`` are word ranges."""
    notices = notices or NOTICES
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches):
        types = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                           ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                           ("score", pa.float64()), ("spans", pa.list_(pa.struct([
                               ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("edits", pa.int32()), ("base", pa.bool_())])))])
        for b in slices(batches, "text"):
            got = scan_texts(b.column("text"), notices)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(got[f.name], f.type) for f in types]],
                                             ["id", *types.names])

    return shared.ready(slim).mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)
