"""Text cleaning and measurement as Spark column expressions.

All functions are ``Column -> Column`` and stay on the JVM except ``nfkd`` and the
decoding of HTML, which run over whole Arrow batches (``pyarrow.compute``).

Regex classes are written so that Java (Spark) and RE2 (the SQL oracle)
agree with Python's Unicode-aware ``\\s``/``\\w`` on the cleaned text:

* whitespace  = ``[\\s\\x{0B}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]``
* word char   = ``[\\p{L}\\p{N}_]``
"""

from __future__ import annotations

import re
from html import entities

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: cleaning patterns (same text as the reference) ----------
CAPTION_PATTERN = r"\(([^)]*(?:Image|Photo|Screenshot)[^)]*)\)"
# One character class: an alternation inside a repeated group would make Java
# recurse once per character and overflow the stack on long URLs.  $-_ spans
# digits, upper case and most URL punctuation.
URL_PATTERN = r"https?://[a-z!$-_]+"
MORE_INFO_PATTERN = r"(?i)For more information.*$"
ABOUT_PATTERN = r"(?i)About .*\n.*$"
# Character classes equal to Python's Unicode \s and \w.
WS = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]"
NON_WS = r"[^\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]"
EMAIL_PATTERN = NON_WS + "+@" + NON_WS + "+"
# The same matches, tried only where a token starts: without it a long token
# with no "@" is scanned again from each of its characters.
EMAIL_SCAN = "(?<!" + NON_WS + ")" + EMAIL_PATTERN
SPECIAL_PATTERN = r"[^\p{L}\p{N}_\s.,!?-]"
SPACE_RUN = r" {2,}"
# Line-wise tail rules used by the default (effective) cleaning order; (?d)
# makes \n the only line terminator, as in Python.
MORE_INFO_LINE_PATTERN = r"(?imd)For more information.*$"
ABOUT_LINE_PATTERN = r"(?imd)^About .*\n.*$"
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"
# The unit must end at a non-word character; that character is matched (RE2
# has no look-ahead) and trimmed afterwards.
AMOUNT_PATTERN = r"(?:[$€£][ \t]?)?\d[\d,]*(?:\.\d+)?(?:[ \t]?(?:million|billion|bn|k|m)(?:[^\p{L}\p{N}_]|$))?"
AMOUNT_TAIL = r"[^\p{L}\p{N}_]$"
# HTML: comments, script and style bodies, then any tag.  A tag starts with a
# letter, "/", "!" or "?"; other "<" are plain text.  A ">" in a quoted attribute value
# does not end it.  These run in RE2, an automaton: linear, without recursion.
HTML_DROP_PATTERNS = [r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>",
                      r"""(?s)<[a-zA-Z/!?](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*>"""]
# Common named entities with the text they stand for here; &amp; last, so that
# replacing them in this order turns "&amp;lt;" into "&lt;" (as a parser would).
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                 ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
                 ("&trade;", "™"), ("&middot;", "·"), ("&ndash;", "–"),
                 ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]
ALLOWED_EXTENSIONS = ["pdf", "doc", "docx"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ship() -> None:
    from pyspark.sql import SparkSession

    from scoutline.session import ship_package

    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)


# A reference: decimal, hexadecimal or named; the semicolon may be missing.
_REFERENCE = re.compile(rb"&(#[0-9]{1,32}|#[xX][0-9A-Fa-f]{1,32}|[A-Za-z][A-Za-z0-9]{1,31})(;?)")


def _entity_texts() -> tuple[dict[bytes, bytes], dict[int, bytes], set[bytes]]:
    """Named references (all names of HTML 5), the code points 128 to 159 that HTML reads as
    Windows-1252, and the names that need no semicolon."""
    named = {e.strip("&;"): ch for e, ch in HTML_ENTITIES if e[1] != "#"}           # the common ones are found first
    named |= {n.rstrip(";"): named.get(n.rstrip(";"), ch) for n, ch in entities.html5.items() if n.endswith(";")}
    old = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
    bare = {n.encode() for n in entities.html5 if not n.endswith(";")}
    return {n.encode(): ch.encode() for n, ch in named.items()}, {i: ch.encode() for i, ch in old.items() if ch}, bare


_NAMED, _OLD, _BARE = _entity_texts()


def _referenced(found: re.Match) -> bytes:
    """The text that a reference stands for; what is no reference stays."""
    ref, closed = found.groups()
    if ref.startswith(b"#"):
        code = int(ref[2:], 16) if ref[1:2] in b"xX" else int(ref[1:])
        if code in _OLD:
            return _OLD[code]
        real = 1 <= code <= 0xD7FF or 0xE000 <= code <= 0x10FFFF
        return chr(code).encode().removeprefix(b"\xef\xbb\xbf") if real else found.group()      # no byte order mark
    if closed and ref in _NAMED:
        return _NAMED[ref]
    # Without a semicolon, the longest such name that it begins with.
    name = next((ref[:n] for n in range(len(ref), 1, -1) if ref[:n] in _BARE), None)
    return found.group() if name is None else _NAMED[name] + found.group()[1 + len(name):]


@F.arrow_udf(T.StringType())
def _plain_text(texts: pa.Array) -> pa.Array:
    # In the worker, as the map of names would be a literal in every plan that reads a page: the driver keeps the
    # plans of streams, and ran out of memory folding it.
    for pattern in HTML_DROP_PATTERNS:
        texts = pc.replace_substring_regex(texts, pattern=pattern, replacement=" ")
    marked = pc.match_substring(texts, "&")
    if not pc.any(marked).as_py():
        return texts
    # Bytes, so that a text that is not UTF-8 passes.
    own = [_REFERENCE.sub(_referenced, t) for t in texts.filter(marked).cast(pa.binary()).to_pylist()]
    own = pc.cast(pa.array(own, pa.binary()), options=pc.CastOptions(texts.type, allow_invalid_utf8=True))
    return pc.replace_with_mask(texts, pc.fill_null(marked, False), own)


def html_to_text(col) -> Column:
    """Drop comments/script/style/tags (each replaced by a space) and decode
    character references: decimal, hexadecimal and the names of HTML 5, those that HTML
    allows also without a semicolon.  An unknown name and a number that is no character
    stay as they are."""
    _ship()
    t = _c(col)
    # Only text that has a '<' or a '&' is looked at (most plain text has none).
    return F.coalesce(_plain_text(F.when(t.contains("<") | t.contains("&"), t)), t)


@F.arrow_udf(T.StringType())
def _nfkd_udf(s: pa.Array) -> pa.Array:
    # Vectorised NFKD over the whole Arrow batch (C++, no per-row Python).
    return pc.utf8_normalize(s, form="NFKD")


def nfkd(col) -> Column:
    """Unicode NFKD, vectorised over Arrow batches (``pyarrow.compute``)."""
    _ship()
    # The input is referenced once: Spark evaluates a Python UDF in its own
    # operator, so wrapping it in a CASE would recompute the input chain.
    # ASCII rows return at once inside the worker.
    return _nfkd_udf(_c(col))


def collapse_ws(col) -> Column:
    return F.regexp_replace(_c(col), WS + "+", " ")


def strip_special(col) -> Column:
    return F.regexp_replace(_c(col), SPECIAL_PATTERN, "")


def trim_text(col) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), "^" + WS + "+|" + WS + "+$", "")


def normalize_text(col, recollapse: bool = False) -> Column:
    """NFKD -> collapse whitespace -> strip special characters -> trim.

    Stripping can leave two spaces where a character stood between them;
    ``recollapse=True`` collapses once more so the result is idempotent."""
    t = strip_special(collapse_ws(nfkd(col)))
    # After the first collapse the only whitespace left is ' ', so the
    # second pass is a plain space-run replace.
    return trim_text(F.regexp_replace(t, SPACE_RUN, " ") if recollapse else t)


def _guarded(col, needle: str, pattern: str, repl: str = "") -> Column:
    """regexp_replace only on rows that contain ``needle`` (a literal the
    pattern cannot match without); other rows pass through untouched."""
    c = _c(col)
    return F.when(c.contains(needle), F.regexp_replace(c, pattern, repl)).otherwise(c)


def remove_captions(col) -> Column:
    return _guarded(col, "(", CAPTION_PATTERN)


def remove_urls(col) -> Column:
    return _guarded(col, "://", URL_PATTERN)


def remove_emails(col) -> Column:
    return _guarded(col, "@", EMAIL_SCAN)


def cut_more_info(col, line_wise: bool = False) -> Column:
    return F.regexp_replace(_c(col), MORE_INFO_LINE_PATTERN if line_wise else MORE_INFO_PATTERN, "")


def cut_about(col, line_wise: bool = False) -> Column:
    return F.regexp_replace(_c(col), ABOUT_LINE_PATTERN if line_wise else "(?d)" + ABOUT_PATTERN, "")


def remove_boilerplate(col, line_wise: bool = False) -> Column:
    t = remove_emails(remove_urls(remove_captions(col)))
    return trim_text(cut_about(cut_more_info(t, line_wise), line_wise))


def clean_text(col, mode: str = "effective", html: bool = True) -> Column:
    """html -> normalise -> boilerplate -> trim.

    ``mode='reference'`` keeps the reference order, where normalising first
    makes the caption, URL, e-mail and About rules dead and the
    "For more information" rule cuts to the end of the text.
    ``mode='effective'`` (default) removes boilerplate on the raw text first,
    with line-wise tail rules, then normalises (single spaces only, so
    cleaning twice changes nothing).
    """
    t = html_to_text(col) if html else _c(col)
    if mode == "reference":
        return trim_text(remove_boilerplate(normalize_text(t)))
    if mode == "effective":
        return normalize_text(remove_boilerplate(t, line_wise=True), recollapse=True)
    raise ValueError(f"unknown mode {mode!r}")


def split_sentences(col, model=None) -> Column:
    """Sentence array: runs of non-terminators plus their terminators,
    trimmed, empties dropped.  With a ``model`` (:mod:`sentence_model`) numbers and
    abbreviations are not cut."""
    if model is not None:
        from scoutline.operators.sentence_model import split_with_model
        return split_with_model(_c(col), model)
    parts = F.regexp_extract_all(_c(col), F.lit(SENTENCE_PATTERN), 0)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def word_count(col) -> Column:
    words = F.split(F.trim(collapse_ws(col)), " ")
    return F.size(F.filter(words, lambda w: w != "")).cast("int")


def sentence_count(sentences) -> Column:
    return F.size(_c(sentences)).cast("int")


def extract_amounts(col) -> Column:
    """Money and number mentions, in order of appearance (run on the text
    before ``strip_special`` so currency signs survive)."""
    found = F.regexp_extract_all(_c(col), F.lit(AMOUNT_PATTERN), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, AMOUNT_TAIL, ""))


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def file_stem(name) -> Column:
    """Path stem: last suffix removed; a leading-dot name keeps its dot."""
    return F.regexp_extract(_c(name), r"^(.+?)(\.[^.]*)?$", 1)


def doc_id(path, raw_text) -> Column:
    """File stem + '_' + first 8 hex digits of md5(raw text, UTF-8)."""
    return F.concat(file_stem(file_name(path)), F.lit("_"), F.substring(F.md5(_c(raw_text)), 1, 8))


def allowed_file(name, extensions=ALLOWED_EXTENSIONS) -> Column:
    n = _c(name)
    ext = F.lower(F.substring_index(n, ".", -1))
    return F.coalesce(n.contains(".") & ext.isin(*extensions), F.lit(False))


def safe_name(name) -> Column:
    """Conservative file name: whitespace runs -> '_', only [A-Za-z0-9_.-]
    kept, leading/trailing '.'/'_' stripped."""
    t = F.regexp_replace(F.trim(_c(name)), WS + "+", "_")
    t = F.regexp_replace(t, r"[^A-Za-z0-9_.-]", "")
    return F.regexp_replace(t, r"^[._]+|[._]+$", "")


def stored_name(name, ts) -> Column:
    """``yyyyMMdd_HHmmss_`` + safe base name of the upload."""
    return F.concat(F.date_format(_c(ts), "yyyyMMdd_HHmmss"), F.lit("_"), safe_name(name))


def drop_empty_text(df, col: str = "text"):
    """Rows with null or '' text removed; whitespace-only text is kept."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))
