"""Byte-level BPE encoding and decoding with a pair occurrence index.

Inside a task, the distinct pre-tokens of a slice are laid out as one linked list
of symbols.  An index maps each mergeable pair to all its positions in the slice;
a heap hands out the active ranks in ascending order; one step merges all positions
of a pair at once (numpy) and moves the neighbouring pairs to their new lists.

The vocabulary file is the public tokenizer JSON named by its path.  It is read on
the driver and broadcast (its size is fixed: 50 thousand entries).  Documents stay in
their partitions; there is no shuffle.

Defined results: null counts as empty; an empty text has no ids; the text of
the added token is that token, as in the tokenizers library; repeated rows, and those
with null or repeated ids, are encoded each on its own; only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import buffer, chunks, cut, slices, strings

# Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space outside [\x20\x09-\x0D]: pieces next to it are not cut there.
_WIDE_SPACE = regex.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PRETOKENS = regex.compile(PATTERN)
MEMORY = 100_000      # pre-tokens a worker remembers between slices


def _byte_letters() -> dict[str, int]:
    """The public rule that writes bytes as printable letters in vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    tokens: list[bytes]               # by id
    byte_ids: np.ndarray              # id of each single byte
    pairs: np.ndarray                 # sorted keys left << 32 | right
    ranks: np.ndarray                 # rank of each sorted key
    left: np.ndarray                  # by rank
    right: np.ndarray
    merged: np.ndarray
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters, vocab = _byte_letters(), whole["model"]["vocab"]
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            if token not in added:
                tokens[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            tokens[i] = token.encode()
        single = {tokens[i]: i for t, i in vocab.items() if t not in added and len(t) == 1}
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        left, right, merged = (np.array(c, np.int64) for c in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]))
        keys, first = np.unique(left << 32 | right, return_index=True)
        return cls(tokens, np.array([single[bytes([b])] for b in range(256)], np.int64), keys, first,
                   left, right, merged, added)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it does not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)


def _apart(p: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of positions of a pair of equal symbols, those that do not overlap, from
    the left."""
    out, blocked = [], -1
    for i in p.tolist():
        if i != blocked:
            out.append(i)
            blocked = int(nxt[i])
    return np.array(out, np.int64)


def encode_pretokens(pretokens: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens in one array, and the bounds of each."""
    sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(pretokens) + 1, np.int64)
    sym = v.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = sizes > 0
    nxt[ends[full] - 1] = -1
    prv[(ends - sizes)[full]] = -1

    index: dict[int, list[np.ndarray]] = {}       # rank of a pair -> its positions
    heap: list[int] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> None:
        live = ranks >= 0
        positions, ranks = positions[live], ranks[live]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        bounds = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, p in zip(ranks[np.concatenate([[0], bounds])].tolist(), np.split(positions, bounds)):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

    inner = np.flatnonzero(nxt >= 0)
    add(inner, v.rank(sym[inner], sym[inner + 1]))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        a, b, new = v.left[r], v.right[r], v.merged[r]
        p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        q = nxt[p]
        held = (sym[p] == a) & (q >= 0) & (sym[q] == b)
        p = p[held]
        if a == b and len(p):
            p = _apart(p, nxt)
        if not len(p):
            continue
        q = nxt[p]
        after = nxt[q]
        sym[p], sym[q], nxt[p] = new, -1, after
        tail = after >= 0
        prv[after[tail]] = p[tail]
        before = prv[p]
        before = before[before >= 0]
        at = np.concatenate([before, p[tail]])
        if len(at):
            add(at, v.rank(sym[at], sym[nxt[at]]))
    live = sym >= 0
    return sym[live], np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], ends])]


class Encoder:
    """Encodes Arrow columns; remembers a bounded number of pre-tokens."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        self.added = regex.compile("|".join(map(regex.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None

    def pretokens(self, text: str) -> list[bytes]:
        out, at = [], 0
        for m in (self.added.finditer(text) if self.added else ()):
            out += [x.encode() for x in _PRETOKENS.findall(text[at:m.start()])] + [m[0].encode()]
            at = m.end()
        return out + [x.encode() for x in _PRETOKENS.findall(text[at:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text."""
        data, offsets = buffer(texts)
        whole = data.tobytes()
        # Texts with wide spaces or added tokens are taken as one piece each.
        marks = [t.encode() for t in self.v.added]
        special = any(m in whole for m in marks) or _WIDE_SPACE.search(whole.decode("utf-8", "replace")) is not None
        if special:
            single = np.array([_WIDE_SPACE.search(t := whole[i:j].decode("utf-8", "replace")) is not None
                               or any(m.decode() in t for m in marks) for i, j in zip(offsets, offsets[1:])], bool)
        else:
            single = np.zeros(len(offsets) - 1, bool)
        codes, ranges, pieces = self._pieces(data, offsets, single)
        parts = [self.pretokens(t) for t in pieces.to_pylist()]
        unknown = list({x for part in parts for x in part if x not in self.known})
        added = {k.encode(): i for k, i in self.v.added.items()}
        flat, bounds = encode_pretokens([b"" if x in added else x for x in unknown], self.v)
        packed, bounds = flat.astype("<u4").tobytes(), (4 * bounds).tolist()
        new = {x: packed[bounds[i]:bounds[i + 1]] for i, x in enumerate(unknown)}
        new |= {x: np.array([added[x]], "<u4").tobytes() for x in unknown if x in added}
        known = self.known
        ids = [known[x] if x in known else new[x] for part in parts for x in part]
        for x in unknown[:max(0, MEMORY - len(known))]:
            known[x] = new[x]
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        return gather(np.frombuffer(b"".join(ids), "<u4"), sizes[at], codes, ranges)

    @staticmethod
    def _pieces(data, offsets, single):
        if not single.any():
            return chunks(data, offsets)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        first = space[data]
        first[1:] &= ~space[data[:-1]]
        first &= ~np.repeat(single, np.diff(offsets))
        starts, ranges = cut(data, offsets, first)
        coded = strings(data, starts).dictionary_encode()
        return coded.indices.to_numpy(), ranges, coded.dictionary


def gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[bounds[c]:bounds[c + 1]]`` over ``codes``; bounds of
    each document of ``ranges`` in the result."""
    size = (bounds[1:] - bounds[:-1])[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(bounds[codes] - ends[:-1], size) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
    return values[at], ends[ranges]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids`` (array<int>)."""
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = Encoder(v.value)
        for b in slices(batches, "text"):
            ids, ends = encoder.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])

    kind = slim.schema["id"].dataType.simpleString()
    return shared.ready(slim).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (by default all) and ``decoded``: the text of the ids,
    added tokens included; invalid UTF-8 becomes U+FFFD; null ids give ''."""
    v = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path).tokens)
    keep = encoded.columns if keep is None else keep
    own = encoded.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(ids_col).alias("ids"))

    def run(batches):
        sizes = np.fromiter(map(len, v.value), np.int64, len(v.value))
        bounds, letters = np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(v.value), np.uint8)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                lists = b.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                count = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
                text, ends = gather(letters, bounds, ids, np.concatenate([[0], np.cumsum(count)]))
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:])],
                                               pa.string())], ["row", "decoded"])

    done = shared.ready(own).mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, decoded string")
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep], "decoded")
