"""Hierarchical packing into sequences of several context sizes.

A document's token ids (with the end id) are cut into full windows of the longest
tier; what is left is routed to the smallest tier that holds it.  From the
longest tier down, a window takes one left-over, its gap is filled with whole
left-overs of shorter tiers (best fit) and, at last, with the head of one whose tail
goes back to its own tier.  Windows are filled exactly, so they need no padding;
left-overs that nothing can fill up are cut to shorter windows.  Only what is
shorter than the smallest tier at the end of a group is open.

Groups are consecutive documents of one partition (bounded by ``GROUP_TOKENS``
left-over tokens; what is open is carried to the partition's next group), so
packing needs no shuffle of texts or ids, and a hot source is just more groups.  The
open ends of many partitions meet in a second, small level that packs them the
same way.  The sequences of a group are dealt to steps of about ``STEP_TOKENS``,
longest first to the lightest step, which balances tokens and tiers.

Defined results: null and empty texts are the end id alone; each row is a document
of its own, also when ids repeat or are null; an empty table has no pieces; only the
named columns are read.
"""

from __future__ import annotations

import heapq
import unicodedata
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.bpe import gather
from scoutline.llm.words import buffer, mix, slices, strings, words

TIERS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 1 << 20
STEP_TOKENS = 1 << 17
MARKS = "!#$%&()*+,-./:;=?@[\\]^_`{}~\"<>|"      # ASCII punctuation without the apostrophe
JOIN_PARTITIONS = 256        # partitions whose open ends meet in one group of the second level
MEMORY = 32 << 20            # bytes of pieces and ids that a worker remembers between slices
TOGETHER = 200               # pieces of words in one call of the tokenizer


@dataclass
class Rest:
    """A span of one document that is still to be placed."""
    doc: int                 # position in the group's document list
    start: int
    ids: np.ndarray

    def head(self, n: int) -> tuple[Rest, Rest]:
        return Rest(self.doc, self.start, self.ids[:n]), Rest(self.doc, self.start + n, self.ids[n:])


@dataclass
class Packer:
    """Packs the left-overs of one group.  ``emit(tier, [Rest, ...])`` is called
    for every full window."""
    tiers: tuple[int, ...] = TIERS
    pools: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def tier_of(self, n: int) -> int:
        return self.tiers[bisect_left(self.tiers, n)]

    def pack(self, rests: list[Rest]) -> tuple[list[tuple[int, list[Rest]]], list[Rest]]:
        """(full windows as (tier, pieces), pieces that stay open)."""
        self.items, self.pools = list(rests), {t: [] for t in self.tiers}
        for i, r in enumerate(self.items):
            insort(self.pools[self.tier_of(len(r.ids))], (len(r.ids), i))
        windows = []
        for level in range(len(self.tiers) - 1, -1, -1):
            tier, pool = self.tiers[level], self.pools[self.tiers[level]]
            while pool:
                size, i = pool.pop()
                window, gap = [self.items[i]], tier - size
                while gap and (found := self._fit(level, gap)) is not None:
                    window.append(self.items[found])
                    gap -= len(self.items[found].ids)
                if gap and (found := self._any(level)) is not None:
                    head, tail = self.items[found].head(gap)
                    window.append(head)
                    self._back(tail)
                    gap = 0
                if not gap:
                    windows.append((tier, window))
                elif level:                       # nothing shorter is left: cut to a shorter window
                    self._spread(window, self.tiers[level - 1], windows)
                else:
                    return windows, window
        return windows, []

    def _fit(self, level: int, gap: int) -> int | None:
        """Take the longest left-over of shorter tiers (of this one in the
        smallest) that fits the gap."""
        for t in reversed(self.tiers[:max(level, 1)]):
            pool = self.pools[t]
            at = bisect_right(pool, (gap, 1 << 62))
            if at:
                return pool.pop(at - 1)[1]
        return None

    def _any(self, level: int) -> int | None:
        for t in reversed(self.tiers[:max(level, 1)]):
            if self.pools[t]:
                return self.pools[t].pop()[1]
        return None

    def _back(self, rest: Rest) -> None:
        self.items.append(rest)
        insort(self.pools[self.tier_of(len(rest.ids))], (len(rest.ids), len(self.items) - 1))

    def _spread(self, window: list[Rest], tier: int, windows: list) -> None:
        """Cut a window that cannot be filled to one of a shorter tier."""
        full, room = [], tier
        for r in window:
            if len(r.ids) <= room:
                if room:
                    full.append(r)
                    room -= len(r.ids)
                else:
                    self._back(r)
            elif room:
                head, tail = r.head(room)
                full.append(head)
                self._back(tail)
                room = 0
            else:
                self._back(r)
        if room:
            for r in full:
                self._back(r)
        else:
            windows.append((tier, full))


def steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step of each sequence: longest first, to the lightest step."""
    n = max(1, -(-sum(sizes) // step_tokens))
    loads, out = [(0, s) for s in range(n)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heapq.heappop(loads)
        out[i] = s
        heapq.heappush(loads, (load + sizes[i], s))
    return out


PIECES = ("start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "tier int, step bigint, open boolean")


class Group:
    """Collects documents, cuts full windows and packs the left-overs."""

    def __init__(self, first_id: int, tiers: tuple[int, ...], group_tokens: int, id_type: pa.DataType):
        self.next_sequence, self.next_step, self.tiers, self.limit = first_id, first_id, tiers, group_tokens
        self.id_type, self.tokens = id_type, 0
        self.docs: list[tuple] = []              # (id, tokens of the document)
        self.full: list[tuple[int, list[Rest]]] = []
        self.rests: list[Rest] = []

    def add(self, doc_id, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        longest, at = self.tiers[-1], 0
        self.docs.append((doc_id, len(ids) if doc_tokens is None else doc_tokens))
        doc = len(self.docs) - 1
        while len(ids) - at >= longest:
            self.full.append((longest, [Rest(doc, start + at, ids[at:at + longest])]))
            at += longest
        if at < len(ids):
            self.rests.append(Rest(doc, start + at, ids[at:].copy()))
        self.tokens += len(ids)

    def close(self, last: bool, keep_open: bool) -> pa.RecordBatch | None:
        """The pieces of all full windows.  What is open is carried on, or, at
        the last call, returned as open pieces or as one padded sequence."""
        windows, left = Packer(self.tiers).pack(self.rests)
        windows = self.full + windows
        if last and left and not keep_open:
            windows.append((self.tiers[-1], left))
        rows = []
        step = steps([sum(len(r.ids) for r in w) for _, w in windows])
        for (tier, window), s in zip(windows, step):
            offset = 0
            for r in window:
                rows.append((r, self.next_sequence, offset, tier, self.next_step + s, False))
                offset += len(r.ids)
            self.next_sequence += 1
        self.next_step += max(step, default=-1) + 1
        if last and left and keep_open:
            rows += [(r, None, None, None, None, True) for r in left]
        batch = self._batch(rows)
        kept = [self.docs[r.doc] for r in left]
        self.rests = [Rest(i, r.start, r.ids) for i, r in enumerate(left)]
        self.docs, self.full, self.tokens = kept, [], 0
        return batch

    def _batch(self, rows) -> pa.RecordBatch | None:
        if not rows:
            return None
        column = lambda values, kind: pa.array(list(values), kind)
        return pa.RecordBatch.from_arrays([
            column((self.docs[r[0].doc][0] for r in rows), self.id_type),
            column((r[0].start for r in rows), pa.int64()), column((len(r[0].ids) for r in rows), pa.int64()),
            column((r[0].ids.astype("<u4").tobytes() for r in rows), pa.binary()),
            column((self.docs[r[0].doc][1] for r in rows), pa.int64()),
            *[column((r[i] for r in rows), k) for i, k in
              ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int64()), (5, pa.bool_()))],
        ], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step", "open"])


_WORKER: dict = {}


class WordMemory:
    """Pieces of words and their ids in flat arrays, found by a 64-bit hash and compared in
    full.  What would exceed ``limit`` bytes starts the memory anew."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)      # by hash
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def hash(words: pa.Array) -> np.ndarray:
        data, offsets = buffer(words)
        if not len(data):
            return np.zeros(len(words), np.uint64)
        at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        mixed = np.append(mix((at.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1)), np.uint64(0))
        return np.where(np.diff(offsets) > 0, np.add.reduceat(mixed, offsets[:-1]), np.uint64(0))

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        place = self.places[at[hit]]
        same = pc.equal(words.take(pa.array(hit)), self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1)
        out[hit[same]] = place[same]
        return out

    def add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        if self.words.nbytes + words.nbytes + 24 * (len(self.words) + len(words)) + 4 * (len(self.ids) + len(ids)) > self.limit:
            self.clear()
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, order + len(self.words))
        self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.words = pa.concat_arrays([self.words, words])


class WordEncoder:
    """Ids by the tokenizers library for tokenizers whose pre-tokens never
    hold white space and which lower-case and part letters from marks: distinct
    words are encoded once and laid out by numpy."""

    def __init__(self, definition: str, memory: int = MEMORY):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer, self.memory = Tokenizer.from_str(definition), WordMemory(memory)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # An added token that parts texts wherever it stands; each part is encoded by itself.
        parts = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                 if t.special and not (t.single_word or t.lstrip or t.rstrip or t.normalized) and t.content.startswith("<|")]
        self.part = min(parts, default=None)

    @classmethod
    def of(cls, definition: str) -> WordEncoder:
        """One encoder for all tasks of a Python worker."""
        if _WORKER.get("definition") != definition:
            _WORKER.update(definition=definition, encoder=cls(definition))
        return _WORKER["encoder"]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, ranges, vocabulary = words(*buffer(texts))
        pieces, parts, part_ranges = split_words(vocabulary)
        memory, hashes = self.memory, WordMemory.hash(pieces)
        place = memory.find(pieces, hashes)
        fresh = np.flatnonzero(place < 0)
        place[fresh] = len(memory.words) + np.arange(len(fresh))
        new_pieces = pieces.take(pa.array(fresh))
        ids, bounds = self._pieces(new_pieces.to_pylist())
        per_word = gather(np.concatenate([memory.ids, ids]), np.concatenate([memory.bounds, bounds[1:] + len(memory.ids)]),
                          place[parts], part_ranges)
        memory.add(new_pieces, hashes[fresh], ids, bounds)
        return gather(*per_word, codes, ranges)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, bounds of each).  Many pieces go through the library as one text,
        parted by an added token; those that could hold one go alone."""
        alone = [i for i, x in enumerate(pieces) if self.part is None or "<|" in x]
        odd, found = set(alone), [np.zeros(0, np.uint32)] * len(pieces)
        for i, e in zip(alone, self.tokenizer.encode_batch([pieces[i] for i in alone], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        rest = [i for i in range(len(pieces)) if i not in odd]
        groups = [rest[i:i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        number, mark = self.part or (0, "")
        for at in range(0, len(groups), 100):
            some = groups[at:at + 100]
            joined = self.tokenizer.encode_batch_fast([mark.join(pieces[i] for i in g) for g in some],
                                                      add_special_tokens=False)
            for g, e in zip(some, joined):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == number)
                if len(cuts) != len(g) - 1:
                    raise ValueError("the tokenizer does not part texts at its added token")
                for i, lo, hi in zip(g, [0, *(cuts + 1)], [*cuts, len(ids)]):
                    found[i] = ids[lo:hi]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return np.concatenate([np.zeros(0, np.uint32), *found]), bounds


def split_words(vocabulary: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, pieces of all words, range of each word): a word as the letters and the
    marks after them, which are pre-tokens of their own; ASCII is lower-cased, as the
    tokenizer does (but what could become an added token stays as it is)."""
    added, plain = (f(vocabulary).to_numpy(zero_copy_only=False) for f in (
        lambda v: pc.match_substring(v, "<|"), pc.string_is_ascii))
    low = pc.if_else(pa.array(plain & ~added), pc.ascii_lower(vocabulary), vocabulary)
    head = pc.ascii_rtrim(low, characters=MARKS)
    letters = pc.ascii_is_alpha(head).to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(~plain & ~added)
    # Normalising must leave letters alone: a mark that it sets free would join the tail.
    letters[other] = [h.isalpha() and unicodedata.normalize("NFC", h).lower().isalpha()
                      for h in head.take(pa.array(other)).to_pylist()]
    letters &= ~added
    first = pc.if_else(pa.array(letters), head, low)
    data, offsets = buffer(low)
    cut = np.flatnonzero(letters & (np.diff(buffer(head)[1]) < np.diff(offsets)))
    starts = offsets[cut] + np.diff(buffer(head)[1])[cut]
    sizes = offsets[cut + 1] - starts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tails = strings(data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends[:-1])
    coded = pa.concat_arrays([first.cast(pa.large_string()), tails]).dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(vocabulary)
    counts = np.ones(n, np.int64)
    counts[cut] = 2
    ranges = np.concatenate([[0], np.cumsum(counts)])
    parts = np.empty(ranges[-1], np.int64)
    parts[ranges[:-1]] = codes[:n]
    parts[ranges[cut] + 1] = codes[n:]
    return coded.dictionary, parts, ranges


def pack_sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS,
                   group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``, ``tier``, ``step``.

    The tokenizer (a public JSON file read on the driver) must drop white space, as
    word-end BPE does; see :class:`WordEncoder`."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())     # a vocabulary file: fixed size
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches):
        encoder, group = WordEncoder.of(definition.value), None
        for b in slices(batches, "text"):
            if group is None:
                group = Group(TaskContext.get().partitionId() << 32, tiers, group_tokens, b.column("id").type)
            flat, ends = encoder.encode(b.column("text"))
            for i, doc_id in enumerate(b.column("id").to_pylist()):
                group.add(doc_id, np.append(flat[ends[i]:ends[i + 1]], np.uint32(end_id)))
                if group.tokens >= group.limit and (out := group.close(False, True)) is not None:
                    yield out
        if group is not None and (out := group.close(True, True)) is not None:
            yield out

    first = shared.table(shared.ready(slim).mapInArrow(run, f"id {kind}, {PIECES}")
                         .withColumn("part", F.spark_partition_id()), "packed")

    def join_ends(table: pa.Table) -> pa.Table:
        # Ids of this level lie above those of all partitions.
        table = table.sort_by([("part", "ascending"), ("id", "ascending"), ("start", "ascending")])
        group = Group((1 << 62) + (int(table.column("part")[0].as_py()) // JOIN_PARTITIONS << 32), tiers, group_tokens,
                      table.schema.field("id").type)
        for r in table.select(["id", "ids", "start", "doc_tokens"]).to_pylist():
            group.add(r["id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
        return pa.Table.from_batches([group.close(True, False)])

    second = (first.where("open").groupBy(F.floor(F.col("part") / JOIN_PARTITIONS))
              .applyInArrow(join_ends, f"id {kind}, {PIECES}"))
    return (first.where("NOT open").drop("part").unionByName(second).drop("open")
            .withColumnRenamed("id", id_col))
