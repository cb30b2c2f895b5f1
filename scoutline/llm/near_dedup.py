"""Near-duplicate documents by Order MinHash over five-word shingles.

* Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a k-mer is
  five consecutive words (a shorter text is one k-mer), labelled with its number of
  earlier occurrences, so all labelled k-mers of a text differ.
* Texts with the same words form a class; only its smallest id goes on.
* Order MinHash: each of ``SKETCHES`` hash functions picks the ``PICKED`` labelled
  k-mers with the smallest hashes and keeps them *in text order*; the hash of that
  tuple is a bucket.  Two texts that agree in a share J of their k-mers, in
  order, meet in one bucket with probability about J ** PICKED, so at 0.8 all
  ``SKETCHES`` miss with probability (1 - 0.8 ** 4) ** 32 < 1e-7.  Short texts meet less
  often (10 k-mers together, 8 shared: 0.33, all miss with 2e-6).  The worst case, 5
  k-mers of which another text has 4, is settled: a text with ``PICKED`` + 1 k-mers
  leaves out each k-mer once in its first functions.
* Similarity of two texts: k-mers aligned in order by the best banded alignment,
  over all their k-mers (aligned / (n1 + n2 - aligned)).  At 0.8 or more at most a
  ninth of the k-mers is unaligned, so no alignment leaves that band.  Labelled
  k-mers are unique in a text, so the alignment is a longest increasing subsequence of
  the matches inside the band.
* A bucket is not expanded into pairs.  First, every member is aligned with
  its bucket's smallest id; verified links give components.  Buckets that still hold
  members of different components are then searched completely inside tasks: the
  members outside the largest component meet all members, block by block.  A
  comparison of sketches leaves the memberships whose partner has another group and a
  length that allows the similarity, each pair in the first bucket it shares; for
  those, shared k-mers are counted exactly and pairs that share enough are aligned.
  Only links that connect come out.

Hot buckets are split: the first round sends each member once, in salted parts next to a
copy of the smallest id's text; the second cuts a bucket into blocks and compares
pairs of blocks.  Links, components and sketches stay distributed.

Defined results: a null or empty text, or one without words, is its own class
and group; equal word sequences are one group; rows of one id with equal words are one
document, its other texts are documents of their own, ordered by id and digest (the
results name ids, so two groups may carry one id; ``kept`` is per row); null ids are
left out of the search and come back with null group and ``kept`` true; an empty
table gives an empty result; texts of any length are sketched and aligned whole; only the named columns
are read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm import shared
from scoutline.llm.words import FOLD, buffer, mix, owner, slices, windows, words

K = 5
SKETCHES = 32
PICKED = 4
SIMILARITY = 0.8
HUB_MEMBERS = 2000        # members verified in one salted part of a hub
BLOCK = 1 << 20           # k-mers of one block of a bucket, each member counting ROW_WEIGHT more
ROW_WEIGHT = 64
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- k-mers and sketches of a slice ---------------------------------------

def kmers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(labelled k-mer hashes in text order, ranges per text, word digests)."""
    data, offsets = buffer(texts)
    codes, ranges, vocabulary = words(FOLD[data], offsets)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    hashes = own[codes] if len(codes) else np.zeros(0, np.uint64)
    digests = [xxhash.xxh3_128_digest(hashes[i:j].tobytes()) for i, j in zip(ranges, ranges[1:])]
    shingles, _, spans = windows(hashes, ranges, K)
    size = np.diff(ranges)
    short = np.flatnonzero((size > 0) & (size < K))
    if len(short):
        one = np.array([xxhash.xxh3_64_intdigest(digests[d]) for d in short], np.uint64)
        shingles = np.insert(shingles, spans[short], one)
        spans = spans + np.concatenate([[0], np.cumsum(np.bincount(short, minlength=len(size)))])
    return label(shingles, spans), spans, digests


def label(shingles: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Mix each shingle with its number of earlier occurrences in its text."""
    doc = owner(spans)
    key = shingles ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    place = np.arange(len(order))
    occurrence = np.zeros(len(order), np.uint64)
    occurrence[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
    return mix(shingles + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketches(labelled: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Order MinHash of each text: texts x SKETCHES; all zero without k-mers."""
    out = np.zeros((len(spans) - 1, SKETCHES), np.uint64)
    sizes = np.diff(spans)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts, size = spans[full], sizes[full]
    for s in range(SKETCHES):
        seed = np.uint64(((s + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = labelled ^ seed
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        picked = np.full((len(full), PICKED), np.iinfo(np.int64).max)
        for i in range(PICKED):
            least = np.minimum.reduceat(x, starts)
            at = np.flatnonzero(x == np.repeat(least, size))
            of = np.searchsorted(starts, at, side="right") - 1
            of, first = np.unique(of, return_index=True)
            live = size > i                          # texts with fewer k-mers pick all
            picked[of[live[of]], i] = at[first][live[of]]
            x[at[first]] = LARGEST
        picked.sort(axis=1)                          # text order
        if s <= PICKED:
            one_more = np.flatnonzero(size == PICKED + 1)
            picked[one_more] = starts[one_more, None] + np.delete(np.arange(PICKED + 1), s)
        total = np.full(len(full), seed)
        for i in range(PICKED):
            here = picked[:, i] < len(labelled)
            value = np.where(here, labelled[np.minimum(picked[:, i], len(labelled) - 1)], np.uint64(0))
            total = mix(total * np.uint64(0x100000001B3) + value)
        out[full, s] = total
    return out


# --- alignment -------------------------------------------------------------

def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """K-mers aligned in order inside the band that similarity 0.8 allows."""
    band = int((len(a) + len(b)) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for v in j.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0                                   # lengths alone rule it out
    n = aligned(a, b)
    return n / (len(a) + len(b) - n)


# --- Spark jobs ------------------------------------------------------------

def text_key(text: Column) -> Column:
    """What tells the texts of a repeated id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def _sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key, word digest, number of k-mers and packed sketch of every row."""
    slim = _texts(docs, id_col, text_col)

    def run(batches):
        for b in slices(batches, "text"):
            labelled, spans, digests = kmers(b.column("text"))
            rows = sketches(labelled, spans)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("key"), pa.array(digests, pa.binary()), pa.array(np.diff(spans), pa.int64()),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["doc", "key", "digest", "n", "sketch"])

    return shared.ready(slim).mapInArrow(run, f"doc {_kind(slim, 'doc')}, key binary, digest binary, n bigint, sketch binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id) for every class and hash function."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 20_000):
                part = b.slice(i, 20_000)
                rows = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), SKETCHES)))],
                    ["bucket", "id"])

    return classes.select("id", "sketch").mapInArrow(run, f"bucket bigint, id {_kind(classes)}")


def _kind(df: DataFrame, name: str = "id") -> str:
    return df.schema[name].dataType.simpleString()


def verify(pairs: DataFrame, heads: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (hub, id) whose texts are similar.  ``heads``: (id, doc, key, digest) of
    the classes' texts.  A hub's text is sent once for each ``HUB_MEMBERS`` of its
    partners; the partners stream past it.  The texts are shuffled once."""
    kind = _kind(pairs)
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("parts"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
                        F.col("hub").alias("id"), F.lit(False).alias("member"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id",
                                              F.lit(True).alias("member"))
    rows = hubs.unionByName(members).join(heads, "id").join(_texts(docs, id_col, text_col), ["doc", "key"]).drop("doc", "key")

    def run(batches):
        hub, own = None, None
        for b in slices(batches, "text"):
            labelled, spans, digests = kmers(b.column("text"))
            found = []
            for i, (h, doc, member, digest) in enumerate(zip(*(b.column(c).to_pylist() for c in (
                    "hub", "id", "member", "digest")))):
                if digests[i] != digest:             # another text of the same key
                    continue
                row = labelled[spans[i]:spans[i + 1]]
                if not member:
                    hub, own = h, row.copy()
                elif h == hub and similarity(own, row) >= SIMILARITY:
                    found.append((h, doc))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], b.column(c).type)
                                              for i, c in enumerate(("hub", "id"))], ["hub", "id"])

    return (rows.repartition(shared.partitions(docs.sparkSession), "hub", "part")
            .sortWithinPartitions("hub", "part", "member")
            .mapInArrow(run, f"hub {kind}, id {kind}"))


def components(links: DataFrame) -> DataFrame:
    """(id, group) for every id in ``links`` (hub, id): the smallest id that it
    is connected with.  Each round takes the smallest label around and then the
    label's own label, so long chains shrink fast."""
    both = shared.table(links.select(F.col("hub").alias("a"), F.col("id").alias("b")).union(
        links.select(F.col("id").alias("a"), F.col("hub").alias("b"))).distinct(), "links")
    labels = shared.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("group")), "labels")
    while True:
        around = (both.join(labels.select(F.col("id").alias("b"), "group"), "b")
                  .groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near")))
        nearest = labels.join(around, "id").select("id", F.col("group").alias("old"), F.least("group", "near").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("group").alias("far"))
        new = shared.table(nearest.join(jump, "near").select("id", "old", F.least("near", "far").alias("group")), "labels")
        changed = new.where("`group` <> old").limit(1).count()
        labels = new.select("id", "group")
        if not changed:
            return labels


def _mixed_blocks(buckets: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Memberships of the buckets that hold several groups, dealt to blocks.

    Members outside a bucket's largest group (``few``) meet all its members, block by
    block: (bucket, x, y) pairs block x of the few with block y of all."""
    held = (buckets.join(classes.select("id", "n"), "id").join(groups, "id", "left")
            .withColumn("group", F.coalesce("group", "id")).withColumn("size", F.col("n") + ROW_WEIGHT))
    counts = held.groupBy("bucket", "group").agg(F.sum("size").alias("m"))
    mixed = (counts.groupBy("bucket").agg(F.max(F.struct("m", "group")).alias("top"), F.sum("m").alias("size"))
             .where("size > top.m")
             .select("bucket", F.col("top.group").alias("main"), F.ceil((F.col("size") - F.col("top.m")) / BLOCK).alias("few"),
                     F.ceil(F.col("size") / BLOCK).alias("many")))
    rows = held.join(mixed, "bucket").withColumn("h", F.xxhash64("id"))
    blocks = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    few = rows.where("`group` <> main").select("bucket", F.pmod("h", "few").alias("x"), blocks("many").alias("y"),
                                               F.lit(True).alias("few"), "id", "group")
    many = rows.select("bucket", blocks("few").alias("x"), F.pmod("h", "many").alias("y"),
                       F.lit(False).alias("few"), "id", "group")
    return few.unionByName(many)


def _by_block(rows: DataFrame, payload: str, work, schema: str) -> DataFrame:
    """Run ``work(bucket, ids, groups, few, payloads)`` on every (bucket, x, y);
    it returns a record batch.  One block is held at a time."""
    def run(batches):
        block, now, like = [], None, None
        for b in batches:
            like = b.column("id").type
            for *key, doc, g, few, data in zip(*(b.column(c).to_pylist() for c in (
                    "bucket", "x", "y", "id", "group", "few", payload))):
                if key != now and block:
                    yield work(now, block, like)
                    block = []
                now = key
                block.append((doc, g, few, data))
        if block:
            yield work(now, block, like)

    return (rows.repartition(shared.partitions(rows.sparkSession), "bucket", "x", "y")
            .sortWithinPartitions("bucket", "x", "y").mapInArrow(run, schema))


def _sides(block):
    few = np.array([r[2] for r in block], bool)
    number: dict = {}
    group = np.array([number.setdefault(r[1], len(number)) for r in block])
    return np.flatnonzero(few), np.flatnonzero(~few), group


def _likely(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The memberships with a possible partner in their block: one of another
    group and of a length that allows it, whose sketch agrees in no earlier function
    than this bucket's (so a pair counts in one bucket)."""
    def work(key, block, like):
        sketch = np.frombuffer(b"".join(r[3]["sketch"] for r in block), np.int64).reshape(-1, SKETCHES)
        n = np.array([r[3]["n"] for r in block])
        few, many, group = _sides(block)
        hit = np.zeros(len(block), bool)
        for i in few:
            at = many[(group[many] != group[i]) & (n[many] >= SIMILARITY * n[i]) & (n[i] >= SIMILARITY * n[many])]
            equal = sketch[at] == sketch[i]
            found = at[equal.any(axis=1) & (sketch[i][equal.argmax(axis=1)] == key[0])]
            hit[found] = True
            hit[i] |= len(found) > 0
        own = [block[i] for i in np.flatnonzero(hit)]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([k] * len(own), pa.int64()) for k in key], pa.array([r[2] for r in own], pa.bool_()),
             pa.array([r[0] for r in own], like), pa.array([r[1] for r in own], like)],
            ["bucket", "x", "y", "few", "id", "group"])

    kind = _kind(rows)
    return _by_block(rows.join(classes.select("id", F.struct("sketch", "n").alias("own")), "id"), "own", work,
                     f"bucket bigint, x bigint, y bigint, few boolean, id {kind}, group {kind}")


def links_of_block(kmers_: list[np.ndarray], few: np.ndarray, many: np.ndarray, group: np.ndarray):
    """Links (i, j) between members of different groups, enough to connect all
    that are similar.  Shared k-mers are counted through one sorted list of
    the block's k-mers; only pairs that share enough of them are aligned."""
    sizes = np.array([len(k) for k in kmers_])
    flat = np.concatenate([kmers_[i] for i in many])
    whose = np.repeat(np.arange(len(many)), sizes[many])
    order = np.argsort(flat)
    flat, whose = flat[order], whose[order]
    parent = {g: g for g in set(group.tolist())}

    def root(g):
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    for i in few:
        lo, hi = np.searchsorted(flat, kmers_[i]), np.searchsorted(flat, kmers_[i], side="right")
        n = hi - lo
        ends = np.cumsum(n)
        at = np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        common = np.bincount(whose[at], minlength=len(many))
        for j in many[common >= SIMILARITY * (sizes[many] + sizes[i] - common)]:
            a, b = root(int(group[i])), root(int(group[j]))
            if a != b and similarity(kmers_[i], kmers_[j]) >= SIMILARITY:
                parent[a] = b
                yield i, j


def _settle(rows: DataFrame, heads: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (hub, id) inside the blocks of ``rows``.  The texts are shuffled once;
    a document's k-mers are computed once and sent to each of its blocks."""
    kind = _kind(rows)
    places = rows.groupBy("id").agg(F.collect_list(F.struct("bucket", "x", "y", "few", "group")).alias("places"))

    def spread(batches):
        for b in slices(batches, "text"):
            labelled, spans, digests = kmers(b.column("text"))
            ids = b.column("id")
            for i, (digest, places_) in enumerate(zip(b.column("digest").to_pylist(), b.column("places").to_pylist())):
                if digests[i] != digest:
                    continue
                own = labelled[spans[i]:spans[i + 1]].tobytes()
                step = max(1, (8 << 20) // max(1, len(own)))
                for k in range(0, len(places_), step):
                    some = places_[k:k + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[c] for p in some], t) for c, t in (
                            ("bucket", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("few", pa.bool_()),
                            ("group", ids.type))]
                        + [pa.array([ids[i].as_py()] * len(some), ids.type), pa.array([own] * len(some), pa.binary())],
                        ["bucket", "x", "y", "few", "group", "id", "kmers"])

    def work(key, block, like):
        few, many, group = _sides(block)
        rows_ = [np.frombuffer(r[3], np.uint64) for r in block]
        found = []
        if len(few) and len(many):
            found = [sorted((block[i][0], block[j][0])) for i, j in links_of_block(rows_, few, many, group)]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], like) for i in (0, 1)], ["hub", "id"])

    spread_out = places.join(heads, "id").join(_texts(docs, id_col, text_col), ["doc", "key"]).drop("doc", "key").mapInArrow(
        spread, f"bucket bigint, x bigint, y bigint, few boolean, group {kind}, id {kind}, kmers binary")
    return _by_block(spread_out, "kmers", work, f"hub {kind}, id {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``text_class`` (smallest id with the same words),
    ``group_id`` (smallest id of its near-duplicate group) and ``kept``."""
    return near_documents(docs, id_col, text_col).drop("text_key")


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`near_duplicates` with the :func:`text_key` of each row."""
    rows = shared.table(_sketch_table(docs, id_col, text_col), "sketches")
    known = rows.where("doc IS NOT NULL")
    # A document is one id and word digest, numbered in their order; the sketch of equal words is equal.
    order = ["doc", "digest"]
    ids = shared.table(known.groupBy(*order).agg(F.min("key").alias("key"), F.first("n").alias("n"))
                       .repartitionByRange(shared.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
                       .withColumn("id", F.monotonically_increasing_id()), "numbers")
    ids = ids.withColumn("alone", F.when(F.col("n") == 0, F.col("id")))
    firsts = ids.groupBy("digest", "alone").agg(F.min(F.struct("id", "doc")).alias("first"))
    members = shared.table(ids.join(firsts.select(F.col("digest").alias("d"), F.col("alone").alias("a"), "first"),
                                    (F.col("digest") == F.col("d")) & F.col("alone").eqNullSafe(F.col("a")))
                           .select("id", "doc", "key", "digest", "n", F.col("first.id").alias("text_class"),
                                   F.col("first.doc").alias("class_doc")), "classes")
    heads = members.where("id = text_class AND n > 0").select("id", "doc", "key", "digest")
    classes = shared.table(known.join(heads, ["doc", "key", "digest"]).dropDuplicates(["id"]).select("id", "n", "sketch"), "class-sketches")
    buckets = _buckets(classes)
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    shared_buckets = shared.table(buckets.join(hubs.drop("size"), "bucket"), "buckets")
    first = shared.table(verify(shared_buckets.where("id <> hub").select("hub", "id").distinct(), heads, docs, id_col, text_col), "links")
    groups = components(first)
    rest = shared.table(_likely(_mixed_blocks(shared_buckets.select("bucket", "id"), groups, classes), classes), "unresolved")
    if rest.limit(1).count():
        more = shared.table(_settle(rest, heads, docs, id_col, text_col), "more-links")
        if more.limit(1).count():
            groups = components(first.unionByName(more))
    groups = groups.join(members.select(F.col("id").alias("group"), F.col("doc").alias("group_doc")), "group")
    named = members.join(groups.withColumnRenamed("id", "text_class"), "text_class", "left").select(
        "doc", "digest", "class_doc", F.coalesce("group_doc", "class_doc").alias("group_doc"),
        (F.col("id") == F.coalesce("group", "text_class")).alias("kept"))
    own = rows.select(F.col("doc").alias("row_id"), F.col("digest").alias("row_digest"), "key")
    return own.join(named, (F.col("row_id") == F.col("doc")) & (F.col("row_digest") == F.col("digest")), "left").select(
        F.col("row_id").alias(id_col), F.col("key").alias("text_key"), F.col("class_doc").alias("text_class"),
        F.col("group_doc").alias("group_id"), F.coalesce("kept", F.lit(True)).alias("kept"))
