"""Deterministic sharded WARC archives: writing and reading back.

Writing, over rows of (id, url, payload):

* One pass over the pages stores slim keys: url, id, payload digest (SHA-256) and size.  Of
  equal payloads of ``revisit_bytes`` or more the row with the largest id is the ``response``;
  the others are ``revisit`` records that refer to it.  Groups are reduced per part of the key
  table first and the answers go back through the parts, so a hot payload is never gathered.
* Records are put in order of (url, id, payload digest).  The slim keys are range-sorted,
  running byte offsets give every record its place, and places cut into equal ``shard_bytes``
  give the first key of every shard.  The shards are thus the same on every run, whatever
  the partitions of the input or the samples of the range sort.  Where whole rows repeat, the
  pages are stored with a row number that tells them apart, so that copies of one row
  are cut into shards too.
* A second pass packs every payload of ``revisit_bytes`` or more into the gzip member of its
  response record, which depends on nothing else, and sends it, packed and only once, to its
  shard: the cut keys (at most ``MAX_SHARDS``, urls cut to 256 characters) go to the tasks.
  The decisions on revisits travel beside, sorted before their payloads.
* A task writes a shard record by record, one gzip member each (those of revisits and short
  payloads, which are named after their place, are made here), and starts a new file
  when the compressed size reaches ``roll_bytes``.  Headers and digests are made anew from
  the payload; dates and ids are fixed by the input, so equal input gives equal files.
* Files are written under temporary names of their own attempt; the rows that a finished
  task returns list them.  The commit is a Spark job that moves the listed files to their
  names (a move done before is accepted) while it writes the manifest, whose ``_SUCCESS``
  marks the archive whole.  Files of lost attempts are in no list and are deleted.

Reading takes the files of the manifest, streams one record at a time, and verifies the block
digest of every record and the payload digest of every response.

Files are opened with ``pyarrow.fs``, so the folder may be any URI that it knows (shared
file systems, HDFS, S3, GCS).

Defined results: a null payload is empty; a null id is the smallest and is read back as
null; of repeated largest ids the greatest url and then any one is the response; an empty or
null url is written as ``about:blank``; characters that a header cannot hold are
percent-encoded in urls; an empty table gives an archive without files; only the named
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline.llm import shared

SHARD_BYTES, ROLL_BYTES = 16 << 20, 64 << 20
MAX_SHARDS = 65_536
URL_KEY = 256              # characters of the url in a sort key
RECORD_OVERHEAD = 600      # bytes of headers counted for a record
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("5b0ba6c1-4c5a-5c66-9d3c-0f3c9e0b7a11")      # name space of the record ids
_HEADER_SAFE = "".join(map(chr, range(33, 127))).replace("%", "")
KEYS = ["u", "id", "digest", "row"]      # sort order of the records, nulls first


# --- records -----------------------------------------------------------------

def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers if v is not None],
             f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return quote(url, safe=_HEADER_SAFE + "%") if url else "about:blank"


def _name(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, text)}>"


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def _page_headers(name: str, key, url, payload_digest: str, date: str) -> list[tuple[str, str | None]]:
    return [("WARC-Record-ID", name), ("WARC-Target-URI", _uri(url)), ("WARC-Date", date),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", payload_digest),
            ("Scoutline-Key", _key_text(key))]


def _key_text(key) -> str | None:
    return None if key is None else quote(str(key), safe=_HEADER_SAFE)


def response_record(name: str, key, url, payload: bytes, date: str) -> bytes:
    return _record("response", _page_headers(name, key, url, _digest(payload), date), _http(len(payload)) + payload)


def revisit_record(name: str, row: dict, refers: dict, date: str) -> bytes:
    """A record without payload that refers to the response with ``refers`` (id and url)."""
    return _record("revisit", [
        *_page_headers(name, row["id"], row["url"], row["payload_digest"], date), ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", payload_name(row["digest"])), ("WARC-Refers-To-Target-URI", _uri(refers["url"])),
        ("WARC-Refers-To-Date", date), ("Scoutline-Refers-To-Key", _key_text(refers["id"]))], _http(row["n_bytes"]))


def payload_name(digest: str) -> str:
    """Id of the one response that holds a payload of ``revisit_bytes`` or more."""
    return _name(f"payload:{digest}")


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """(lower-case headers, block) of one record; its block digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    if rest[len(block):] != b"\r\n\r\n" or _digest(block) != headers["warc-block-digest"]:
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def page_of(headers: dict, block: bytes) -> dict:
    """The row of a response or revisit record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [int(v) for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")) if k == "Content-Length"]
    kind = headers["warc-type"]
    if kind == "response" and (_digest(payload) != headers["warc-payload-digest"] or lengths != [len(payload)]):
        raise ValueError(f"damaged payload {headers['warc-record-id']}")
    key = lambda name: None if name not in headers else unquote(headers[name])
    return {"key": key("scoutline-key"), "url": headers["warc-target-uri"], "payload_bytes": lengths[0],
            "payload_digest": base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "record_type": kind, "refers_to": key("scoutline-refers-to-key"),
            "record_id": headers["warc-record-id"], "payload": payload if kind == "response" else None}


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, chunk = zlib.decompressobj(31), [], b""
    while chunk := chunk or stream.read(1 << 16):
        parts.append(unpack.decompress(chunk))
        chunk = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last gzip member is cut off")


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)         # no time in the header
    return pack.compress(data) + pack.flush()


# --- files -------------------------------------------------------------------

MANIFEST = "file string, temporary string, records bigint, bytes bigint, sha256 string"


class ShardFiles:
    """The files of one shard, rolled by compressed size, under temporary names."""

    def __init__(self, root: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.date, self.number, self.out, self.done = shard, roll_bytes, date, 0, None, []

    def add(self, row: dict, refers: dict | None, revisit_bytes: int) -> None:
        if self.out is None:
            self._open()
        place = _name(f"{self.file}:{self.records}")
        if refers is not None:
            self._write(gzip_member(revisit_record(place, row, refers, self.date)))
        elif row["n_bytes"] < revisit_bytes:
            self._write(gzip_member(response_record(place, row["id"], row["url"], row["body"], self.date)))
        else:
            self._write(row["body"])
        if self.bytes >= self.roll_bytes:
            self.close()

    def _open(self) -> None:
        self.file = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.file}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.records, self.bytes, self.hash = 0, 0, hashlib.sha256()
        info = [("WARC-Record-ID", _name(self.file)), ("WARC-Date", self.date), ("WARC-Filename", self.file),
                ("Content-Type", "application/warc-fields")]
        self._write(gzip_member(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))

    def _write(self, packed: bytes) -> None:
        self.out.write(packed)
        self.hash.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.file, self.temporary, self.records, self.bytes, self.hash.hexdigest()))
            self.out, self.number = None, self.number + 1


PACKED = "id {kind}, url string, row bigint, n_bytes bigint, digest string, payload_digest string, body binary"


def _pack(revisit_bytes: int, date: str):
    """Digests of every payload, and the packed response record of those that may have revisits."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = [[], [], [], []]
                for key, url, payload in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload"))):
                    digest, body = hashlib.sha256(payload).hexdigest(), payload
                    if len(payload) >= revisit_bytes:
                        body = gzip_member(response_record(payload_name(digest), key, url, payload, date))
                    for column, value in zip(columns, (len(payload), digest, _digest(payload), body)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*part.select(["id", "url", "row"]).columns, *(pa.array(c, t) for c, t in zip(
                        columns, (pa.int64(), pa.string(), pa.string(), pa.binary())))],
                    ["id", "url", "row", "n_bytes", "digest", "payload_digest", "body"])
    return run


def _write_shards(root: str, roll_bytes: int, revisit_bytes: int, date: str):
    def run(batches):
        files, note, names = None, None, ["file", "temporary", "records", "bytes", "sha256"]

        def listed(f):
            f.close()
            return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*f.done)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if files is None or files.shard != row["shard"]:
                    if files is not None:
                        yield listed(files)
                    files = ShardFiles(root, row["shard"], roll_bytes, date)
                if row["kind"] == 0:                  # the decision that comes before its payload
                    note = row
                else:
                    own = note is not None and all(note[k] == row[k] for k in KEYS)
                    files.add(row, note["refers"] if own else None, revisit_bytes)
        if files is not None:
            yield listed(files)
    return run


def _commit(root: str):
    def run(batches):
        store, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{path}/{row['file']}"
                try:
                    store.move(f"{path}/{row['temporary']}", final)
                except OSError:                        # moved by an earlier attempt of this task
                    info = store.get_file_info(final)
                    if not info.is_file or info.size != row["bytes"]:
                        raise
            yield batch.drop_columns(["temporary"])
    return run


# --- Spark -------------------------------------------------------------------

def _keys(pages: DataFrame) -> DataFrame:
    """The sorted slim keys as a stored table; ``part`` numbers its sorted parts."""
    slim = pages.select(F.substring("url", 1, URL_KEY).alias("u"), "id", F.sha2("payload", 256).alias("digest"), "row",
                        "url", F.octet_length("payload").cast("bigint").alias("n_bytes"))
    return shared.table(slim.repartitionByRange(shared.partitions(pages.sparkSession), *KEYS)
                        .withColumn("part", F.spark_partition_id()), "keys")


def _revisits(keys: DataFrame, revisit_bytes: int) -> DataFrame:
    """Key and ``refers`` (id and url of the response) of all revisit records."""
    large = keys.where(F.col("n_bytes") >= revisit_bytes).select("part", *KEYS, "url")
    level0 = large.groupBy("part", "digest").agg(F.count("*").alias("n"),
                                                 F.max(F.struct("id", "url", "row")).alias("best"))
    top = level0.groupBy("digest").agg(F.sum("n").alias("n"), F.max("best").alias("best")).where("n > 1")
    answers = level0.select("part", "digest").join(top.select("digest", "best"), "digest")
    own = F.struct("id", "url", "row").eqNullSafe(F.col("best"))
    return large.join(answers, ["part", "digest"]).where(~own).select(
        *KEYS, F.struct(F.col("best.id").alias("id"), F.col("best.url").alias("url")).alias("refers"))


def _cuts(keys: DataFrame, shard_bytes: int) -> tuple[list[tuple[tuple, int]], bool]:
    """First key and number of every shard, in order, and whether keys repeat."""
    spark, size = keys.sparkSession, F.col("n_bytes") + F.octet_length("url") + RECORD_OVERHEAD
    parts = sorted(tuple(r) for r in keys.groupBy("part").agg(F.sum(size)).collect())        # one per partition
    if not parts:
        return [], False
    shard_bytes = max(shard_bytes, -(-sum(n for _, n in parts) // MAX_SHARDS))
    bases, base = [], 0
    for part, n in parts:
        bases.append((part, base))
        base += n
    order = Window.partitionBy("part").orderBy(*KEYS)       # equal keys are in one part
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keys.withColumns({"before": before, "again": F.lag(F.struct(*KEYS)).over(order).eqNullSafe(F.struct(*KEYS))})
    first = (placed.join(F.broadcast(spark.createDataFrame(bases, "part int, base bigint")), "part")
             .groupBy(F.floor((F.col("base") + F.col("before")) / shard_bytes).alias("shard"))
             .agg(F.min(F.struct(*KEYS)).alias("key"), F.max("again").alias("again")).collect())   # at most MAX_SHARDS
    return sorted((_key(*r["key"]), int(r["shard"])) for r in first), any(r["again"] for r in first)


def _key(u, i, digest, row) -> tuple:
    return u, i is not None, i if i is not None else 0, digest, row


def write_warc(pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = 1000,
               date: str = DATE) -> DataFrame:
    """Write ``pages`` as WARC files into the new folder ``target`` (a URI that all tasks reach) and
    return its manifest: ``file``, ``records``, ``bytes``, ``sha256``."""
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = slim.withColumn("row", F.lit(0).cast("bigint"))
    keys = _keys(rows)
    cuts, repeated = _cuts(keys, shard_bytes)
    if repeated:
        rows = shared.table(slim.withColumn("row", F.monotonically_increasing_id()), "pages")
        keys = _keys(rows)
        cuts, _ = _cuts(keys, shard_bytes)
    held = spark.sparkContext.broadcast(([k for k, _ in cuts], [s for _, s in cuts]))

    @F.arrow_udf("int")
    def shard(u: pa.Array, i: pa.Array, digest: pa.Array, row: pa.Array) -> pa.Array:
        firsts, numbers = held.value
        found = zip(*(c.to_pylist() for c in (u, i, digest, row)))
        return pa.array([numbers[bisect_right(firsts, _key(*r)) - 1] for r in found], pa.int32())

    schema = PACKED.format(kind=dict(slim.dtypes)["id"])
    packed = shared.ready(rows).mapInArrow(_pack(revisit_bytes, date), schema)
    records = packed.withColumns({"u": F.substring("url", 1, URL_KEY), "kind": F.lit(1)}).unionByName(
        _revisits(keys, revisit_bytes).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # A task writes one shard or, of very many, every n-th.
    n = max(1, min(len(cuts), 16 * shared.partitions(spark)))
    sorted_shards = (records.withColumn("shard", shard(*KEYS)).repartitionById(n, F.pmod("shard", F.lit(n)))
                     .sortWithinPartitions("shard", *KEYS, "kind"))
    written = shared.table(sorted_shards.mapInArrow(_write_shards(target, roll_bytes, revisit_bytes, date), MANIFEST),
                           "warc-files")
    done = "file string, records bigint, bytes bigint, sha256 string"
    written.mapInArrow(_commit(target), done).write.parquet(f"{target}/_manifest")
    temporary = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_temporary")
    temporary.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(temporary, True)
    return spark.read.schema(done).parquet(f"{target}/_manifest")


def read_warc(spark: SparkSession, target: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """One row per response and revisit record of the archive at ``target``: ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest`` (hex SHA-1), ``record_type``, ``refers_to``, ``record_id``,
    ``payload`` (binary; null for revisits and without ``payloads``)."""
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary()]

    def run(batches):
        store, path = fs.FileSystem.from_uri(target)
        schema = pa.schema(list(zip(names, types)))
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{path}/{entry['file']}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse_record(data)
                        n += 1
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        row = page_of(headers, block)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if n != entry["records"]:
                    raise ValueError(f"{entry['file']} holds {n} records, the manifest says {entry['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.parquet(f"{target}/_manifest").repartition(4 * shared.partitions(spark))
    found = shared.ready(files).mapInArrow(run, "key string, url string, payload_bytes bigint, payload_digest string, "
                                                "record_type string, refers_to string, record_id string, payload binary")
    return found.select(F.col("key").cast(id_type).alias("page_id"), "url", "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "record_id", "payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
m AS (SELECT t, max(page_id) AS last FROM p GROUP BY t)
SELECT page_id, strlen(p.t) AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN strlen(p.t) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p.t) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p JOIN m ON p.t = m.t
"""
