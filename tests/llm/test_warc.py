"""WARC archives: round trip, equal files for equal input, rolling, commit, damage
and odd rows."""

import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest

from scoutline.llm import warc


def pages(spark, rows, parts=3):
    full = [(i, u, h, "x", b"y") for i, u, h in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string, key string, payload binary").repartition(parts)


def some_rows(n=120, seed=1):
    r = random.Random(seed)
    bodies = ["<p>" + "".join(r.choice("abcdé ") for _ in range(r.randrange(900, 1300))) for _ in range(15)]
    return [(i, f"https://h{r.randrange(9)}.example/{r.randrange(50)}", r.choice(bodies + ["", "short", None]))
            for i in range(n)]


def brute(rows, least=1000):
    body = [(h or "").encode() for _, _, h in rows]
    out = []
    for (i, _, _), b in zip(rows, body):
        last = max((j for (j, _, _), o in zip(rows, body) if o == b and j is not None), default=None)
        again = len(b) >= least and i != last
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read(spark, target):
    return sorted((tuple(r) for r in warc.read_warc(spark, target).select(*COLUMNS).collect()), key=str)


def files(target):
    path = target.removeprefix("file://")
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if f.endswith(".warc.gz")}


def write(df, tmp_path, name, **kw):
    target = f"file://{tmp_path}/{name}"
    return target, warc.write_warc(df, target, **kw)


def test_round_trip_and_equal_files_for_equal_input(spark, tmp_path):
    rows = some_rows()
    sizes = {"shard_bytes": 20_000, "roll_bytes": 4_000}
    one, listed = write(pages(spark, rows, 7), tmp_path, "one", **sizes)
    two, _ = write(pages(spark, rows[::-1], 2), tmp_path, "two", **sizes)
    assert read(spark, one) == brute(rows)
    assert files(one) == files(two) and len(files(one)) > 8
    assert {f.split("-")[2] for f in files(one)} >= {"00000.warc.gz", "00001.warc.gz"}          # rolled
    assert {r["file"]: r["sha256"] for r in listed.collect()} == {
        f: hashlib.sha256(b).hexdigest() for f, b in files(one).items()}
    assert not os.path.exists(f"{tmp_path}/one/_temporary")
    got = {r["page_id"]: (r["url"], r["payload"]) for r in warc.read_warc(spark, one).collect()}
    responses = {i for i, _, _, kind, _ in brute(rows) if kind == "response"}
    assert got == {i: (u, (h or "").encode() if i in responses else None) for i, u, h in rows}


def test_records_are_in_key_order_and_named_once(spark, tmp_path):
    target, _ = write(pages(spark, some_rows()), tmp_path, "a", shard_bytes=30_000)
    seen, ids, named, referred = [], [], set(), set()
    for body in files(target).values():
        for member in warc.members(pa.BufferReader(body)):
            headers, _ = warc.parse_record(member)
            ids.append(headers["warc-record-id"])
            if headers["warc-type"] == "warcinfo":
                continue
            seen.append((headers["warc-target-uri"], int(headers["scoutline-key"])))
            if headers["warc-type"] == "response":
                named.add(headers["warc-record-id"])
            else:
                referred.add(headers["warc-refers-to"])
        assert gzip.decompress(body).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert seen == sorted(seen) and len(ids) == len(set(ids))
    assert referred and referred <= named


def test_odd_rows(spark, tmp_path):
    big = "ü" * 600
    rows = [(None, None, None), (1, "", ""), (2, "http://a/ü b\r\nX: 1", "a\r\n\r\nb"), (3, "u" * 5_000, "x" * 300_000),
            (4, "u" * 5_000, "x" * 300_000), (None, "z", big), (5, "z", big), (7, "z", big), (7, "z", big), (7, "y", big)]
    target, _ = write(pages(spark, rows), tmp_path, "odd")
    got = read(spark, target)
    assert len(got) == len(rows)
    assert [x for x in got if x[0] not in (5, 7, None)] == [x for x in brute(rows) if x[0] not in (5, 7, None)]
    hot = [x for x in got if x[1] == 1200]
    assert sorted((str(x[0]), x[3], x[4]) for x in hot) == [
        ("5", "revisit", 7), ("7", "response", None), ("7", "revisit", 7), ("7", "revisit", 7), ("None", "revisit", 7)]
    urls = {r["page_id"]: r["url"] for r in warc.read_warc(spark, target).where("page_id IN (1, 2)").collect()}
    assert urls == {1: "about:blank", 2: "http://a/%C3%BC%20b%0D%0AX:%201"}
    nulls, _ = write(pages(spark, [(None, "n", big), (None, "m", big)]), tmp_path, "nulls")
    assert sorted(x[3] for x in read(spark, nulls)) == ["response", "revisit"]
    empty, listed = write(pages(spark, rows).limit(0), tmp_path, "none")
    assert listed.count() == 0 and read(spark, empty) == []


def test_copies_of_one_page_are_dealt_to_many_shards(spark, tmp_path):
    rows = [(i, "http://one", "c" * 2_000) for i in range(200)]
    target, listed = write(pages(spark, rows), tmp_path, "hot", shard_bytes=50_000)
    assert listed.count() > 5
    assert read(spark, target) == brute(rows)


def test_commit_accepts_files_moved_before_and_refuses_lost_ones(tmp_path):
    os.makedirs(f"{tmp_path}/_temporary")
    open(f"{tmp_path}/_temporary/t-a", "wb").write(b"abc")
    batch = pa.RecordBatch.from_pylist([{"file": "a", "temporary": "_temporary/t-a", "records": 1, "bytes": 3, "sha256": "s"}])
    for _ in range(2):                                  # the second attempt finds the file in place
        (out,) = warc._commit(f"file://{tmp_path}")([batch])
        assert out.column_names == ["file", "records", "bytes", "sha256"]
    assert open(f"{tmp_path}/a", "rb").read() == b"abc"
    os.remove(f"{tmp_path}/a")
    with pytest.raises(OSError):
        list(warc._commit(f"file://{tmp_path}")([batch]))


def test_an_attempt_that_was_lost_leaves_nothing(spark, tmp_path):
    os.makedirs(f"{tmp_path}/a/_temporary")
    open(f"{tmp_path}/a/_temporary/lost-part-000000-00000.warc.gz", "wb").write(b"half")
    rows = some_rows(20)
    target, _ = write(pages(spark, rows), tmp_path, "a")
    assert read(spark, target) == brute(rows) and "_temporary" not in os.listdir(f"{tmp_path}/a")


def test_damage_is_found():
    record = warc.response_record("<urn:x>", 1, "http://a", b"payload" * 300, warc.DATE)
    headers, block = warc.parse_record(record)
    assert warc.page_of(headers, block)["payload_bytes"] == 2100
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payloadpayload", b"paylo4dpayload", 1))
    with pytest.raises(ValueError):
        list(warc.members(pa.BufferReader(warc.gzip_member(record)[:-9])))
