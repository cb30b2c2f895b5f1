"""Membership filters of the stored index: right answers, untouched buckets
unread, broken runs settled."""

import os

import numpy as np
import pytest

from scoutline.sources import index as I
from scoutline.sources.membership import Members, bloom, may_hold


def rows(spark, ids, tag="a"):
    return spark.createDataFrame([(i, f"{tag}/{i}", "t") for i in ids], "doc_id string, path string, text string")


def ids_of(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).select("doc_id").collect())


def names(*ranges):
    return [f"d{i}" for r in ranges for i in r]


def test_filters_know_all_their_ids_and_few_others():
    r = np.random.default_rng(0)
    h = r.integers(-(1 << 62), 1 << 62, (4, 5_000))
    f = bloom(h[0], h[1])
    assert may_hold([f], h[0], h[1]).all() and may_hold([f], h[2], h[3]).mean() < 0.01
    assert not may_hold([], h[0], h[1]).any()
    assert may_hold([bloom(h[0][:0], h[1][:0]), f], h[0], h[1]).all()


def test_appends_skip_stored_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    assert I.write_index(rows(spark, names(range(50))), path, buckets=8) == 50
    assert I.write_index(rows(spark, names(range(30, 80)), "b"), path) == 30
    assert I.write_index(rows(spark, names(range(80)), "c"), path) == 0
    assert I.write_index(rows(spark, []), path) == 0
    assert ids_of(spark, path) == sorted(names(range(80)))
    assert I.read_index(spark, path).where("path LIKE 'b/%'").count() == 30
    assert I.read_index(spark, path).columns == ["doc_id", "path", "text"]


def files_read(df):
    """Paths that the scan of ``df`` selects."""
    scan = df._jdf.queryExecution().executedPlan().toString()
    return scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]


def test_untouched_buckets_are_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    I.write_index(rows(spark, names(range(400))), path, buckets=16)
    asked = []
    plain = Members.stored

    def stored(self, buckets, kind):
        out = plain(self, buckets, kind)
        asked.append(buckets)
        assert "_bucket" in files_read(out)
        return out

    monkeypatch.setattr(Members, "stored", stored)
    assert I.write_index(rows(spark, names(range(1_000, 1_300))), path) == 300
    assert len(asked) <= 1 and sum(map(len, asked)) <= 5          # new ids: only false positives are looked up
    asked.clear()
    assert I.write_index(rows(spark, ["d7", "d8"]), path) == 0
    assert len(asked) == 1 and len(asked[0]) <= 2                 # two stored ids: their buckets
    # Folders of other buckets may be gone: nothing reads them.
    root = f"{path}/_members/ids/_batch=0"
    for folder in os.listdir(root):
        if folder.startswith("_bucket=") and int(folder.split("=")[1]) not in asked[0]:
            for f in os.listdir(f"{root}/{folder}"):
                with open(f"{root}/{folder}/{f}", "wb") as out:
                    out.write(b"broken")
    monkeypatch.setattr(Members, "stored", plain)
    assert I.write_index(rows(spark, ["d7", "d8"]), path) == 0


@pytest.mark.parametrize("where", ["before the rows", "after the rows", "between the folders"])
def test_a_broken_run_is_settled(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "index")
    I.write_index(rows(spark, names(range(40))), path, buckets=4)
    commit, write = Members._commit, Members._write

    def broken(self, name, batch):
        if where == "between the folders":
            self._fs.mkdirs(self._path(f"{self.root}/ids"))
            assert self._fs.rename(self._path(f"{self.root}/{name}/ids"), self._path(f"{self.root}/ids/_batch={batch}"))
        raise OSError("lost")

    def lost(self, ids, to):
        write(self, ids, to)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((Members, "_write", lost) if where == "before the rows" else (Members, "_commit", broken)))
        with pytest.raises(OSError):
            I.write_index(rows(spark, names(range(30, 60)), "b"), path)
    assert Members._commit is commit
    added = I.write_index(rows(spark, names(range(30, 70)), "c"), path)
    assert added == (30 if where == "before the rows" else 10)
    assert ids_of(spark, path) == sorted(names(range(70)))


def test_an_index_without_filters_gets_them(spark, tmp_path):
    path = str(tmp_path / "index")
    rows(spark, names(range(20))).write.parquet(path)
    assert I.write_index(rows(spark, names(range(10, 30)), "b"), path) == 10
    assert ids_of(spark, path) == sorted(names(range(30)))
