"""The default embedder: equal to a plain computation, its tokens hashed once per batch."""

import hashlib
import re

import numpy as np
import pyarrow as pa

from scoutline.operators import embed

TEXTS = [None, "", " .. ", "One two, one_2 two", "\u00dcn\u00ef \u00c7A \u00df x \uff12 \U0001f600", "word " * 3_000]


def plain(text, dim):
    v = np.zeros(dim)
    for t in re.findall(r"\w+", (text or "").lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32).tolist()


def test_embed_hashed_equals_a_plain_computation(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id long, text string")
    out = embed.embed_hashed(df, "text", dim=48)
    assert [f.dataType.simpleString() for f in out.schema][2] == "array<float>"
    assert {r.id: r.embedding for r in out.collect()} == {i: plain(t, 48) for i, t in enumerate(TEXTS * 3)}


def test_token_vectors_of_slices_and_of_long_columns(monkeypatch):
    monkeypatch.setattr(embed, "SLICE", 3)
    rows = [["a", "b", "a"], [], ["c"], None, ["b"] * 7, ["d", "a"], []]
    whole = embed.token_vectors(pa.array(rows, pa.list_(pa.string())), 16).to_pylist()
    assert whole == [plain(" ".join(r or []), 16) for r in rows]
    assert embed.token_vectors(pa.array(rows, pa.list_(pa.string())).slice(2, 4), 16).to_pylist() == whole[2:6]
    assert embed.token_vectors(pa.array([], pa.list_(pa.string())), 16).to_pylist() == []


def test_a_token_is_hashed_once_per_batch(monkeypatch):
    hashed, md5 = [], hashlib.md5
    monkeypatch.setattr(embed.hashlib, "md5", lambda t: hashed.append(t) or md5(t))
    embed.token_vectors(pa.array([["a", "b"], ["a"] * 50, ["b", "c"]]), 8)
    assert sorted(hashed) == [b"a", b"b", b"c"]
