"""SimHash links in buckets of equal bits: all of them, without a comparison of all pairs."""

import numpy as np
import pytest

from brinelake.llm import graph, simhash


def pairs_at_hand(prints):
    x, y = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    return prints[x[x < y]], prints[y[x < y]]


def components(prints, a, b):
    up = {p: p for p in prints.tolist()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((find(x), find(y)))
        up[y] = x
    return {p: find(p) for p in up}


@pytest.fixture(scope="module")
def prints():
    """Fingerprints with copies at one to six bits, and a bucket of 300 that agree in their first half."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 250, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 1 + k % 6, replace=False)) for k in range(1500)], np.uint64)
    half = (rng.integers(0, 2**32, 300, dtype=np.uint64) << np.uint64(32)) | np.uint64(12345)
    return np.unique(np.concatenate([centres, np.repeat(centres, 6) ^ flips, half]))


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_link_is_in_some_bucket(prints, blocks):
    edges = []
    for mask in simhash.masks(blocks, 4):
        bits = prints & np.uint64(mask % 2**64)
        by = np.argsort(bits, kind="stable")
        edges.append(simhash.bucket_links(np.cumsum(np.append(0, np.diff(bits[by]) != 0)), prints[by]))
    a, b = (np.concatenate(side) for side in zip(*edges))
    assert np.all(np.bitwise_count(a ^ b) > 0)
    assert components(prints, a, b) == components(prints, *pairs_at_hand(prints))


@pytest.mark.parametrize("chunk", [100, 1 << 16])
def test_no_comparison_of_all_pairs(spark, prints, monkeypatch, chunk):
    def tiles(*a, **k):
        raise AssertionError("all pairs are compared")

    monkeypatch.setattr(simhash, "link_tiles", tiles)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in graph.connected_components(simhash.link_forest(df)).collect()}
    want = components(prints, *pairs_at_hand(prints))
    signed = dict(zip(prints.tolist(), prints.view(np.int64).tolist()))
    least = {}
    for p, c in want.items():
        least[c] = min(least.get(c, signed[p]), signed[p])
    assert {signed[p]: least[c] for p, c in want.items()} == {s: roots.get(s, s) for s in signed.values()}


def test_fingerprints_that_share_most_bits_go_to_tiles(spark):
    """4,096 values of the last twelve bits: no bucket is small, so tiles compare them."""
    df = spark.range(4096).select(simhash.F.col("id").alias("fp"))
    roots = {r.root for r in graph.connected_components(simhash.link_forest(df, group_rows=500)).collect()}
    assert roots == {0}
