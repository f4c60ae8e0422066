from __future__ import annotations

import math

import numpy as np
import pytest

from kinetra.llm import embeddings, graph

DDL = "vec_id long, embedding array<float>, label int, bucket string, v int"


def data():
    rng = np.random.default_rng(2)
    out, i = [], 0
    for label in (1, 2):
        for _ in range(12):
            c = rng.normal(size=16)
            for _ in range(1 + rng.integers(0, 8)):
                out.append((i, [float(x) for x in c + rng.normal(size=16) * 0.25], label, "x", 1))
                i += 1
    out += [(500 + k, out[0][1], 1, None, None) for k in range(40)]
    out += [(600, None, 1, None, None), (601, [0.0] * 16, 1, None, None), (602, [float("nan")] + [1.0] * 15, 1, None, None), (603, [None] + [1.0] * 15, 1, None, None), (604, out[0][1], None, None, None), (605, out[0][1], 2, None, None), (606, out[0][1][:8], 1, None, None), (None, out[0][1], 1, None, None), (607, [float("inf")] * 16, 1, None, None), (608, [], 1, None, None)]
    return out


def brute(rows, cut=0.93):
    ok = [(i, np.array(v, dtype=np.float32).astype(float), g) for i, v, g, *_ in rows if i is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows if i is not None}, {i: i for i, *_ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, g), (j, y, h) = ok[a], ok[b]
            if g == h and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cut:
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return links, {i: top(i) for i in root}


@pytest.mark.parametrize("block", [1024, 3])
def test_links_and_components(spark, block):
    rows = data()
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, DDL), block_rows=block).collect()}
    links, roots = brute(rows)
    assert sum(links.values()) > 100
    assert {i: got[i]["n_links"] for i in links} == links
    assert {i: got[i]["component_id"] for i in roots} == roots
    assert got[None]["n_links"] == 0 and got[None]["kept"]


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(80)}


def test_tables_follow_the_count():
    few, many = embeddings.plan_tables(1_000, 0.93, 1e-5), embeddings.plan_tables(10_000_000, 0.93, 1e-5)
    assert many[0] > few[0] and many[1] > few[1]
    for count, threshold in ((10**9, 0.8), (10**12, 0.93)):  # the miss is kept, whatever the bound on tables costs
        bits, tables = embeddings.plan_tables(count, threshold, 1e-5)
        same = 1 - math.acos(threshold) / math.pi
        assert tables <= 512 and (1 - same**bits) ** tables <= 1.0000001e-5


def test_joined_places_equal_union_find():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 60
        root, a, b = np.arange(n), rng.integers(0, n, 40), rng.integers(0, n, 40)
        for half in (slice(0, 20), slice(20, 40)):  # links come in portions
            embeddings._join_up(root, a[half], b[half])
        want = list(range(n))
        for _ in range(n):
            for p, q in zip(a, b):
                want[p] = want[q] = min(want[p], want[q])
        assert root.tolist() == want
