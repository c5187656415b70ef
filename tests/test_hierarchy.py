import random

import pytest

from quire.operators.hierarchy import closure, descendants_of, hierarchy, paths, unrooted

SCHEMA = "id string, parent_id string, level int, parent string, kind string"


def brute(links):
    out = {}
    for v in links:
        seen, u, k = {}, v, 0
        while True:
            if u in seen:
                cycle = [x for x in seen if seen[x] >= seen[u]]
                out[v] = ("cycle" if v in cycle else "below_cycle", min(cycle), seen[u])
                break
            seen[u] = k
            k += 1
            p = links[u]
            if p is None:
                out[v] = ("rooted", u, k - 1)
                break
            if p not in links:
                out[v] = ("orphan", u, k - 1)
                break
            u = p
    return out


@pytest.mark.parametrize("seed,n,rounds,per_run", [(1, 120, 8, 100_000), (2, 120, 1, 3)])
def test_against_brute_force(spark, seed, n, rounds, per_run):
    random.seed(seed)
    links = {f"n{i:03}": None if i < 3 else random.choice([f"n{random.randrange(i):03}"] * 6 + [f"n{random.randrange(n):03}", "gone"]) for i in range(n)}
    links |= {f"d{i:03}": f"d{i - 1:03}" if i else "n005" for i in range(40)}
    rows = [(k, f" {v.upper()} " if v and hash(k) % 3 == 0 else v, 1, "x", "x") for k, v in links.items()]
    placed = hierarchy(spark.createDataFrame(rows + rows[:20], SCHEMA), peel_rounds=rounds, per_run=per_run).cache()
    got = {r.node_id: (r.state, r.anchor_id, r.steps) for r in placed.collect()}
    want = brute(links)
    assert got == want
    trail = {r.node_id: r.path for r in paths(placed).collect()}
    for v, p in trail.items():
        assert len(p) == want[v][2] + 1 and p[-1] == v and all(links[b] == a for a, b in zip(p, p[1:]))
    pairs = {(r.ancestor_id, r.node_id, r.distance) for r in closure(paths(placed)).collect()}
    assert pairs == {(a, v, len(p) - 1 - i) for v, p in trail.items() for i, a in enumerate(p[:-1])}
    wanted = spark.createDataFrame([("n000",), ("n005",)], "node_id string")
    assert {tuple(r) for r in descendants_of(placed, wanted).collect()} == {(a, v) for a, v, _ in pairs if a in ("n000", "n005")}
    assert {r.node_id: r.descendants for r in placed.collect()} == {v: sum(a == v for a, _, _ in pairs) for v in links}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy(empty).count() == 0
    rows = [("a", None, None, None, None), ("a", None, None, None, None), ("b", "  ", 1, "", ""), (None, "a", 1, "", ""), ("c", "c", 1, "", ""), ("d", "A", 1, "", "")]
    got = {r.node_id: (r.state, r.anchor_id, r.steps) for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("rooted", "a", 0), "b": ("rooted", "b", 0), "c": ("cycle", "c", 0), "d": ("rooted", "a", 1)}
    assert [r.node_id for r in unrooted(hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()] == ["c"]


def test_a_chain_longer_than_peeling_and_a_long_cycle(spark):
    rows = [(f"c{i:04}", f"c{(i + 1) % 300:04}", 1, "", "") for i in range(300)] + [(f"x{i:04}", f"x{i - 1:04}" if i else "c0007", 1, "", "") for i in range(150)]
    got = {r.node_id: (r.state, r.anchor_id, r.steps) for r in hierarchy(spark.createDataFrame(rows, SCHEMA), peel_rounds=2).collect()}
    assert got["c0200"] == ("cycle", "c0000", 0) and got["x0149"] == ("below_cycle", "c0000", 150)


@pytest.mark.parametrize("in_task", [15, 200])
def test_contraction_over_many_tasks(spark, in_task):
    random.seed(3)
    links = {f"n{i:03}": None if i < 2 else f"n{random.randrange(i):03}" for i in range(60)} | {"o1": "gone", "o2": "o1", "c1": "c2", "c2": "c1", "c3": "c1"}
    links |= {f"d{i:02}": f"d{i - 1:02}" if i else "n005" for i in range(30)}
    placed = hierarchy(spark.createDataFrame([(k, v, 1, "x", "x") for k, v in links.items()], SCHEMA), peel_rounds=2, per_run=4, in_task=in_task).cache()
    want = brute(links)
    assert {r.node_id: (r.state, r.anchor_id, r.steps) for r in placed.collect()} == want
    trail = {r.node_id: r.path for r in paths(placed, step=8).collect()}
    assert trail.keys() == links.keys() and all(len(p) == want[v][2] + 1 and p[-1] == v and all(links[b] == a for a, b in zip(p, p[1:])) for v, p in trail.items())
