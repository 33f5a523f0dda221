"""Graph jobs against plain searches on random and hand-made graphs."""

import random
from collections import deque

import pytest

from procatlas.operators import graph


def frames(spark, pairs, extra=()):
    nodes = sorted({n for p in pairs for n in p} | set(extra))
    edges = spark.createDataFrame([(f"e{i}", a, b, "calls") for i, (a, b) in enumerate(pairs)],
                                  "edge_id string, source string, target string, dep_type string")
    return spark.createDataFrame([(n,) for n in nodes], "id string"), edges


def bfs(pairs, root, limit=None):
    seen, queue = {root: 0}, deque([root])
    while queue:
        n = queue.popleft()
        if limit is not None and seen[n] == limit:
            continue
        for a, b in pairs:
            if a == n and b not in seen:
                seen[b] = seen[n] + 1
                queue.append(b)
    return seen


def simple_cycles(pairs, limit):
    out, adj = set(), {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)

    def walk(start, node, path):
        for nxt in adj.get(node, ()):
            if nxt == start:
                out.add(">".join(path))
            elif nxt > start and nxt not in path and len(path) < limit:
                walk(start, nxt, [*path, nxt])

    for start in adj:
        walk(start, start, [start])
    return out


def random_pairs(seed, n=14, m=24):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)]


SHAPES = {
    "chain": [("a", "b"), ("b", "c"), ("c", "d")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "pair": [("r", "a"), ("a", "b"), ("b", "a")],
    "loop": [("r", "a"), ("a", "a")],
    "random": random_pairs(1),
    "sparse": random_pairs(5, 20, 18),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_against_plain_search(spark, shape):
    pairs = SHAPES[shape]
    nodes, edges = frames(spark, pairs, extra=["zz"])
    root = pairs[0][0]
    start = spark.createDataFrame([(root,)], "id string")
    both = pairs + [(b, a) for a, b in pairs]
    assert {r.id: r.depth for r in graph.reach(edges, start, 2).collect()} == bfs(both, root, 2)
    assert {r.id: r.depth for r in graph.reach(edges, start, None, "out").collect()} == bfs(pairs, root)
    targets, sources = {b for _, b in pairs}, {a for a, _ in pairs}
    ids = {n for p in pairs for n in p} | {"zz"}
    roots = ids - targets
    assert {r.id for r in graph.root_nodes(nodes, edges).collect()} == roots
    assert {r.id for r in graph.leaf_nodes(nodes, edges).collect()} == ids - sources
    deepest = max((max(bfs(pairs, r).values()) for r in roots), default=0)
    assert graph.max_depth(nodes, edges).first()[0] == deepest
    assert {r.cycle for r in graph.cycles(edges, 5).collect()} == simple_cycles(pairs, 5)
    reached = {n: set(bfs(pairs, m)) | {m} for n in ids for m in [n]}
    step = {n: {m for _, b in [(x, y) for x, y in pairs if x == n] for m in reached[b]} for n in ids}
    cyclic = {n: min(m for m in ids if m in step[n] and n in step[m]) for n in ids if n in step[n]}
    assert {r.id: r.component for r in graph.cyclic_components(edges).collect()} == cyclic


def test_rings_of_any_length_are_found(spark):
    ring = lambda name, n: [(f"{name}{k:02d}", f"{name}{(k + 1) % n:02d}") for k in range(n)]
    pairs = ring("a", 7) + ring("b", 12) + [("a03", "b05"), ("b01", "z"), ("s", "s"), ("y", "a00")]
    _, edges = frames(spark, pairs)
    got = {r.id: r.component for r in graph.cyclic_components(edges).collect()}
    assert got == {**{a: "a00" for a, _ in ring("a", 7)}, **{b: "b00" for b, _ in ring("b", 12)}, "s": "s"}
    short = graph.cycles(edges, 6).collect()
    assert [(r.cycle, r.has_longer) for r in short] == [("s", True)]
    assert {(r.length, r.has_longer) for r in graph.cycles(edges, 18).collect()} == {(1, False), (7, False), (12, False)}


def test_many_roots_share_bit_blocks(spark):
    """More roots than one 64-bit block holds, joining at different depths."""
    pairs = [(f"r{i:03d}", f"m{i % 7}") for i in range(200)] + [(f"m{i}", f"m{i + 1}") for i in range(6)]
    nodes, edges = frames(spark, pairs)
    roots = {a for a, _ in pairs} - {b for _, b in pairs}
    assert graph.max_depth(nodes, edges).first()[0] == max(max(bfs(pairs, r).values()) for r in roots) == 7


def test_no_roots_means_depth_zero(spark):
    nodes, edges = frames(spark, [("a", "b"), ("b", "a")])
    assert graph.max_depth(nodes, edges).first()[0] == 0


def test_call_tree_counts_a_ladder_of_diamonds(spark):
    """2^30 paths from one end to the other; a level has a row for each node."""
    pairs = [p for k in range(30) for p in ((f"n{k}", f"l{k}"), (f"n{k}", f"r{k}"), (f"l{k}", f"n{k + 1}"), (f"r{k}", f"n{k + 1}"))]
    _, edges = frames(spark, pairs)
    rows = graph.call_tree_counts(edges, spark.createDataFrame([("n0",)], "id string"), 12).collect()
    assert {(r.node, r.depth): int(r.paths) for r in rows if r.node[0] == "n"} == {(f"n{k}", 2 * k): 2 ** k for k in range(7)}
    assert [r.node for r in rows if r.is_truncated] == ["n6"] and len(rows) == 7 + 2 * 6


def test_call_tree_says_where_it_ends(spark):
    _, edges = frames(spark, [("a", "b"), ("b", "c"), ("b", "a"), ("c", "d")])
    start = spark.createDataFrame([("a",)], "id string")
    got = {(">".join(r.path), r.is_circular, r.is_truncated) for r in graph.call_tree(edges, start, 2).collect()}
    assert got == {("a", False, False), ("a>b", False, False), ("a>b>c", False, True), ("a>b>a", True, False)}


def test_call_tree_and_chain(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "a")]
    _, edges = frames(spark, pairs)
    start = spark.createDataFrame([("a",)], "id string")
    got = {(tuple(r.path), r.depth, r.is_circular) for r in graph.call_tree(edges, start, 5).collect()}
    assert got == {(("a",), 0, False), (("a", "b"), 1, False), (("a", "b", "c"), 2, False), (("a", "b", "d"), 2, False),
                   (("a", "b", "c", "a"), 3, True)}
    up = {(r.source, r.target) for r in graph.call_chain(edges, start).where("direction = 'upstream'").collect()}
    assert up == {("x", "a"), ("c", "a"), ("b", "c"), ("a", "b")}
