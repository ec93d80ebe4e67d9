"""Trees against a walk along the parents, with cycles, missing ids, hot parents and deep chains."""

import random

import pytest

from tracelake.operators import hierarchy as H

SCHEMA = "id string, parent_id string, parent string, enter int"


def walked(pairs):
    parent = {}
    for child, up in pairs:
        if child and child.strip():
            key, up = child.strip().lower(), (up or "").strip().lower() or None
            parent[key] = max(filter(None, (parent.get(key), up)), default=None)

    def end(x):
        seen, n = [], 0
        while True:
            if x not in parent:
                return x, -2
            if x in seen:
                return min(seen[seen.index(x) :]), -1
            if parent[x] is None:
                return x, n
            seen.append(x)
            x, n = parent[x], n + 1

    return {x: end(x) for x in parent}, parent


def frame(spark, pairs):
    # clashing names in further columns must not matter
    return spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], SCHEMA)


def forest():
    rng = random.Random(3)
    pairs = [("root", None), ("Hub ", "root")]
    pairs += [(f"leaf{i}", " hub") for i in range(150)]
    pairs += [(f"chain{i}", f"chain{i - 1}" if i else "root") for i in range(70)]
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("tail", "c2"), ("self", "self"), ("lost", "gone"), ("child", "lost")]
    pairs += [(f"r{i}", f"r{rng.randrange(i)}" if i else "") for i in range(60)]
    return [*pairs, ("c1", "c2"), (None, "root"), ("  ", "root"), ("leaf1", " hub")]


def test_against_walks(spark):
    pairs = forest()
    expected, parent = walked(pairs)
    tree = H.cut(H.hierarchy(frame(spark, pairs)))
    rows = {r.node: r for r in H.paths(tree).collect()}
    assert {n for n, r in rows.items() if r.listed} == set(expected)
    for node, (root, depth) in expected.items():
        kind = {-1: "cycle", -2: "missing"}.get(depth, "tree")
        assert (rows[node].kind, rows[node].root) == (kind, root), node
        if kind == "tree":
            path = [node]
            while parent[path[-1]]:
                path.append(parent[path[-1]])
            assert rows[node].depth == depth and rows[node].path == " > ".join(reversed(path))
    below = {}
    for r in H.descendants(tree).collect():
        below.setdefault(r.ancestor, set()).add((r.descendant, r.distance))
    assert {n: len(s) for n, s in below.items()} == {n: r.n_descendants for n, r in rows.items() if r.n_descendants}
    assert ("chain69", 70) in below["root"]


@pytest.mark.parametrize("pairs", [[], [(None, None)], [("a", "a")], [("a", "b"), ("b", "a")], [("only", None)]])
def test_small(spark, pairs):
    expected, _ = walked(pairs)
    got = {r.node: (r.root, r.depth) for r in H.roots_and_depths(frame(spark, pairs)).collect()}
    assert got == expected


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from tracelake.plans.cut import cut, scratch, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    with scratch():
        assert H.roots_and_depths(frame(spark, forest())).count() > 200
        assert cut(spark.range(3)).count() == 3
    assert {p.name for p in folder.iterdir()} == before
