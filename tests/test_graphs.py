"""Cycles and levels of graphs against brute force, and rounds on long chains."""

import random

import pytest
from profileloom.operators import graph as G


def frame(spark, links):
    return spark.createDataFrame(links, "child int, parent int, a string, w int, node int") if links is None else spark.createDataFrame([(c, p) for c, p in links], "child int, parent int")


def reach_of(links, nodes):
    out = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[n] = seen
    return out


def brute(edges, nodes):
    follow = {}
    for c, p in edges:
        if c is not None and p is not None and c != p:
            follow.setdefault(c, set()).add(p)
    reach = reach_of(follow, {n for e in edges for n in e if n is not None} | set(nodes))
    cycles = {(c, p) for c, ps in follow.items() for p in ps if c in reach[p]}
    own = {c: {p for p in ps if p in nodes} for c, ps in follow.items() if c in nodes}
    inside = reach_of(own, nodes)
    bad = {n for n in nodes if n in inside[n] or any(m in inside[m] for m in inside[n])}
    levels = {}

    def level(n):
        if n not in levels:
            levels[n] = max((level(p) + 1 for p in own.get(n, ())), default=0)
        return levels[n]

    return cycles, {n: level(n) for n in nodes if n not in bad}


def graphs():
    rng = random.Random(8)
    yield [(k, k + 1) for k in range(90)]
    yield [(k, (k + 1) % 70) for k in range(70)] + [(200 + k, 201 + k) for k in range(30)] + [(230, 5), (6, 300)]
    yield [(a, b) for a in range(12) for b in range(12) if a != b and rng.random() < 0.3] + [(12, 3), (5, 13), (13, 14), (14, 13)]
    yield [(k, (k - 1) // 2) for k in range(1, 90)] + [(0, 89)]
    yield [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(None, 3), (3, None), (4, 4), (7, 8), (7, 8)]
    yield [(a, b) for a in range(16) for b in range(a + 1, min(a + 4, 16))]


@pytest.mark.parametrize("edges", list(graphs()))
def test_cycles_and_levels(spark, edges):
    nodes = {n for e in edges for n in e if n is not None and n % 17 != 11} | {1000}
    cycles, levels = brute(edges, nodes)
    df = frame(spark, edges)
    assert {tuple(r) for r in G.fk_cycles(df).collect()} == cycles
    tables = spark.createDataFrame([(n,) for n in [*nodes, 1000, None]], "table_id int")
    got = G.fk_load_level(tables, df).collect()
    assert {r.table_id: r.level for r in got} == levels and len(got) == len(levels)


def test_rounds_of_long_chains(spark, monkeypatch):
    """A chain of 100,000 links, and a ring as long, are taken apart in under 40 rounds."""
    seen, whole = [], G._contract
    monkeypatch.setattr(G, "_contract", lambda *x: (seen.append(out := whole(*x)), out)[1])
    n = 100_000
    chain = spark.range(n).selectExpr("id AS child", "id + 1 AS parent")
    assert G.fk_cycles(chain).count() == 0
    ring = spark.range(n).selectExpr("id AS child", f"(id + 1) % {n} AS parent")
    assert G.fk_cycles(ring).count() == n
    assert [len(rounds) < 40 for rounds, *_ in seen] == [True, True]


def test_strings_and_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e")], "child string, parent string")
    assert {tuple(r) for r in G.fk_cycles(edges).collect()} == {("a", "b"), ("b", "a")}
    tables = spark.createDataFrame([(x,) for x in "abcde"], "table_id string")
    assert {tuple(r) for r in G.fk_load_level(tables, edges).collect()} == {("e", 0), ("d", 1)}
    assert G.fk_cycles(edges.where("false")).collect() == [] and G.fk_load_level(tables.where("false"), edges).collect() == []


def test_ancestor_flags(spark):
    """By walking up: long chains, cycles, nulls, flags of one's own, parents that aren't there."""
    import random

    pick = random.Random(4)
    rows = [(k, k - 1 if k % 97 else None, pick.choice([True, False, False, False, None]) if k % 97 < 3 else None) for k in range(970)]
    rows += [(2000, 2001, True), (2001, 2002, False), (2002, 2000, False), (2003, 2002, False), (3000, 3001, None), (3001, 3000, False), (4000, 9999, True), (4001, 4000, False)]
    up, flag = {k: p for k, p, _ in rows}, {k: bool(f) for k, _, f in rows}

    def above(k):
        seen, p = set(), up[k]
        while p in up and p not in seen:
            seen.add(p)
            p = up[p]
        return any(flag[p] for p in seen)

    nodes = spark.createDataFrame(rows, "node long, parent long, flag boolean")
    assert {r.node: r.any_ancestor for r in G.ancestor_flags(nodes).collect()} == {k: above(k) for k in up}
    assert G.ancestor_flags(nodes.limit(0)).collect() == []


def test_rounds_of_hierarchies_shrink_and_stay_off_the_driver(spark, capsys, monkeypatch):
    cut, rows = G._cut, []

    def seen(df, *counts):
        df.explain()
        out = cut(df, *counts)
        rows.append((out[0] if counts else out).count())
        return out

    monkeypatch.setattr(G, "_cut", seen)
    ring = [(k, k % 5 + 1) for k in range(1, 6)]
    way = [(k, k - 1) for k in range(6, 400)]  # ends at the ring
    loose = [(k, k + 1) for k in range(1000, 1300)] + [(7000, 7000), (None, 1), (2, None)]
    found = G.hierarchy_cycles(spark.createDataFrame(ring + way + loose, "node int, parent int"))
    assert sorted(r.node for r in found.collect()) == [1, 2, 3, 4, 5, 7000]
    assert rows == sorted(rows, reverse=True) and rows[-1] == 6 and len(rows) < 13
    assert "Broadcast" not in capsys.readouterr().out


def test_rounds_of_cycles_stay_off_the_driver(spark, capsys, monkeypatch):
    cut = G._cut

    def seen(df, *counts):
        df.explain()
        return cut(df, *counts)

    monkeypatch.setattr(G, "_cut", seen)
    links = [(k, k % 8 + 1) for k in range(1, 9)] + [(k, k - 1) for k in range(9, 20)]
    found = G.fk_cycles(spark.createDataFrame(links, "child int, parent int"))
    assert sorted(map(tuple, found.collect())) == sorted(links[:8])
    assert "Broadcast" not in capsys.readouterr().out


def test_two_levels_leave_no_links_to_search_for_cycles(spark, monkeypatch):
    from profileloom.operators import graph

    seen, labels = [], graph._labels
    monkeypatch.setattr(graph, "_labels", lambda links: (seen.append(links.count()), labels(links))[1])
    edges = spark.createDataFrame([(k, -1 - k % 3) for k in range(20)] + [(0, -2)], "child long, parent long")
    assert graph.fk_cycles(edges).collect() == [] and seen == [0]
