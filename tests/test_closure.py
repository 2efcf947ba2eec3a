import random

from pagelore.operators import closure


def walked(edges, start):
    hops, last = {start: 0}, [start]
    while last:
        last = [t for n in last for s, t in edges if s == n and t not in hops and not hops.update({t: hops[n] + 1})]
    return hops


def test_reach_over_cycles_and_kinds(spark):
    r = random.Random(4)
    edges = {(r.randrange(40), r.randrange(60)) for _ in range(90)} | {(0, 1), (1, 2), (2, 0), (7, 7)}
    rows = [(s, t, "sound") for s, t in edges] + [(s, t, "image") for s, t in list(edges)[:20]] + [(5, 999, "image"), (None, 3, "sound"), (3, None, "sound")]
    df = spark.createDataFrame(rows, "source int, target int, kind string")
    starts = spark.createDataFrame([(0,), (7,), (5,), (888,), (0,), (None,)], "start int")
    got = {(x.start, x.node): x.hops for x in closure.reach(starts, df, ["sound"]).collect()}
    assert got == {(s, n): h for s in (0, 7, 5, 888) for n, h in walked(edges, s).items()}
    assert (5, 999) in {(x.start, x.node) for x in closure.reach(starts, df).collect()}


def test_reach_stays_within_a_deck(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (1, "b", "d")], "deck int, source string, target string")
    starts = spark.createDataFrame([(1, "a"), (2, "b")], "deck int, start string")
    assert sorted((x.deck, x.start, x.node) for x in closure.reach(starts, edges, keep=["deck"]).collect()) == [(1, "a", "a"), (1, "a", "b"), (1, "a", "d"), (2, "b", "b"), (2, "b", "c")]


def test_sums_are_those_of_the_pairs(spark, monkeypatch):
    """Cycles, chains that lead into and out of them, and nodes apart: what starts share is walked once."""
    r = random.Random(2)
    edges = {(r.randrange(30), r.randrange(30)) for _ in range(60)} | {(100 + i, 101 + i) for i in range(5)} | {(105, 3), (4, 200), (200, 201), (300, 301), (301, 300), (301, 100)}
    starts = [*range(0, 30, 3), 100, 103, 105, 200, 201, 300, 301, 888]
    df = spark.createDataFrame([(s, t, "sound") for s, t in edges] + [(0, 888, "image"), (None, 3, "sound"), (3, None, "sound")], "source long, target long, kind string")
    rows = spark.createDataFrame([(s,) for s in [*starts, starts[0], None]], "start long")
    want = sorted((s, len(w), sum(w)) for s in starts for w in [walked(edges, s)])
    pairs, inner = [], closure.reach
    monkeypatch.setattr(closure, "reach", lambda *a: pairs.append(inner(*a)) or pairs[-1])
    assert sorted(map(tuple, closure.sums(rows, df, ["sound"], few=300).collect())) == want
    assert sum(p.count() for p in pairs) < sum(n for _, n, _ in want) / 2
    assert sorted(map(tuple, closure.sums(rows, df, ["sound"]).collect())) == want
