"""Deadlocks of whole graphs against plain Python."""

import random

from corvane.operators import locks


def plain(edges):
    """Transactions that reach themselves."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reaches(a):
        seen, todo = set(), list(out.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        return a in seen

    return {a for a in out if reaches(a)}


def found(spark, edges):
    return {r[0] for r in locks.deadlocked(spark.createDataFrame(edges, "waiter long, owner long").repartition(2)).collect()}


def test_long_ring_and_long_chain(spark):
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    chain = [(10_000 + i, 10_001 + i) for i in range(3000)]
    into = [(20_000 + i, 20_001 + i) for i in range(50)] + [(20_050, 7)]
    assert found(spark, ring + chain + into) == set(range(3000))


def test_random_graphs(spark):
    r = random.Random(3)
    edges = []
    for block, density in enumerate((0.7, 1.0, 1.2, 1.6, 0.9)):
        edges += [(block * 100 + r.randrange(40), block * 100 + r.randrange(40)) for _ in range(int(40 * density))]
    edges += [(900, 901), (901, 902), (902, 903), (903, 900), (902, 910), (910, 911), (911, 912), (912, 910), (910, 930), (930, 930), (None, 5), (5, None)]
    edges += [(950, 951), (950, 952), (951, 953), (952, 953), (953, 954), (954, 950), (960, 952)]
    assert found(spark, edges) == plain([e for e in edges if None not in e])
    assert found(spark, edges[:1]) == plain(edges[:1])
