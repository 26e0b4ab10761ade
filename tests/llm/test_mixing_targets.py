"""Targets of very many sources against the rule applied round by round; scopes of runs side by side."""

import random
import threading
from fractions import Fraction

import pytest

from facetmill.llm import common, mixing


def by_rounds(sizes, weights=(1, 2, 3), limit=3):
    """Share by weight; who is above the limit stops there and the others share the rest, until nobody is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > limit * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = Fraction(limit * sizes[s])
            rest -= target[s]
        open_ -= over
    return names, target


@pytest.mark.parametrize("seed,n", [(1, 1500), (2, 7), (3, 1)])
def test_targets_of_many_sources(spark, seed, n):
    rng = random.Random(seed)
    names = [rng.choice(["", "a", "é", "𝒳", "host-"]) + str(i) for i in range(n - 1)] + [None]
    sizes = {s: rng.choice([0, 1, 50, rng.randrange(10**6), 10**9 if rng.random() < 0.01 else 5]) for s in names}
    order, want = by_rounds(sizes)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r["source"]: r for r in mixing.targets(df).collect()}
    assert len(got) == n and [got[s]["rank"] for s in order] == list(range(n))
    for s in sizes:
        assert got[s]["source_size"] == sizes[s] and got[s]["target"] == pytest.approx(float(want.get(s, 0)), rel=1e-9, abs=1e-9)


def test_scopes_of_two_threads_do_not_meet(spark):
    df = spark.range(3)
    inside, found = threading.Barrier(2), {}

    def chain(name):
        mine = found[name] = []
        with common.scope(mine, df):
            inside.wait(60)
            kept = common.saved(df, f"scope-{name}")
            inside.wait(60)
        again = list(mine)
        with common.scope(mine, kept):  # reads the folder still: it stays
            pass
        found[name] = (again, kept.count(), mine)

    threads = [threading.Thread(target=chain, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    for n in ("a", "b"):
        first, count, now = found[n]
        assert len(first) == 1 and f"scope-{n}-" in first[0] and count == 3 and now == first
