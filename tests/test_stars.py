"""Greedy groups by a sweep against the greedy scan over all pairs."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from test_operators import SCHEMA, distance, entries, hours, overlap

from calendrix.operators import stars


def plain_groups(rows, alike):
    """Row by row in order of start, each unseen event takes all later unseen ones alike to it."""
    rows = sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0]))
    seen, out = set(), {}
    for n, a in enumerate(rows):
        if a[0] in seen:
            continue
        star = [a[0], *(b[0] for b in rows[n + 1 :] if b[0] not in seen and alike(a, b))]
        seen |= set(star)
        if len(star) > 1:
            out |= dict.fromkeys(star, a[0])
    return out


def reconciled(a, b):
    if distance(a[1].lower(), b[1].lower()) <= 0.45 and hours(a[2], b[2]) <= 48:
        return True
    return hours(a[2], b[2]) <= 3 and overlap(a, b) or hours(a[2], b[2]) <= 1 and not a[4] and not b[4]


@pytest.mark.parametrize("slab,eager", [(10**6, 8), (7, 8), (7, 0), (3, 2)])
def test_groups(spark, slab, eager):
    """Whatever the slabs, and whether they are swept together or one after the other."""
    rows = [(2**60 + r[0], *r[1:]) for r in entries(5, 90)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = stars.groups(spark.createDataFrame(rows, SCHEMA), slab=slab, eager=eager).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.id: r.head for r in got} == plain_groups(rows, reconciled) and len(got) == len({r.id for r in got})


def test_a_chain_through_all_of_time(spark):
    """One daily title, of which each head takes the two following days, across slabs; and hourly events without a venue."""
    t0 = dt.datetime(2026, 1, 5, 10)
    rows = [(i, "AI night", t0 + dt.timedelta(days=i), "a", f"Hall number {i}", None, "", None, i) for i in range(60)]
    rows += [(100 + i, chr(97 + i % 26) * 9 + chr(97 + i // 26) * 9, t0 + dt.timedelta(hours=i), "a", None, None, "", None, i) for i in range(120)]
    for slab in (10**6, 20):
        got = {r.id: r.head for r in stars.groups(spark.createDataFrame(rows, SCHEMA), slab=slab).collect()}
        assert got == plain_groups(rows, reconciled)
        assert {got[i] for i in range(60)} == set(range(0, 60, 3))


def test_location_stands_in_for_a_venue(spark):
    at = dt.datetime(2026, 1, 5, 10)
    rows = [(1, "one title", at, "a", None, None, "", None, 1, "Capital Factory"), (2, "quite another", at, "b", "Capital Factory", None, "", None, 2, None), (3, "third thing!!", at, "c", None, None, "", None, 3, "")]
    got = stars.groups(spark.createDataFrame(rows, SCHEMA + ", location string")).collect()
    assert {r.id: r.head for r in got} == {1: 1, 2: 1}


def test_first_groups_and_empty(spark):
    rows = entries(6, 60)
    events = spark.createDataFrame(rows, SCHEMA)
    members = stars.groups(events)
    heads = sorted({r.head for r in members.collect()}, key=lambda h: ({r[0]: r[2] for r in rows}[h], h))
    first = {r.rank: r for r in stars.first_groups(members, events, 4).collect()}
    assert [first[n + 1].head for n in range(4)] == heads[:4]
    assert all(r.ids[0] == r.head and r.size == len(r.ids) > 1 for r in first.values())
    assert stars.groups(events.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_a_slab_goes_from_head_to_head(seed):
    """F16, F18, F20: what lies between heads is skipped, with the heads of a sweep event by event, and ties and heads from before."""
    rng = random.Random(seed)
    reach, near = [40, 7, 3], {(0, n): [m for m in "abcdef" if abs(ord(n) - ord(m)) <= 1] for n in "abcdef"}
    pick = lambda: (rng.choice("abcdef"), rng.choice(["x", "y", None]), rng.choice(["bare", None, None]))
    events = sorted((rng.randrange(300), i, pick()) for i in range(2000))
    before = [(-rng.randrange(60), -1 - i, pick()) for i in range(1)]
    last, heads, want = [{}, {}, {}], [], {}
    for at, i, names in sorted(before) + events:
        met = [last[k][o] for k, n in enumerate(names) if n for o in near.get((k, n), [n]) if o in last[k] and at - last[k][o][0] < reach[k]]
        if not met or i < 0:
            heads += [(at, i, names)] if i >= 0 else []
            for k, n in enumerate(names):
                last[k] |= {n: (at, i)} if n else {}
        want[i] = min(met)[1] if met and i >= 0 else i
    rows = {}
    for at, i, names in events:
        rows.setdefault(names, []).append((at, i))
    packed = pd.DataFrame([(list(n), np.array([a for a, _ in r]), np.array([i for _, i in r])) for n, r in rows.items()], columns=["names", "at", "ids"])
    given = [(i, at, list(names), None, None, None) for at, i, names in before] + [(0, 0, None, k, n, o) for (k, n), o in near.items()]
    slab = stars._Slab(reach, packed, pd.DataFrame(given, columns=["id", "at", "names", "kind", "name", "near"]))
    assert list(slab.sweep()) == heads and len(heads) < 200
    got = {i: head for ids, firsts in slab.members() for i, head in zip(ids, firsts)}
    assert got == {i: want[i] for _, i, _ in events}
