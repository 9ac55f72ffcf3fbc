"""Change points: chunked and parallel scan against a plain loop."""

import random
from bisect import bisect_left

import pytest

from twinline.operators import regions
from twinline.params import DEFAULTS

P = DEFAULTS.piecewise


def plain(src, lang, initial, inverse=1.0):
    """One pair, one cut after the other: list of (start, end, offset, count)."""
    lang = sorted(set(lang))

    def closest(x, tol):
        i = bisect_left(lang, x)
        near = [c for c in lang[max(0, i - 2):i + 3]]
        if not near:
            return None
        best = min(near, key=lambda c: (abs(c - x), c))
        return best if abs(best - x) <= tol else None

    def expect(t, o):
        return (t - o) * inverse if abs(inverse - 1) > 0.0001 else t - o

    cur, run, cand, regs = initial, 0, 0, []
    start, count, hits = 0, 0, []

    def median(v):
        v = sorted(v)
        return v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2 - 1] + v[len(v) // 2]) / 2

    def switch(i):
        nonlocal cur, run, start, count, hits, base
        at = src[i - 4]
        regs.append((start, at, median(hits) if hits else base, count))
        cur = base = cand
        start, count, hits, run = at, 5, [], 0

    base = initial
    for i, t in enumerate(src):
        found = closest(expect(t, cur), 250)
        if found is not None:
            actual = t - found
            if abs(actual - cur) > 500:
                if run == 0 or abs(actual - cand) < 250:
                    if run == 0:
                        cand = actual
                    run += 1
                    if run >= 5:
                        switch(i)
                else:
                    run, cand = 1, actual
            else:
                count, run = count + 1, 0
                hits.append(actual)
        elif run > 0:
            if closest(expect(t, cand), 250) is not None:
                run += 1
                if run >= 5:
                    switch(i)
            else:
                run = 0
        else:
            wide = closest(expect(t, cur), 15000)
            if wide is not None and abs(t - wide - cur) > 500:
                cand, run = t - wide, 1
    regs.append((start, src[-1], median(hits) if hits else base, count))
    return [(float(a), float(b), float(o), n) for a, b, o, n in regs]


def make(rng, n, changes, gap=9000):
    src, t = [], 0
    for _ in range(n):
        t += rng.randrange(0, gap)
        src.append(t)
    if rng.random() < .5:
        src = sorted(src + rng.choices(src, k=n // 5))
    offs = [rng.randrange(-4000, 4000)]
    for _ in range(changes):
        offs.append(offs[-1] + rng.choice([-1, 1]) * rng.randrange(2000, 9000))
    lang = [t - offs[min(len(offs) - 1, i * len(offs) // len(src))] + rng.randrange(-60, 60) for i, t in enumerate(src) if rng.random() > .1]
    return src, [x for x in lang if x >= 0], offs[0] // 500 * 500


@pytest.mark.parametrize("inverse", [1.0, 1.0427])
@pytest.mark.parametrize("span", [120_000, 10**9])
def test_change_points(spark, span, inverse):
    rng = random.Random(int(span + inverse * 100))
    pairs = {i: make(rng, 160, i % 5) for i in range(8)}
    src = spark.createDataFrame([(i, t) for i, (s, _, _) in pairs.items() for t in s], "pair_id long, t_ms long")
    lang = spark.createDataFrame([(i, t) for i, (_, l, _) in pairs.items() for t in l], "pair_id long, t_ms long")
    start = spark.createDataFrame([(i, o) for i, (_, _, o) in pairs.items()], "pair_id long, offset_ms long")
    points = regions.change_points(src, lang, start, P, inverse, span=span, halo=30_000 if span < 10**6 else 10**6, crowd=1)
    got = {}
    for r in regions.assemble(points, src, start).orderBy("pair_id", "start_ms", "end_ms").collect():
        got.setdefault(r["pair_id"], []).append((r["start_ms"], r["end_ms"], r["offset_ms"], r["match_count"]))
    for i, (s, l, o) in pairs.items():
        assert got[i] == plain(s, l, o, inverse), i


def drifting(rng, n, changes, gap=9000):
    """A long pair whose offset changes ``changes`` times, within reach of the wide search each time."""
    src, t = [], 0
    for _ in range(n):
        t += rng.randrange(500, gap)
        src.append(t)
    offs = [0]
    for _ in range(changes):
        offs.append(max(-40_000, min(40_000, offs[-1] + rng.choice([-1, 1]) * rng.randrange(2000, 9000))))
    lang = [t - offs[min(len(offs) - 1, i * len(offs) // len(src))] + rng.randrange(-60, 60) for i, t in enumerate(src) if rng.random() > .1]
    return src, [x for x in lang if x >= 0], 0


@pytest.mark.parametrize("n,changes,gap,crowd", [(100_000, 500, 60_000, regions.CROWD), (1_500, 3, 20_000, 100), (3_000, 12, 20_000, 400)])
def test_rounds_do_not_follow_the_changes(spark, n, changes, gap, crowd):
    """One pair of many cuts: hundreds of changes take one round in one block; blocks take no more rounds than there are."""
    rng = random.Random(n)
    s, l, o = drifting(rng, n, changes, gap)
    src, lang = (spark.createDataFrame([(1, t) for t in x], "pair_id long, t_ms long") for x in (s, l))
    start = spark.createDataFrame([(1, o)], "pair_id long, offset_ms long")
    points, rounds = regions.scan_rounds(src, lang, start, P, 1.0, False, 400_000 if crowd < 1000 else regions.CHUNK_MS, regions.HALO_MS, crowd)
    got = [(r["start_ms"], r["end_ms"], r["offset_ms"], r["match_count"]) for r in regions.assemble(points, src, start).orderBy("start_ms", "end_ms").collect()]
    assert got == plain(s, l, o) and len(got) > changes / 2
    assert rounds == 1 if crowd >= n else rounds <= max(3, n // crowd)


def test_retime_with_long_series(spark):
    rng = random.Random(3)
    ops, t = [], 0
    for i in range(60):
        t += rng.randrange(200, 5000)
        ops.append((1, i, rng.choice(["INSERT_SILENCE", "CUT_SEGMENT"]), t, rng.randrange(100, 3000)))
    cues = [(1, i, s, s + rng.randrange(50, 4000)) for i, s in enumerate(rng.sample(range(t + 9000), 150))]
    o = spark.createDataFrame(ops, "pair_id long, op_idx long, type string, lang_ts_ms long, duration_ms long")
    c = spark.createDataFrame(cues + [(2, 0, 5, 9)], "pair_id long, cue_id long, start_ms long, end_ms long")
    seg = regions.kept_segments(o)
    for mode in ("reference", "shift"):
        got = {(r["pair_id"], r["cue_id"]): (r["new_start_ms"], r["new_end_ms"]) for r in regions.retime(c, seg, (mode,), span=2000).collect()}
        kept, at, out = [], 0, 0
        for _, _, kind, lt, dur in ops:
            if lt > at:
                kept.append((at, lt, out))
                out += lt - at
            if kind == "INSERT_SILENCE":
                out += dur if mode == "shift" else 0
                at = lt
            else:
                at = lt + dur
        kept.append((at, 1 << 50, out))
        want = {(2, 0): (5, 9)}
        for _, i, s, e in cues:
            parts = [(z + max(s, a) - a, z + min(e, b) - a) for a, b, z in kept if max(s, a) < min(e, b)]
            if parts:
                want[(1, i)] = (min(p[0] for p in parts), max(p[1] for p in parts))
        assert got == want


@pytest.mark.parametrize("inverse", [1.0, 1.0427])
def test_grid_votes_are_joined_by_hits_only(spark, inverse):
    """Votes as in a plain loop, with cuts on the edge of the tolerance, and no table of all cuts times all offsets."""
    from decimal import ROUND_HALF_EVEN, Decimal
    from twinline.operators import offsets
    rng = random.Random(5)
    src = [(p, rng.randrange(0, 90_000) // 250 * 250) for p in range(4) for _ in range(20 * p + 1)] + [(9, 10)]
    lang = [(p, max(0, t - 3000 + rng.choice([-251, -250, -249, 0, 250, 251, 40_000]))) for p, t in src if p < 9] + [(7, 5)]
    got = offsets.grid_votes(spark.createDataFrame(src, "pair_id long, t_ms long"), spark.createDataFrame(lang, "pair_id long, t_ms long"), P, inverse)
    want = {}
    for p in range(10):
        first = sorted(t for q, t in src if q == p)[:50]
        for o in range(-30000, 30001, 500):
            x = [t - o if inverse == 1.0 else int(Decimal((t - o) * inverse).quantize(Decimal(1), ROUND_HALF_EVEN)) for t in first]
            n = sum(any(q == p and abs(c - v) <= 250 for q, c in lang) for v in x)
            if n:
                want[p, o] = (n, len(first))
    assert {(r["pair_id"], r["offset_ms"]): (r["votes"], r["tested"]) for r in got.collect()} == want
    assert "-29500" not in got._jdf.queryExecution().optimizedPlan().toString()
