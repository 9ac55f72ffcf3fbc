"""Chunked operators against brute force, with chunks small enough to be crossed all the time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinline.operators import carry, offsets, ordered, regions, series


def keyed(rng, n, top, keys=3, hot=0.6):
    return [(0 if rng.random() < hot else rng.randrange(keys), rng.randrange(-top // 4, top)) for _ in range(n)]


@pytest.mark.parametrize("tie", ["earlier", "later"])
@pytest.mark.parametrize("fine", [None, 3])
def test_nearest(spark, tie, fine):
    rng = random.Random(1)
    t, p = keyed(rng, 300, 400), keyed(rng, 60, 400) + [(9, 1)]
    got = ordered.nearest(spark.createDataFrame(t + [(7, 5)], "k int, x long"), spark.createDataFrame(p, "k int, y long"), ["k"], "x", "y", tie, 16, fine).collect()
    assert len(got) == len(set(t)) + 1
    for r in got:
        ys = sorted({y for k, y in p if k == r["k"]})
        best = min(ys, key=lambda y: (abs(y - r["x"]), y if tie == "earlier" else -y), default=None)
        assert r["near"] == best


def test_last_at_or_before(spark):
    rng = random.Random(2)
    t, m = keyed(rng, 200, 300), [(k, x, x * 10) for k, x in set(keyed(rng, 40, 300))]
    got = ordered.last_at_or_before(spark.createDataFrame(t, "k int, x long"), spark.createDataFrame(m, "k int, y long, v long"), ["k"], "x", "y", ["v"], 8).collect()
    for r in got:
        want = max((y for k, y, _ in m if k == r["k"] and y <= r["x"]), default=None)
        assert r["v"] == (None if want is None else want * 10)


def test_number_rows_with_hot_keys(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < .7 else rng.randrange(4), rng.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = ordered.number_rows(df, ["k"], ["a", "b"], [F.col("a"), F.floor(F.col("b") / 16)], "n").collect()
    assert len(got) == len(rows)
    for k in range(4):
        mine = [(r["a"], r["b"]) for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])]
        assert mine == sorted((a, b) for kk, a, b in rows if kk == k)


def test_hot_chunks_are_cut_again(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(5)], "k int, x long")
    got = ordered.with_chunk(df, ["k"], "x", 50, 10, hot_rows=20).groupBy("k").agg(F.countDistinct("chunk").alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {1: 10, 2: 1}


def test_medians(spark):
    rng = random.Random(4)
    rows = keyed(rng, 500, 200) + [(5, 3)]
    h = ordered.histogram(spark.createDataFrame(rows, "k int, v long"), ["k"], "v")
    up = {r["k"]: r["m"] for r in ordered.upper_median(h, ["k"], "v", "m", 8).collect()}
    mid = {r["k"]: r["m"] for r in ordered.true_median(h, ["k"], "v", "m", 8).collect()}
    for k in up:
        vs = sorted(v for kk, v in rows if kk == k)
        n = len(vs)
        assert up[k] == vs[n // 2]
        assert mid[k] == (vs[n // 2] if n % 2 else (vs[n // 2 - 1] + vs[n // 2]) / 2)


@pytest.mark.parametrize("span", [64, 100_000])
def test_pick_spaced(spark, span):
    rng = random.Random(5)
    rows = list({(k, abs(x)) for k, x in keyed(rng, 900, 3000)})
    got = ordered.pick_spaced(spark.createDataFrame(rows, "k int, p long"), ["k"], "p", 24, span).collect()
    for k in {k for k, _ in rows}:
        want, last = [], None
        for p in sorted(p for kk, p in rows if kk == k):
            if last is None or p - last >= 24:
                want.append(p)
                last = p
        assert sorted(r["p"] for r in got if r["k"] == k) == want


def test_value_window(spark):
    rng = random.Random(6)
    rows = keyed(rng, 400, 300)
    h = ordered.histogram(spark.createDataFrame(rows, "k int, v long"), ["k"], "v")
    for r in ordered.value_window(h, ["k"], "v", 7, 3, {"c": F.sum("n")}, 10).collect():
        assert r["c"] == sum(1 for k, v in rows if k == r["k"] and r["v"] - 7 <= v <= r["v"] + 3)


def test_runs_cross_chunks(spark):
    rng = random.Random(7)
    rows = [(k, i * 3, rng.random()) for k in (0, 1) for i in range(300)]
    df = spark.createDataFrame([(k, p, 0, s) for k, p, s in rows], "k int, pos long, tie int, s double")
    got = {(r["k"], r["run_start"], r["run_length"]) for r in series.low_runs(df, ["k"], "pos", "tie", "s", 0.7, 30, 5).collect()}
    want = set()
    for k in (0, 1):
        run = []
        for kk, p, s in rows + [(k, 10**6, 1.0)]:
            if kk != k:
                continue
            if s < 0.7:
                run.append(p)
            elif run:
                want.add((k, run[0], len(run)))
                run = []
    assert got == want


def test_next_row(spark):
    df = spark.createDataFrame([(k, i, i * 2) for k in (0, 1) for i in range(50)], "k int, i long, v long")
    got = ordered.with_next(df, ["k"], "i", ["v"], 8).collect()
    assert len(got) == 100 and all(r["next_v"] == (None if r["i"] == 49 else r["v"] + 2) for r in got)


def test_candidates_in_blocks(spark):
    rng = random.Random(5)
    a, b = ([(k, rng.randrange(1000)) for k in (1, 2) for _ in range(80)] for _ in range(2))
    want = {}
    for k, s in a:
        for kk, l in b:
            if k == kk:
                want[k, l - s] = want.get((k, l - s), 0) + 1
    a, b = (spark.createDataFrame(x, "k int, t long") for x in (a + [(3, 1)], b + [(4, 1)]))
    for block in (1 << 25, 64):
        assert {(r["k"], r["offset"]): r["n"] for r in offsets.candidates(a, b, "k", "t", block=block).collect()} == want


def test_windows_of_a_width_per_key(spark):
    rng = random.Random(9)
    widths = {0: 41708, 1: 1, 2: 40000, 3: 33367, 4: 7}
    rows = [(k, w, rng.randrange(-w * 9, w * 9) // 2 * 2 + b) for k, w in widths.items() for _ in range(60) for b in (0, w)]
    df = spark.createDataFrame(rows, "k int, w long, offset long").withColumn("at", F.col("offset"))
    hist = ordered.histogram(df, ["k", "w"], "offset")
    for k, w in widths.items():
        cluster = offsets.densest_cluster(hist.filter(f"k = {k}"), ["k", "w"], w).collect()
        agreed = offsets.consensus(df.filter(f"k = {k}"), ["k", "w"], "offset", F.col("at"), w, 1).collect()
        assert cluster == [r for r in offsets.densest_cluster(hist, ["k", "w"], F.col("w")).collect() if r["k"] == k]
        assert agreed == [r for r in offsets.consensus(df, ["k", "w"], "offset", F.col("at"), F.col("w"), 1).collect() if r["k"] == k]


def test_densest_cluster_is_the_two_pointer_result(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(400)) for k in range(20) for _ in range(rng.randrange(1, 60))]
    h = ordered.histogram(spark.createDataFrame(rows, "k int, offset long"), ["k"], "offset")
    got = {r["k"]: (r["offset"], r["votes"]) for r in offsets.densest_cluster(h, ["k"], 40, 64).collect()}
    for k in range(20):
        c, left, best, at = sorted(v for kk, v in rows if kk == k), 0, 0, 0
        for r in range(len(c)):
            while c[r] - c[left] > 40:
                left += 1
            if r - left + 1 > best:
                best, at = r - left + 1, left
        assert got[k] == (c[at + best // 2], best)


def test_candidates_blocks(spark, monkeypatch):
    rng = random.Random(9)
    s, l = keyed(rng, 80, 300), keyed(rng, 90, 300)
    monkeypatch.setattr(offsets, "BLOCK", 50)
    got = offsets.candidates(spark.createDataFrame(s, "k int, t long"), spark.createDataFrame(l, "k int, t long"), "k", "t").collect()
    want = {}
    for k, a in s:
        for kk, b in l:
            if k == kk:
                want[(k, b - a)] = want.get((k, b - a), 0) + 1
    assert {(r["k"], r["offset"]): r["n"] for r in got} == want


def test_merge_follows_the_group_head(spark):
    rng = random.Random(10)
    rows, start = [], 0
    for i in range(120):
        rows.append((1, float(start), float(start + 100), rng.choice([0.0, 0.4, 0.8, 1.2, 1.9, 500.0]), i))
        start += 100
    df = spark.createDataFrame(rows, "pair_id long, start_ms double, end_ms double, offset_ms double, match_count long")
    old, regions.CHUNK_MS = regions.CHUNK_MS, 700
    try:
        got = sorted(tuple(r) for r in regions.merge_equal(df).collect())
    finally:
        regions.CHUNK_MS = old
    want = []
    for p, s, e, o, m in rows:
        if want and abs(o - want[-1][3]) < 1.0:
            last = want[-1]
            want[-1] = (p, last[1], e, last[3], last[4] + m)
        else:
            want.append((p, s, e, o, m))
    assert got == sorted(want)


def merged(rows):
    want = []
    for p, s, e, o, m in rows:
        if want and want[-1][0] == p and abs(o - want[-1][3]) < 1.0:
            want[-1] = (p, want[-1][1], e, want[-1][3], want[-1][4] + m)
        else:
            want.append((p, s, e, o, m))
    return sorted(want)


@pytest.mark.parametrize("chunk,fan", [(7, 3), (1, 2), (2048, 1024)])
def test_merge_of_long_islands(spark, chunk, fan):
    """Small steps for hundreds of regions: chunks composed in several levels give the rows of one pass."""
    rng = random.Random(chunk)
    rows = []
    for pair, steps in enumerate(([0.4], [-0.3, 0.3], [1.0, -1.0], [0.1, 0.2, -0.25], [1.9, -1.9, 0.05], [0.0, 0.5, -0.5, 1.0])):
        at = 1000.0 * pair
        for i in range(240):
            rows.append((pair, i * 100.0, i * 100.0 + 100, at, i))
            at += rng.choice(steps)
    df = spark.createDataFrame(rows, "pair_id long, start_ms double, end_ms double, offset_ms double, match_count long").repartition(3)
    assert sorted(tuple(r) for r in regions.merge_equal(df, 1.0, chunk, fan).collect()) == merged(rows)


def test_composed_steps():
    """A composed function equals its parts one after the other, at and around all breakpoints."""
    rng = random.Random(3)
    for _ in range(60):
        at, series = rng.randrange(5) / 2, []
        for _ in range(rng.randrange(2, 40)):
            at += rng.choice([0.5, -0.5, 0.3, -0.4, 0.0, 1.5, -1.5, 0.1])
            series.append(at)
        series = np.array(series)
        cut = rng.randrange(1, len(series))
        parts = [regions.Steps.of(x, 1.0) for x in (series[:cut], series[cut:])]
        whole = parts[0].then(parts[1])
        for head in np.r_[series[0] + np.linspace(-2.5, 2.5, 101), parts[0].points, whole.points]:
            want = head
            for o in series:
                if abs(o - want) >= 1.0:
                    want = o
            if abs(series[cut] - parts[0](head)) < 3 and abs(head - series[0]) < 3:
                assert whole(head) == parts[1](parts[0](head)) == want


@pytest.mark.parametrize("fan", [2, 5])
def test_pick_carried_through_a_tree(spark, fan):
    """One key of many chunks, with empty chunks between, in several levels."""
    rng = random.Random(fan)
    at, want, last, rows = 0, [], None, []
    for _ in range(1500):
        at += rng.choice([1, 3, 10, 22, 23, 24, 25]) if rng.random() < .99 else 400
        rows.append((1, at))
        if last is None or at - last >= 24:
            want.append(at)
            last = at
    got = ordered.pick_spaced(spark.createDataFrame(rows, "k int, p long"), ["k"], "p", 24, 64, fan).collect()
    assert sorted(r["p"] for r in got) == want


def test_carry_of_a_million_chunks(spark):
    """A key of 10^6 chunks: no task reads more than the fan, plus what its own groups hold."""
    n = 1_000_000
    tables = spark.range(n).selectExpr("1 as k", "id as at", "array(cast(pmod(id * 7, 3) as int), cast(pmod(id + 1, 3) as int), 1) as fn").withColumn("start", F.lit(carry.dump(0)))
    got = carry.entry_states(tables, ["k"], "at", ordered.PAUSES, "int", int).toPandas().sort_values("at")["state"].to_numpy()
    ids = np.arange(n)
    table, state, want = np.stack([ids * 7 % 3, (ids + 1) % 3, np.ones(n, int)], 1).tolist(), 0, []
    for row in table:
        want.append(state)
        state = row[state]
    assert got.tolist() == want


@pytest.mark.parametrize("n,span,weight", [(3000, 4000, 1), (3000, 9000, 10**9), (400, 10**7, 5)])
def test_correlation(n, span, weight):
    """Fourier and pair by pair give the same sums."""
    rng = np.random.default_rng(n + span)
    s, l = (np.sort(rng.choice(span, n, replace=False)) + base for base in (-50, 7777))
    sn, ln = (rng.integers(1, weight + 1, n) for _ in range(2))
    offset, total = offsets.correlate(s, sn, l, ln)
    diff, count = np.subtract.outer(l, s).ravel(), np.multiply.outer(ln, sn).ravel()
    want, where = np.unique(diff, return_inverse=True)
    sums = np.zeros(len(want), np.int64)
    np.add.at(sums, where, count)
    order = np.argsort(offset)
    assert (offset[order] == want).all() and (total[order] == sums).all()


def test_crowded_timelines(spark):
    """A key with many positions is cut into finer blocks and keeps its histogram."""
    rng = np.random.default_rng(1)
    s, l = (np.sort(rng.choice(60_000, 9_000, replace=False)) for _ in range(2))
    a, b = (spark.createDataFrame([(1, int(t)) for t in x] + [(2, 5)], "k int, t long") for x in (s, l))
    got = {(r["k"], r["offset"]): r["n"] for r in offsets.candidates(a, b, "k", "t", block=1 << 20, fine=1 << 13, crowded=1000).collect()}
    diff, n = np.unique(np.subtract.outer(l, s).ravel(), return_counts=True)
    assert got == {(2, 0): 1} | {(1, d): k for d, k in zip(diff.tolist(), n.tolist())}


def test_short_series_are_picked_in_one_list(spark):
    """Series of few positions in many chunks need no tables of pauses, and give the rows of those that do."""
    rng = random.Random(9)
    rows = [(k, rng.randrange(-500, 3000)) for k in range(6) for _ in range(3 ** k)] + [(None, 5), (None, 900)]
    df = spark.createDataFrame(rows, "k int, pos long").withColumn("gap", F.col("k") * 7 + 3)
    def pick(df, **how):
        return sorted(map(tuple, ordered.pick_spaced(df, ["k", "gap"], "pos", "gap", span=100, fan=4, **how).collect()))
    want = []
    for k in range(6):
        last = None
        for p in sorted({p for q, p in rows if q == k}):
            if last is None or p - last >= k * 7 + 3:
                want.append((k, k * 7 + 3, p))
                last = p
    assert pick(df) == pick(df, whole=0) == pick(df, whole=20) == sorted(want)
    assert carried(spark, lambda: pick(df)) == 0 < carried(spark, lambda: pick(df, whole=0))


def carried(spark, run):
    """Rows that ``run`` hands to ``carry.entry_states``."""
    from twinline.operators import carry
    seen, real = [], carry.entry_states
    carry.entry_states = lambda functions, *rest, **more: (seen.append(functions.count()), real(functions, *rest, **more))[1]
    try:
        run()
    finally:
        carry.entry_states = real
    return sum(seen)


def test_small_islands_are_merged_as_lists(spark):
    """Islands of up to a chunk of runs need no tables of heads, and merge as in a plain loop."""
    rng = random.Random(4)
    rows, want = [], []
    for p in range(8):
        o, head = 0.0, None
        for i in range(2 + 12 * p):
            o += rng.choice([0.0, 0.4, 0.4, 0.9, -0.4, 1.0, 5.0])
            rows.append((p, i * 1000.0, (i + 1) * 1000.0, o, i % 3 + 1))
            if head is None or abs(o - head) >= 1.0:
                head = o
                want.append([p, i * 1000.0, 0.0, o, 0])
            want[-1][2] = (i + 1) * 1000.0
            want[-1][4] += i % 3 + 1
    df = spark.createDataFrame(rows, "pair_id long, start_ms double, end_ms double, offset_ms double, match_count long")
    def merge(**how):
        return sorted(map(tuple, regions.merge_equal(df, **how).select("pair_id", "start_ms", "end_ms", "offset_ms", "match_count").collect()))
    assert merge() == merge(chunk=4, fan=4) == sorted(map(tuple, want))
    assert carried(spark, merge) == 0 < carried(spark, lambda: merge(chunk=4))
