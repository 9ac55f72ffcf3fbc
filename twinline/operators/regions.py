"""Piecewise offsets: change points, regions, edit operations, kept intervals, re-timed cues."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from twinline.operators import carry, ordered
from twinline.params import DEFAULTS, PiecewiseSettings
from twinline.session import settled, spread

CHUNK_MS = 7_200_000
HALO_MS = 300_000
#: Cuts that one task scans in a row.
CROWD = 100_000


@dataclass
class Scan:
    """Where the scan of one pair stands between two cuts."""

    current: int   # offset in use, ms
    run: int       # consecutive cuts that fit the candidate
    candidate: int
    run_t: int     # time of the first cut of that run
    region_t: int  # start of the open region, -1 for the first

    def as_tuple(self):
        return (self.current, self.run, self.candidate if self.run else 0, self.run_t if self.run else 0, self.region_t)


def scan_cuts(times, counts, lang, scan: Scan, p: PiecewiseSettings, inverse: float = 1.0,
              drift_compensated: bool = False):
    """Follow the offset over the cuts of one chunk.

    Returns hits ``{(region_t, offset): n}``, changes ``[(region_t, offset)]``
    and the largest distance the offset moved from where it started.
    """
    tol, wide, change, need = p.match_tolerance_ms, int(p.wide_probe_sec * 1000), p.min_offset_change_ms, p.min_consecutive
    stretched = abs(inverse - 1.0) > 0.0001
    start = scan.current
    reach = 0
    hits: dict = {}
    changes: list = []

    def expect(t, offset):
        return (t - offset) * inverse if stretched else t - offset

    def closest(x, limit):
        if not len(lang):
            return None
        i = int(np.searchsorted(lang, x))
        best = None
        for j in (i - 1, i):
            if 0 <= j < len(lang) and (best is None or abs(lang[j] - x) < abs(best - x)):
                best = lang[j]
        return int(best) if abs(best - x) <= limit else None

    def moved(t, found):
        return t - (found / inverse if drift_compensated and stretched else found)

    def add_hits(offsets, n):
        for o, k in zip(*_sum_by(offsets, n)):
            key = (scan.region_t, o)
            hits[key] = hits.get(key, 0) + k

    i, n_cuts = 0, len(times)
    calm = None  # for the current offset: nearest match and whether the cut simply fits
    while i < n_cuts:
        if scan.run == 0:
            if calm is None:
                calm = _fits(times, lang, scan.current, inverse if stretched else 1.0, tol, change, drift_compensated)
            offsets, fits, next_odd = calm
            j = int(next_odd[i])
            if j > i:
                add_hits(offsets[i:j], counts[i:j])
                i = j
                continue
        t, left = int(times[i]), int(counts[i])
        while left:
            before = scan.as_tuple()
            found = closest(expect(t, scan.current), tol)
            fitted = False
            if found is not None:
                actual = moved(t, found)
                if abs(actual - scan.current) > change:
                    if scan.run == 0 or abs(actual - scan.candidate) < tol:
                        if scan.run == 0:
                            scan.candidate, scan.run_t = actual, t
                        scan.run += 1
                        fitted = scan.run >= need
                    else:
                        scan.run, scan.candidate, scan.run_t = 1, actual, t
                else:
                    key = (scan.region_t, actual)
                    hits[key] = hits.get(key, 0) + 1
                    scan.run = 0
            elif scan.run > 0:
                if closest(expect(t, scan.candidate), tol) is not None:
                    scan.run += 1
                    fitted = scan.run >= need
                else:
                    scan.run = 0
            else:
                probe = closest(expect(t, scan.current), wide)
                if probe is not None and abs(moved(t, probe) - scan.current) > change:
                    scan.candidate, scan.run, scan.run_t = moved(t, probe), 1, t
            if scan.run:
                reach = max(reach, abs(scan.candidate - start))
            if fitted:
                scan.region_t, scan.current, scan.run = scan.run_t, scan.candidate, 0
                changes.append((scan.region_t, scan.current))
                calm = None
            left -= 1
            if left and scan.as_tuple() == before:
                # repeats of the same cut no longer change anything
                if found is not None and abs(moved(t, found) - scan.current) <= change:
                    hits[(scan.region_t, moved(t, found))] += left
                left = 0
        i += 1
    return hits, changes, reach


def _sum_by(offsets, n):
    values, where = np.unique(offsets, return_inverse=True)
    return values.tolist(), np.bincount(where, weights=n).astype(np.int64).tolist()


def _fits(times, lang, current, inverse, tol, change, compensated):
    """Offsets of the nearest language cuts, which cuts simply fit, and the next one that does not."""
    n = len(times)
    if len(lang):
        x = (times - current) * inverse
        i = np.searchsorted(lang, x)
        a, b = lang[np.clip(i - 1, 0, len(lang) - 1)], lang[np.clip(i, 0, len(lang) - 1)]
        near = np.where(np.abs(a - x) <= np.abs(b - x), a, b)
        offsets = times - (near / inverse if compensated else near)
        fits = (np.abs(near - x) <= tol) & (np.abs(offsets - current) <= change)
    else:
        offsets, fits = np.zeros(n, np.int64), np.zeros(n, bool)
    marks = np.where(fits, n, np.arange(n))
    next_odd = np.minimum.accumulate(marks[::-1])[::-1]
    return offsets, fits, next_odd


#: What decides how a chunk is scanned. Where its run and its region began are labels: a scan is entered with marks in their place.
STATE = ["current", "run", "candidate"]
IN_REGION, IN_RUN = -2.0, -3.0
STATE_DDL = ", ".join(f"{s} double" for s in STATE)
EXITS = [f"exit_{s}" for s in (*STATE, "run_t", "region_t")]
OUT_DDL = "array<struct<kind: string, region_t: double, offset: double, n: long>>"


def _label(label: float, run_t: float, region_t: float) -> float:
    return run_t if label == IN_RUN else region_t if label == IN_REGION else label


def _follow(f: dict, state: tuple | None) -> tuple | None:
    """The state after a stretch; None where the stretch was not scanned from this state."""
    exit_ = f.get(state[:3]) if state is not None else None
    return exit_ if exit_ is None else (*exit_[:3], *[_label(x, *state[3:]) for x in exit_[3:]])


def _chain(f: dict, g: dict) -> dict:
    """Scans of a stretch and the one after it; only what both have been scanned from is known."""
    return {key: end for key, state in f.items() if (end := _follow(g, state)) is not None}


#: A block's scans: entry state -> exit state and labels.
SCANS = carry.Algebra(lambda rows: {tuple(r[s] for s in STATE): tuple(r[e] for e in EXITS) for r in rows}, _chain, _follow,
                      enter=lambda current: (float(current), 0.0, 0.0, 0.0, -1.0))


def change_points(src: DataFrame, lang: DataFrame, initial: DataFrame, settings: PiecewiseSettings = DEFAULTS.piecewise,
                  inverse: float = 1.0, drift_compensated: bool = False, span: int = CHUNK_MS,
                  halo: int = HALO_MS, crowd: int = CROWD) -> DataFrame:
    """Hits and changes of every pair: rows (pair_id, kind, region_t, offset, n); see ``scan_rounds``."""
    return scan_rounds(src, lang, initial, settings, inverse, drift_compensated, span, halo, crowd)[0]


def scan_rounds(src: DataFrame, lang: DataFrame, initial: DataFrame, settings: PiecewiseSettings, inverse: float, drift_compensated: bool,
                span: int, halo: int, crowd: int) -> tuple[DataFrame, int]:
    """The rows of ``change_points``, and the rounds of scanning they took.

    The scan depends on what it found before, so it cannot become a join. A pair is cut
    into blocks of some ``crowd`` cuts (a second of work), made of chunks of ``span`` ms, so most pairs are
    one block and take one round, however many changes they have. For longer ones, a scan of a block is an
    entry of its transfer function, from the state that enters to the one that leaves.
    The known entries are composed in a tree (``carry``), which tells the true state of every
    block up to the first that was not scanned from it. Rounds of scanning, each of all blocks in parallel:

    1. every block from the pair's first offset;
    2. every block from what the block before it left with: right behind a block with a change;
    3. every block from what the last block with a change before it left with: right in the others.

    What is still open goes on from its true state, carried to all later blocks, so rounds
    never outnumber blocks. Scans are kept; no round repeats or rewrites one. A scan that moves
    further than its halo of language cuts runs again with a wider one, so results are exact.
    """
    points = settled(ordered.histogram(src, ["pair_id"], "t_ms").withColumn("chunk", ordered.chunk_index(F.col("t_ms"), span)))
    marks = settled(lang.select("pair_id", F.col("t_ms").cast("long").alias("t_ms")).distinct()
                    .withColumn("_lc", ordered.chunk_index(F.col("t_ms"), span)))
    start = initial.select("pair_id", F.col("offset_ms").cast("double").alias("start"))
    cuts = points.groupBy("pair_id", "chunk").agg(F.count(F.lit(1)).alias("cuts")).withColumn("_far", ordered.chunk_index(F.col("chunk"), 4096))
    cuts = ordered.running_total(cuts, ["pair_id"], "_far", ["chunk"], F.col("cuts"), "_before", exclusive=True).withColumn("block", F.expr(f"_before div {crowd}"))
    blocks = cuts.groupBy("pair_id", "block").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    blocks = settled(ordered.number_rows(blocks, ["pair_id"], ["block"], [ordered.chunk_index(F.col("block"), 4096)], "at").join(start, "pair_id"))
    points = settled(points.join(cuts.select("pair_id", "chunk", "block"), ["pair_id", "chunk"]).join(blocks.select("pair_id", "block", "at"), ["pair_id", "block"])
                     .select("pair_id", "at", "t_ms", "n"))

    def scans(wanted: DataFrame) -> DataFrame:
        """``wanted(pair_id, at, STATE, halo)`` scanned."""
        todo = settled(wanted.join(blocks.select("pair_id", "at", "lo", "hi"), ["pair_id", "at"]))
        low = (F.col("lo") * span - F.col("current") - F.col("halo")) * inverse
        high = ((F.col("hi") + 1) * span - F.col("current") + F.col("halo")) * inverse
        reach = todo.withColumn("_lo", low).withColumn("_hi", high).withColumn(
            "_lc", F.explode(F.sequence(F.floor(F.col("_lo") / span), F.floor(F.col("_hi") / span))))
        group = ["pair_id", "at", *STATE, "halo"]
        near = (marks.join(reach, ["pair_id", "_lc"]).filter((F.col("t_ms") >= F.col("_lo")) & (F.col("t_ms") <= F.col("_hi")))
                .select(*group, "t_ms", F.lit(0).cast("long").alias("n")))
        own = points.join(todo, ["pair_id", "at"]).select(*group, "t_ms", "n")

        def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t_ms")
            cuts, others = pdf[pdf["n"] > 0], pdf[pdf["n"] == 0]
            as_int = lambda v: int(v) if float(v).is_integer() else float(v)
            state = Scan(*(as_int(v) for v in key[2:5]), run_t=IN_RUN, region_t=IN_REGION)
            hits, changes, far = scan_cuts(cuts["t_ms"].to_numpy(np.int64), cuts["n"].to_numpy(np.int64),
                                           others["t_ms"].to_numpy(np.int64), state, settings, inverse, drift_compensated)
            out = [{"kind": "hit", "region_t": float(r), "offset": float(o), "n": int(n)} for (r, o), n in hits.items()]
            out += [{"kind": "change", "region_t": float(r), "offset": float(o), "n": settings.min_consecutive} for r, o in changes]
            short = far + settings.wide_probe_sec * 1000 + settings.match_tolerance_ms > key[5]
            current, run, candidate, run_t, region_t = state.as_tuple()
            return pd.DataFrame([[*key, *map(float, (current, run, candidate, run_t, region_t)), bool(short), out]], columns=[*group, *EXITS, "short", "out"])

        return spread(own.unionByName(near), group).groupBy(*group).applyInPandas(
            scan, f"pair_id long, at long, {STATE_DDL}, halo double, {', '.join(f'{e} double' for e in EXITS)}, short boolean, out {OUT_DDL}")

    first = blocks.select("pair_id", "at", F.col("start").alias("current"), F.lit(0.0).alias("run"), F.lit(0.0).alias("candidate"), F.lit(float(halo)).alias("halo"))
    entry, tables, rounds = ["pair_id", "at", *STATE], [], 0
    wanted = first
    while True:
        tables.append(settled(scans(wanted)))
        rounds += 1
        done = tables[0]
        for t in tables[1:]:
            done = done.unionByName(t)
        known = done.filter("not short")
        listed = known.groupBy("pair_id", "at").agg(F.collect_list(F.struct(*STATE, *EXITS)).alias("fn"))
        listed = blocks.select("pair_id", "at", "start").join(listed, ["pair_id", "at"], "left").select("pair_id", "at", F.coalesce("fn", F.array().cast(listed.schema["fn"].dataType)).alias("fn"), "start")
        path = carry.entry_states(settled(listed), ["pair_id"], "at", SCANS, "array<double>", lambda s: None if s is None else list(s))
        path = settled(path.filter("state is not null").select("pair_id", "at", *[F.col("state")[i].alias(s) for i, s in enumerate(STATE)],
                                                               F.col("state")[3].alias("run_t"), F.col("state")[4].alias("region_t")))
        stuck = settled(path.join(known.select(*entry), entry, "left_anti").select(*entry))
        if stuck.isEmpty():
            break
        left = known.select("pair_id", "at", *STATE, *EXITS).join(stuck.select("pair_id").distinct(), "pair_id", "left_semi")
        changed = F.lit(False)
        for s in STATE:
            changed = changed | (F.col(f"exit_{s}") != F.col(s))
        ends = [F.col(f"exit_{s}").alias(s) for s in STATE]
        if rounds == 1:
            guess = left.select("pair_id", (F.col("at") + 1).alias("at"), *ends)
        elif rounds == 2:  # chunks entered with what the chunk before left with: those that change it, and the last of them before each chunk
            before = tables[0].filter("not short").select("pair_id", (F.col("at") + 1).alias("at"), *ends)
            marks_ = left.join(before, entry, "left_semi").filter(changed).select("pair_id", (F.col("at") + 1).alias("at"), *ends)
            marks_ = marks_.groupBy("pair_id", "at").agg(F.min(F.struct(*STATE)).alias("s")).select("pair_id", "at", "s.*")
            guess = ordered.last_at_or_before(blocks.join(stuck.select("pair_id").distinct(), "pair_id", "left_semi"), marks_, ["pair_id"], "at", "at", STATE, 4096).filter("current is not null")
        else:
            guess = blocks.select("pair_id", F.col("at").alias("later")).join(stuck, "pair_id").filter("later > at").select("pair_id", F.col("later").alias("at"), *STATE)
        guess = guess.join(blocks.select("pair_id", "at"), ["pair_id", "at"], "left_semi").select(*entry).unionByName(stuck).distinct()
        tried = done.filter("short").groupBy(*entry).agg((F.max("halo") * 4).alias("wider"))
        wanted = (guess.join(known.select(*entry), entry, "left_anti").join(tried, entry, "left")
                  .select(*entry, F.coalesce("wider", F.lit(float(halo))).alias("halo")))
    true = path.join(known.select(*entry, "out"), entry).select("pair_id", "run_t", F.col("region_t").alias("_region"), F.explode("out").alias("o"))
    region = F.when(F.col("o.region_t") == IN_REGION, F.col("_region")).when(F.col("o.region_t") == IN_RUN, F.col("run_t")).otherwise(F.col("o.region_t"))
    return true.select("pair_id", "o.kind", region.alias("region_t"), "o.offset", "o.n"), rounds


def assemble(points: DataFrame, src: DataFrame, initial: DataFrame) -> DataFrame:
    """Regions from hits and changes: offset = median of the hits, else the offset it opened with."""
    keys = ["pair_id", "region_t"]
    opened = (initial.select("pair_id", F.lit(-1.0).alias("region_t"), F.col("offset_ms").cast("double").alias("base"), F.lit(0).cast("long").alias("opening"))
              .unionByName(points.filter("kind = 'change'").select("pair_id", "region_t", F.col("offset").alias("base"), F.col("n").alias("opening"))))
    hits = (points.filter("kind = 'hit'").withColumn("half_us", F.bround(F.col("offset") * 1000, 0).cast("long"))
            .groupBy(*keys, "half_us").agg(F.sum("n").alias("n")))
    med = ordered.true_median(hits, keys, "half_us", "med", 1 << 20)
    ends = src.groupBy("pair_id").agg(F.max("t_ms").cast("double").alias("last_ms"))
    r = (opened.join(med, keys, "left")
         .withColumn("offset_ms", F.coalesce(F.col("med") / 1000.0, F.col("base")))
         .withColumn("match_count", F.col("opening") + F.coalesce("total", F.lit(0)))
         .withColumn("start_ms", F.greatest(F.col("region_t"), F.lit(0.0)))
         .withColumn("_pos", F.col("region_t").cast("long")))
    r = ordered.with_neighbour(r, ["pair_id"], "_pos", ["start_ms"], CHUNK_MS, "next_", following=True)
    return (r.join(ends, "pair_id").withColumn("end_ms", F.coalesce("next_start_ms", "last_ms"))
            .select("pair_id", "start_ms", "end_ms", "offset_ms", "match_count"))


def split_at_dips(regions: DataFrame, dips: DataFrame, min_region_ms: int = 20_000) -> DataFrame:
    """Cut regions at confirmed dips.

    ``dips``: pair_id, region_start, dip_ms, delta_ms (0 = probe found nothing
    better). Every dip, confirmed or not, counts in the divisor of the match
    count; only confirmed ones cut. Regions shorter than the minimum stay.
    """
    long_enough = (F.col("end_ms") - F.col("start_ms")) >= min_region_ms
    d = dips.join(regions.filter(long_enough).select("pair_id", F.col("start_ms").alias("region_start")), ["pair_id", "region_start"], "left_semi")
    count = d.groupBy("pair_id", "region_start").agg(F.count(F.lit(1)).alias("_dips"))
    base = regions.withColumnRenamed("start_ms", "region_start").join(count, ["pair_id", "region_start"], "left") \
        .withColumn("match_count", F.expr("match_count div (coalesce(_dips, 0) + 1)"))
    heads = base.select("pair_id", "region_start", F.col("region_start").alias("start_ms"), F.lit(0).cast("long").alias("delta_ms"))
    starts = heads.unionByName(d.filter("delta_ms <> 0").select(
        "pair_id", "region_start", F.col("dip_ms").cast(heads.schema["start_ms"].dataType).alias("start_ms"), F.col("delta_ms").cast("long")))
    starts = starts.withColumn("_pos", F.col("start_ms").cast("long")).withColumn("_chunk", ordered.chunk_index(F.col("_pos"), CHUNK_MS))
    keys = ["pair_id", "region_start"]
    shifted = ordered.running_total(starts, keys, "_chunk", ["_pos", "delta_ms"], F.col("delta_ms"), "_shift")
    nexts = ordered.with_neighbour(shifted.drop("_chunk"), keys, "_pos", ["start_ms"], CHUNK_MS, "next_", following=True)
    return (nexts.join(base, keys).withColumn("offset_ms", F.col("offset_ms") + F.col("_shift"))
            .withColumn("end_ms", F.coalesce("next_start_ms", "end_ms"))
            .select("pair_id", "start_ms", "end_ms", "offset_ms", "match_count"))


class Steps:
    """The head of a group after a stretch of regions, by the head before it: constant between breakpoints, or the head itself (NaN).

    ``points`` are the breakpoints, ``on`` the values at them, ``off`` those between (one more).
    """

    def __init__(self, points: np.ndarray, on: np.ndarray, off: np.ndarray):
        # a breakpoint that changes nothing goes
        same = lambda x, y: (x == y) | (np.isnan(x) & np.isnan(y))
        keep = ~(same(on, off[:-1]) & same(on, off[1:]))
        self.points, self.on, self.off = points[keep], on[keep], off[np.r_[True, keep]]

    def told(self, head: float) -> float:
        at = int(np.searchsorted(self.points, head))
        return float(self.on[at] if at < len(self.points) and self.points[at] == head else self.off[at])

    def __call__(self, head: float) -> float:
        value = self.told(head)
        return head if np.isnan(value) else value

    @staticmethod
    def _sampled(points: np.ndarray, fn) -> Steps:
        """The function ``fn`` (NaN for the head itself), which changes at ``points`` only."""
        between = np.r_[points[0] - 1e6, (points[1:] + points[:-1]) / 2, points[-1] + 1e6] if len(points) else np.zeros(1)
        return Steps(points, np.array([fn(x) for x in points], float), np.array([fn(x) for x in between], float))

    @staticmethod
    def of(offsets: np.ndarray, tolerance: float) -> Steps:
        """The stretch of these regions: the first region that leaves the head's group opens the next, and so on."""
        high, low = np.maximum.accumulate(offsets), np.minimum.accumulate(offsets)
        rises, falls = np.flatnonzero(np.r_[True, high[1:] > high[:-1]]), np.flatnonzero(np.r_[True, low[1:] < low[:-1]])
        last: dict[int, float] = {}

        def leave(head: float) -> float:
            at, path = first_beyond(offsets, 0, head, tolerance), []
            while at < len(offsets) and at not in last:
                path.append(at)
                at = first_beyond(offsets, at + 1, offsets[at], tolerance)
            end = last[at] if at in last else offsets[path[-1]] if path else np.nan
            last.update(dict.fromkeys(path, end))
            return end

        edges = np.r_[high[rises] - tolerance, low[falls] + tolerance]
        edges = edges[np.abs(edges - offsets[0]) <= 4 * tolerance]  # within an island no head is further from the next region
        # rounding may move an edge by one step of a double
        return Steps._sampled(np.unique(np.r_[edges, np.nextafter(edges, np.inf), np.nextafter(edges, -np.inf)]), leave)

    def then(self, other: Steps) -> Steps:
        def both(head: float) -> float:
            mine = self.told(head)
            return other.told(head) if np.isnan(mine) else other(mine)

        return Steps._sampled(np.unique(np.r_[self.points, other.points]), both)


def first_beyond(offsets: np.ndarray, start: int, head: float, tolerance: float) -> int:
    """The first place from ``start`` on whose offset is ``tolerance`` or more from ``head``; the length if none is."""
    size = 64
    while start < len(offsets):
        far = np.abs(offsets[start:start + size] - head) >= tolerance
        if far.any():
            return start + int(far.argmax())
        start, size = start + size, size * 2
    return len(offsets)


HEADS = carry.Algebra(carry.load, Steps.then, lambda f, head: f(head))


def merge_equal(regions: DataFrame, tolerance_ms: float = 1.0, chunk: int = 2048, fan: int = carry.FAN) -> DataFrame:
    """Merge neighbours whose offset is within tolerance of the *first* of their group.

    A jump of twice the tolerance always starts a group, whatever came before,
    and exact repeats never do. Both cut the series without looking back. What is
    left between two jumps is an island of small steps. One of up to ``chunk`` runs is
    followed as a list; a longer one is cut into chunks of so many runs. A chunk is a step function from the group's first offset that
    enters it to the one that leaves it; these are composed in a tree (``carry``), and
    then all chunks mark the first runs of their groups in parallel.
    """
    rows = regions.withColumn("_pos", F.col("start_ms").cast("long"))
    prev = ordered.with_neighbour(rows, ["pair_id"], "_pos", ["offset_ms"], CHUNK_MS, "prev_")
    step = F.abs(F.col("offset_ms") - F.col("prev_offset_ms"))
    flagged = (prev.withColumn("_new", F.when(F.col("prev_offset_ms").isNull() | (step > 0), 1).otherwise(0))
               .withColumn("_hard", F.when(F.col("prev_offset_ms").isNull() | (step >= 2 * tolerance_ms), 1).otherwise(0))
               .withColumn("_chunk", ordered.chunk_index(F.col("_pos"), CHUNK_MS)))
    numbered = ordered.running_totals(flagged, ["pair_id"], "_chunk", ["_pos"], {"_run": F.col("_new"), "_island": F.col("_hard")})
    runs = settled(numbered.groupBy("pair_id", "_island", "_run").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "_pos").alias("end_ms"),
        F.min_by("offset_ms", "_pos").alias("offset_ms"), F.sum("match_count").alias("match_count")))
    keys = ["pair_id", "_island"]
    extent = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs"), F.min("_run").alias("_first"))
    out = ["pair_id", "start_ms", "end_ms", "offset_ms", "match_count"]
    single = runs.join(extent.filter("_runs = 1").select(*keys), keys, "left_semi").select(*out)
    # an island of one chunk is one short list
    lists = (runs.join(extent.filter(F.col("_runs").between(2, chunk)).select(*keys), keys, "left_semi")
             .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*out[1:]))).alias("_l")))
    start = F.struct(F.lit(float("inf")).alias("head"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("group"))

    def fold(a, x):
        opens = F.abs(x["offset_ms"] - a["head"]) >= tolerance_ms
        n = a["n"] + F.when(opens, 1).otherwise(0)
        return F.struct(F.when(opens, x["offset_ms"].cast("double")).otherwise(a["head"]).alias("head"), n.alias("n"), F.concat(a["group"], F.array(n)).alias("group"))

    listed = (lists.withColumn("_group", F.aggregate("_l", start, fold)["group"])
              .select(*keys, F.explode(F.arrays_zip("_l", "_group")).alias("_z")).select(*keys, "_z._l.*", "_z._group"))
    small = runs.join(extent.filter(F.col("_runs") > chunk), keys).withColumn("_at", F.expr(f"(_run - _first) div {chunk}").cast("long"))
    small = settled(small.select(*keys, "_at", *out[1:]))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ms")
        head = pdf.iloc[0]
        fn = Steps.of(pdf["offset_ms"].to_numpy(float), tolerance_ms)
        return pd.DataFrame([[head["pair_id"], head["_island"], head["_at"], carry.dump(fn), carry.dump(float("inf"))]], columns=[*keys, "_at", "fn", "start"])

    kinds = ", ".join(f"{k} {t}" for k, t in small.dtypes if k in (*keys, "_at"))
    tables = settled(spread(small.select(*keys, "_at", "start_ms", "offset_ms"), [*keys, "_at"]).groupBy(*keys, "_at").applyInPandas(reduce, f"{kinds}, fn binary, start binary"))
    entries = carry.entry_states(tables, keys, "_at", HEADS, "double", float, fan).withColumnRenamed("state", "_head")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_ms").reset_index(drop=True)
        offsets, opens = pdf["offset_ms"].to_numpy(float), np.zeros(len(pdf), np.int64)
        at = first_beyond(offsets, 0, pdf["_head"].iloc[0], tolerance_ms)
        while at < len(offsets):
            opens[at] = 1
            at = first_beyond(offsets, at + 1, offsets[at], tolerance_ms)
        return pdf.drop(columns="_head").assign(_opens=opens)

    marked = spread(small.join(entries, [*keys, "_at"]), [*keys, "_at"]).groupBy(*keys, "_at").applyInPandas(
        mark, ", ".join(f"{k} {t}" for k, t in small.dtypes) + ", _opens long")
    grouped = ordered.running_total(settled(marked), keys, "_at", ["start_ms"], F.col("_opens"), "_group")
    def merged(rows):
        return rows.groupBy(*keys, "_group").agg(F.max_by("end_ms", "start_ms").alias("end_ms"), F.min_by("offset_ms", "start_ms").alias("offset_ms"),
                                                 F.sum("match_count").alias("match_count"), F.min("start_ms").alias("start_ms")).select(*out)

    return single.unionByName(merged(listed)).unionByName(merged(grouped))


def transitions(regions: DataFrame) -> DataFrame:
    """Every region with the offset and end of the one after it, and the default crossover."""
    rows = regions.withColumn("_pos", F.col("start_ms").cast("long"))
    rows = ordered.with_neighbour(rows, ["pair_id"], "_pos", ["start_ms", "offset_ms", "end_ms"], CHUNK_MS, "next_", following=True)
    rows = ordered.with_neighbour(rows, ["pair_id"], "_pos", ["start_ms"], CHUNK_MS, "prev_")
    return rows.filter("next_offset_ms is not null").drop("_pos")


def search_range(trans: DataFrame) -> DataFrame:
    """Where to look for the exact crossover of each transition, ms; the middle is the fallback."""
    low = F.col("start_ms") + F.when(F.col("prev_start_ms").isNotNull(), 10_000.0).otherwise(0.0)
    out = trans.withColumn("search_start", F.greatest(low, F.lit(5000.0))) \
        .withColumn("search_end", F.least(F.col("end_ms") + 10_000.0, F.col("next_end_ms")))
    return out.withColumn("crossover_ms", (F.col("search_start") + F.col("search_end")) / 2.0)


def edit_operations(trans: DataFrame, crossover: str, inverse: float = 1.0) -> DataFrame:
    """Offset up: insert silence; offset down: cut a segment. Durations and times round half to even."""
    old, new = F.col("offset_ms"), F.col("next_offset_ms")
    lang = F.bround(F.col(crossover) - old, 0)
    if abs(inverse - 1.0) > 0.0001:
        lang = F.bround(lang * inverse, 0)
    return trans.select(
        "pair_id", F.when(new > old, "INSERT_SILENCE").otherwise("CUT_SEGMENT").alias("type"),
        lang.cast("long").alias("lang_ts_ms"), F.abs(F.bround(new - old, 0)).cast("long").alias("duration_ms"),
        F.bround(F.col(crossover), 0).cast("long").alias("source_ts_ms"))


def kept_segments(ops: DataFrame, key: str = "pair_id", audio: bool = True) -> DataFrame:
    """Kept intervals and silence gaps from ordered edit operations; the tail is open.

    ``ops``: key, op_idx, type, lang_ts_ms, duration_ms. Empty intervals drop out.
    """
    end = F.col("lang_ts_ms") + F.when(F.col("type") == "CUT_SEGMENT", F.col("duration_ms")).otherwise(0)
    ended = ops.withColumn("op_end", end)
    rows = ordered.with_neighbour(ended, [key], "op_idx", ["op_end"], 4096, "prev_")
    start = F.coalesce("prev_op_end", F.lit(0))
    def part(number, kind, begin, stop):
        return F.struct(F.lit(number).alias("part"), F.lit(kind).alias("kind"), begin.cast("long").alias("start_ms"), stop.cast("long").alias("end_ms"))
    parts = [F.when(F.col("lang_ts_ms") > start, part(0, "keep", start, F.col("lang_ts_ms")))]
    if audio:
        parts.append(F.when(F.col("type") == "INSERT_SILENCE", part(1, "silence", F.lit(0), F.col("duration_ms"))))
    inner = rows.select(key, "op_idx", F.explode(F.array_compact(F.array(*parts))).alias("_p")).select(key, "op_idx", "_p.*")
    tail = ended.groupBy(key).agg(F.max("op_idx").alias("_last"), F.max_by("op_end", "op_idx").alias("start_ms")).select(
        key, (F.col("_last") + 1).alias("op_idx"), F.lit(0).alias("part"), F.lit("keep").alias("kind"), "start_ms", F.lit(None).cast("long").alias("end_ms"))
    return inner.unionByName(tail)


def retime(cues: DataFrame, segments: DataFrame, gap_modes: tuple[str, ...] = ("reference",), key: str = "pair_id", span: int = CHUNK_MS) -> DataFrame:
    """Move cues by the kept intervals; cues inside a cut go, cues across one are clipped.

    ``gap_modes``: "reference" ignores inserted silence, "shift" moves what follows it;
    all modes come from one pass, with a column ``gap_mode``. Both cue edges are looked
    up as-of, so no interval join is needed.
    """
    segments = settled(segments)
    length = F.coalesce("end_ms", F.lit(1 << 60)) - F.col("start_ms")
    clocks = {"reference": F.when(F.col("kind") == "keep", length).otherwise(0), "shift": length}
    outs = [f"out_{m}" for m in gap_modes]
    parts = segments.withColumn("_pos", F.col("op_idx") * 2 + F.col("part")).withColumn("_chunk", ordered.chunk_index(F.col("_pos"), 4096))
    placed = ordered.running_totals(parts, [key], "_chunk", ["_pos"], {f"out_{m}": clocks[m] for m in gap_modes}, exclusive=True)
    kept = placed.drop("_chunk").filter("kind = 'keep'")
    nexts = [f"next_{o}" for o in outs]
    marks = settled(ordered.with_neighbour(kept, [key], "_pos", outs, 4096, "next_", following=True).select(
        key, F.col("start_ms").alias("seg_start"), (F.col("start_ms") + length).alias("seg_end"), *outs, *nexts))
    def shown(rows, starts, ends):
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("gap_mode"), starts(m).alias("new_start_ms"), ends(m).alias("new_end_ms")) for m in gap_modes]))
        return rows.withColumn("_m", each).select(*names, "_m.*")
    names = cues.columns
    whole = shown(cues.join(segments.select(key).distinct(), key, "left_anti"), lambda m: F.col("start_ms"), lambda m: F.col("end_ms"))
    cues = cues.withColumn("_last", F.col("end_ms") - 1)  # an end on a boundary belongs to the part before it
    edges = cues.select(key, F.explode(F.array("start_ms", "_last")).alias("t"))
    cols = ["seg_start", "seg_end", *outs, *nexts]
    at = settled(ordered.last_at_or_before(edges, marks.withColumn("_m0", F.col("seg_start")), [key], "t", "_m0", cols, span))
    def edge(name):
        return at.select(key, F.col("t").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    j = cues.join(edge("start_ms"), [key, "start_ms"]).join(edge("_last"), [key, "_last"])
    def new_start(m):
        inside = F.col(f"start_ms_out_{m}") + F.col("start_ms") - F.col("start_ms_seg_start")
        return F.when(F.col("start_ms_seg_start").isNull(), F.lit(0)).when(F.col("start_ms") < F.col("start_ms_seg_end"), inside) \
            .otherwise(F.col(f"start_ms_next_out_{m}"))
    def new_end(m):
        return F.col(f"_last_out_{m}") + F.least(F.col("end_ms"), F.col("_last_seg_end")) - F.col("_last_seg_start")
    return shown(j, new_start, new_end).filter("new_start_ms < new_end_ms").unionByName(whole)


def probe_grid(dips: DataFrame, settings: PiecewiseSettings, inverse: float = 1.0) -> DataFrame:
    """Probe positions after each dip: every margin with every offset step, from fixed lists."""
    margins = F.posexplode(F.array(*[F.lit(int(m * 1000)) for m in settings.probe_margins_sec]))
    deltas = F.posexplode(F.array(*[F.lit(x) for x in settings.probe_deltas_ms]))
    g = dips.select("*", margins.alias("margin_no", "margin_ms")).select("*", deltas.alias("delta_no", "delta_ms"))
    src = F.col("dip_ms") + F.col("margin_ms")
    return (g.withColumn("src_start", src)
            .withColumn("lang_start", (src - F.col("offset_ms") - F.col("delta_ms")) * inverse)
            .withColumn("dur_ms", F.lit(int(settings.probe_duration_sec * 1000))).filter("lang_start >= 0"))


def probe_consensus(probes: DataFrame, keys: list[str], settings: PiecewiseSettings) -> DataFrame:
    """Best step per probe point, and the step all points agree on (0 without agreement).

    Only points with at least two source frames count; a better score must be strictly better.
    """
    usable = probes.filter("src_frames >= 2")
    scored = F.when((F.col("lang_frames") >= 2) & (F.col("mean_ssim") > 0), F.struct("mean_ssim", -F.col("delta_no")))
    best = usable.groupBy(*keys, "margin_no").agg(
        F.coalesce(F.max_by("delta_ms", scored), F.lit(0)).alias("delta_ms"), F.coalesce(F.max(scored)["mean_ssim"], F.lit(0.0)).alias("ssim"))
    agg = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min("delta_ms").alias("_lo"), F.max("delta_ms").alias("_hi"), F.min("ssim").alias("min_ssim"))
    ok = (F.col("points") >= settings.probe_min_points) & (F.col("_lo") == F.col("_hi")) & (F.col("min_ssim") >= settings.probe_min_ssim)
    return agg.select(*keys, "points", "min_ssim", F.when(ok, F.col("_lo")).otherwise(0).cast("long").alias("delta_ms"))


def global_check(points: DataFrame, keys: list[str], settings: PiecewiseSettings, floor_mse: float = 100.0) -> DataFrame:
    """Share of verify points below max(multiplier x mean, floor); pass at the minimum ratio."""
    mean = points.groupBy(*keys).agg(F.avg("mse").alias("baseline_mse"))
    limit = F.greatest(F.col("baseline_mse") * settings.verify_mse_multiplier, F.lit(floor_mse))
    return (points.join(mean, keys).groupBy(*keys).agg(
        F.any_value("baseline_mse").alias("baseline_mse"), F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("mse") < limit).alias("valid_points"))
        .withColumn("verified", F.col("valid_points") / F.col("points") >= settings.verify_min_ratio))
