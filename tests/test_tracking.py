"""Tracking scores against plain loops over sequences, frames and thresholds."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from gridloom.operators import tracking


def iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    both = max(w, 0) * max(h, 0)
    return both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)


def scene(seed, seqs=3, frames=5):
    """Truth and detections (seq, frame, track, det, cls, box) with jitter, misses, swaps, strays and a sequence of one side only."""
    rnd = random.Random(seed)
    truth, found, n = [], [], itertools.count(1)
    for s in range(seqs):
        for f in range(frames):
            names = list(range(4))
            if rnd.random() < 0.3:
                names[0], names[1] = names[1], names[0]
            for t in range(4):
                x, y = 20 * t + rnd.uniform(0, 9) + 3 * f, rnd.uniform(0, 15)
                if rnd.random() < 0.9:
                    truth.append((s, f, t, next(n), "ab"[t % 2], (x, y, x + 20, y + 20)))
                if rnd.random() < 0.85:
                    dx, dy = rnd.uniform(-5, 5), rnd.uniform(-5, 5)
                    found.append((s, f, names[t], next(n), rnd.choice("aabbc"), (x + dx, y + dy, x + 20 + dx, y + 20 + dy)))
            if rnd.random() < 0.5:
                x, y = rnd.uniform(0, 90), rnd.uniform(0, 30)
                found.append((s, f, 9, next(n), "a", (x, y, x + 18, y + 18)))
    truth += [(50, 0, 0, next(n), "a", (0, 0, 9, 9))]
    found += [(60, 0, 0, next(n), "a", (0, 0, 9, 9))]
    return truth, found


def solve(gain):
    """The best assignment by trying all."""
    n, m = gain.shape
    if n > m:
        return [(j, i) for i, j in solve(gain.T)]
    best = max(itertools.permutations(range(m), n), key=lambda p: sum(gain[i, j] for i, j in enumerate(p)), default=())
    return [(i, j) for i, j in enumerate(best) if gain[i, j] > 0]


def align(gts, tks):
    """Score of each pair of tracks of one sequence; gts and tks are lists of detections."""
    m, n_g, n_t = defaultdict(float), defaultdict(int), defaultdict(int)
    for f in {d[1] for d in gts} | {d[1] for d in tks}:
        g, t = [d for d in gts if d[1] == f], [d for d in tks if d[1] == f]
        sim = np.array([[iou(a[5], b[5]) for b in t] for a in g]).reshape(len(g), len(t))
        for i, a in enumerate(g):
            for j, b in enumerate(t):
                if sim[i, j] > 0:
                    m[a[2], b[2]] += sim[i, j] / (sim[i].sum() + sim[:, j].sum() - sim[i, j])
        for d in g:
            n_g[d[2]] += 1
        for d in t:
            n_t[d[2]] += 1
    return {(a, b): v / (n_g[a] + n_t[b] - v) for (a, b), v in m.items()}, n_g, n_t


def matches(gts, tks):
    """(truth, detection, similarity) of every frame's assignment."""
    score, n_g, n_t = align(gts, tks)
    out = []
    for f in sorted({d[1] for d in gts}):
        g, t = [d for d in gts if d[1] == f], [d for d in tks if d[1] == f]
        sim = np.array([[iou(a[5], b[5]) for b in t] for a in g]).reshape(len(g), len(t))
        gain = np.array([[score.get((a[2], b[2]), 0) * sim[i, j] for j, b in enumerate(t)] for i, a in enumerate(g)]).reshape(len(g), len(t))
        out += [(g[i], t[j], sim[i, j]) for i, j in solve(gain)] if len(g) and len(t) else []
    return out, n_g, n_t


def common(hits, n_g, n_t):
    c = defaultdict(int)
    for a, b, _ in hits:
        c[a[2], b[2]] += 1
    return sum(n * n / (n_g[a] + n_t[b] - n) for (a, b), n in c.items())


def pairs_of(truth, found):
    return [(a[3], b[3], iou(a[5], b[5])) for a in truth for b in found if a[:2] == b[:2] and iou(a[5], b[5]) > 0]


def tables(spark, truth, found):
    schema = "seq long, frame long, track long, det long, cls string"
    return spark.createDataFrame([d[:5] for d in truth], schema), spark.createDataFrame([d[:5] for d in found], schema), spark.createDataFrame(pairs_of(truth, found), "a long, b long, sim double")


@pytest.mark.parametrize("seed", [1, 2])
def test_hota_by_plain_loops(spark, seed):
    truth, found = scene(seed)
    got = {(r.seq, r.alpha): r for r in tracking.hota(*tables(spark, truth, found)).collect()}
    total = defaultdict(lambda: np.zeros(5))
    for s in {d[0] for d in truth + found}:
        gts, tks = [d for d in truth if d[0] == s], [d for d in found if d[0] == s]
        every, n_g, n_t = matches(gts, tks)
        for alpha in range(5, 100, 5):
            hits = [h for h in every if h[2] >= alpha / 100 - 2e-16]
            tp, fn, fp = len(hits), len(gts) - len(hits), len(tks) - len(hits)
            ass, loc = common(hits, n_g, n_t), sum(h[2] for h in hits)
            r = got.pop((s, alpha))
            assert (r.tp, r.fn, r.fp) == (tp, fn, fp)
            assert np.allclose([r.det_a, r.ass_a, r.loc_a, r.hota, r.owta], [tp / max(1, tp + fn + fp), ass / max(1, tp), loc / tp if tp else 1, (tp / max(1, tp + fn + fp) * ass / max(1, tp)) ** 0.5, (tp / max(1, tp + fn) * ass / max(1, tp)) ** 0.5])
            total[alpha] += [tp, fn, fp, ass, loc]
    for alpha, (tp, fn, fp, ass, loc) in total.items():
        r = got.pop((None, alpha))
        assert (r.tp, r.fn, r.fp) == (tp, fn, fp)
        assert np.allclose([r.ass_a, r.loc_a, r.hota], [ass / max(1, tp), loc / tp if tp else 0, (tp / max(1, tp + fn + fp) * ass / max(1, tp)) ** 0.5])
    assert not got


@pytest.mark.parametrize("exclusive", [True, False])
def test_teta_by_plain_loops(spark, exclusive):
    truth, found = scene(5)
    got = {(r.cls, r.alpha): r for r in tracking.teta(*tables(spark, truth, found), exclusive=exclusive).collect()}
    classes, seqs = sorted({d[4] for d in truth}), {d[0] for d in truth}
    count = {c: np.zeros((20, 6)) for c in classes}  # tp, fn, fp, cls_tp, cls_fn, cls_fp
    ass = {c: np.zeros(20) for c in classes}
    near = lambda gts, tks: {b[3] for a in gts for b in tks if a[:2] == b[:2] and iou(a[5], b[5]) >= 0.5}
    tracked = lambda dets, tks: [d for d in tks if d[2] in {x[2] for x in tks if x[3] in dets}]
    for s in seqs:
        gts, tks = [d for d in truth if d[0] == s], [d for d in found if d[0] == s]
        owner = {b[3]: a[4] for a, b, sim in matches(gts, tracked(near(gts, tks), tks))[0] if sim >= 0.5} if exclusive else {}
        for c in classes:
            mine = [d for d in gts if d[4] == c]
            inside = {b for b in near(mine, tks) if owner.get(b, c) == c}
            own = tracked(inside, tks)
            every, n_g, n_t = matches(mine, own)
            loose = []
            for f in {d[1] for d in mine}:
                free = [sorted((d for d in side if d[1] == f and d[3] not in {h[k][3] for h in every}), key=lambda d: d[2]) for k, side in enumerate((mine, own))]
                loose += [(a, b, 0.0) for a, b in zip(*free, strict=False)]
            blamed = [b[3] for b in own if b[3] in inside and any(a[1] == b[1] and iou(a[5], b[5]) >= 0.5 for a in mine)]
            for k in range(20):
                hits = [h for h in every + loose if h[2] >= k * 5 / 100 - 2e-16]
                count[c][k, :3] += len(hits), len(mine) - len(hits), len(set(blamed) - {h[1][3] for h in hits})
                ass[c][k] += common(hits, n_g, n_t)
                if k >= 10:
                    count[c][k, 3:5] += sum(h[1][4] == c for h in hits), sum(h[1][4] != c for h in hits)
                    for h in hits:
                        if h[1][4] != c and h[1][4] in classes:
                            count[h[1][4]][k, 5] += 1
    for c in classes:
        cls_a = np.mean([x[3] / max(1, x[3:].sum()) for x in count[c][10:]])
        for k in range(20):
            r, x = got.pop((c, k * 5)), count[c][k]
            assert (r.loc_tp, r.loc_fn, r.loc_fp, r.cls_tp, r.cls_fn, r.cls_fp) == tuple(x)
            loc, asso = x[0] / max(1, x[:3].sum()), ass[c][k] / max(1, x[0])
            assert np.allclose([r.loc_a, r.assoc_a, r.cls_a, r.teta], [loc, asso, cls_a, (loc + asso + cls_a) / 3])
    assert {k for k in got} == {(None, a) for a in range(0, 100, 5)}


def test_tracking_without_rows(spark):
    truth, found, pairs = tables(spark, *scene(1))
    assert tracking.hota(truth.limit(0), found, pairs).filter("tp > 0").count() == 0
    assert tracking.teta(truth, found.limit(0), pairs).filter("loc_tp > 0 or loc_fp > 0").count() == 0
    assert tracking.teta(truth.limit(0), found, pairs).count() == 0


def test_frames_are_solved_without_rounds(spark, monkeypatch):
    from gridloom.operators import assign

    rnd = random.Random(3)
    rows = [(f, 100 * f + i, 100 * f + j, rnd.random()) for f in range(12) for i in range(5) for j in range(6) if rnd.random() < 0.4]
    pairs = spark.createDataFrame(rows, "frame long, a long, b long, iou double")
    plain = sorted(map(tuple, assign.optimal_pairs(pairs).collect()))
    assert sorted(map(tuple, assign.optimal_pairs(pairs, ["frame"], 9).collect())) == plain  # some frames by rounds
    monkeypatch.setattr(assign, "components_of", lambda *_: pytest.fail("rounds over frames that a task can hold"))
    assert sorted(map(tuple, assign.optimal_pairs(pairs, ["frame"]).collect())) == plain
    assert tracking.hota(*tables(spark, *scene(1))).filter("tp > 0").count() > 0
