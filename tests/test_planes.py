"""Planes of pixels against plain versions on drawn ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import kernels
from lodeframe.operators import planes
from lodeframe.operators.components import connected


def table(spark, drawn):
    rows = [(k, y, [float(v) for v in row]) for k, p in drawn.items() for y, row in enumerate(p)]
    return spark.createDataFrame(rows, "k int, y int, v array<double>").repartition(4)


def draw(rng, h, w, lines):
    """Dark words in two columns on a light plane, and some dust."""
    p = np.full((h, w), 250)
    for i in range(lines):
        top = 12 + i * 22 + rng.randrange(3)
        for left in (10, w // 2 + 8):
            if rng.random() < 0.85:
                x = left + rng.randrange(3)
                for _ in range(rng.randrange(1, 4)):
                    n = rng.randrange(12, 30)
                    p[top : top + rng.randrange(9, 13), x : min(x + n, w)] = 20
                    x += n + rng.randrange(2, 12)
    for _ in range(h * w // 200):
        p[rng.randrange(h), rng.randrange(w)] = 10
    return p


def flood(mask):
    left, out = {(y, x) for y, x in zip(*np.nonzero(mask))}, []
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        ys, xs = [y for y, _ in part], [x for _, x in part]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return sorted(out)


def test_parts_are_those_of_a_flood_fill(spark):
    rng = np.random.default_rng(2)
    drawn = {i: rng.random((rng.integers(1, 40), rng.integers(1, 40))) < share for i, share in enumerate((0.2, 0.4, 0.55, 0.7, 1.0, 0.0, 0.6))}
    spiral = np.zeros((31, 31), bool)
    y = x = 15
    for i, n in enumerate(range(2, 30, 2)):
        for dy, dx in (((0, 1), (1, 0)), ((0, -1), (-1, 0)))[i % 2]:
            for _ in range(n):
                if 0 <= y < 31 and 0 <= x < 31:
                    spiral[y, x] = True
                y, x = y + dy, x + dx
    drawn[7] = spiral
    runs = planes.runs_of(table(spark, drawn), ["k"], "y", "v", lambda v: v > 0)
    got = {k: [] for k in drawn}
    for r in planes.parts(runs, ["k"]).collect():
        got[r["k"]].append((r["x"], r["y"], r["w"], r["h"], r["area"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: flood(p) for k, p in drawn.items()}
    assert kernels.components(spiral) == flood(spiral)


def test_connected(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 1), (3000, None)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert found == {x: find(x) for x in root if find(x) != x}
    assert connected(spark.createDataFrame([], "a int, b int")).collect() == []


def plain_rows(p, dark, top, bottom, gold, stars=False):
    """Rows, blocks and columns of one plane by profiles of its pixels, or the stars below each."""
    h, w = p.shape
    near = lambda x: int(np.floor(x + 0.5))
    median = lambda xs: sorted(xs)[len(xs) // 2]
    ink = p < dark
    runs = lambda c, t, gap, lo, hi: [(a + lo, b + lo) for a, b in kernels.find_runs(np.asarray(c)[lo:hi], t, gap)]
    bands = runs(ink.sum(1), max(5, near(w * 0.01)), max(6, near(h * 0.004)), top, bottom)
    if len(bands) < 3:
        return []
    med = median([b - a + 1 for a, b in bands])
    bands = [(a, b) for a, b in bands if max(8, med * 0.55) <= b - a + 1 <= med * 2]
    if len(bands) < 3:
        return []
    bands = [(a, b) for a, b in bands if gold[a : b + 1].sum() / ((b - a + 1) * w) <= 0.015]
    blocks = [(i, x0, x1) for i, (a, b) in enumerate(bands) for x0, x1 in runs(ink[a : b + 1].sum(0), 1, max(18, near(w * 0.03)), 0, w) if x1 - x0 + 1 >= max(10, near(w * 0.02))]
    if len(bands) < 3 or len(blocks) < 3:
        return []
    tol, columns, last = max(12, near(w * 0.02)), [], None
    for x in sorted(b[1] for b in blocks):
        if last is None or x - last > tol:
            columns.append([])
        columns[-1].append(x)
        last = x
    columns = sorted(median(c) for c in columns if len(c) >= 3)
    out = []
    for i, x0, x1 in blocks:
        col = next((c for c, x in enumerate(columns) if abs(x0 - x) <= tol * 1.5), None)
        if col is not None:
            x, y = max(0, x0 - 4), max(0, bands[i][0] - 4)
            if stars:
                a, b = bands[i]
                gaps = [q[0] - o[1] for o, q in zip(bands, bands[1:])]
                last = i + 1 == len(bands)
                stop = min(h, b + (median(gaps) if gaps and median(gaps) > 0 else 2 * (b - a + 1))) if last else bands[i + 1][0] - 1
                right = columns[col + 1] - near(w * 0.03) if col + 1 < len(columns) else w
                seen = gold[b + 1 : stop, columns[col] : right].any(0)
                out.append((i, col, x0, min(3, len(kernels.find_runs(seen, 1, 1))) if stop > b + 1 else 0, not last and stop > b + 1))
                continue
            out.append((i, col, x, y, min(w - x, x1 - x0 + 9), min(h - y, bands[i][1] - bands[i][0] + 9)))
    return sorted(out) if len(out) >= 3 else []


def test_text_rows_are_those_of_pixel_profiles(spark):
    rng = random.Random(6)
    drawn = {i: draw(rng, rng.choice([150, 260]), rng.choice([160, 400]), rng.randrange(1, 11)) for i in range(14)}
    for i, p in drawn.items():
        if i % 3 == 0:
            p[34:44, 5:60] = 0  # stars, which count as gold
    rows = table(spark, drawn)
    ink, gold = (planes.runs_of(rows, ["k"], "y", "v", on) for on in (lambda v: v < 80, lambda v: v == 0))
    sizes = spark.createDataFrame([(k, p.shape[1], p.shape[0], 9, p.shape[0] - 5) for k, p in drawn.items()], "k int, w int, h int, top int, bottom int")
    got = {k: [] for k in drawn}
    for r in planes.text_rows(ink, sizes, ["k"], gold=gold).collect():
        got[r["k"]].append((r["band"], r["col"], r["x"], r["y"], r["w"], r["h"]))
    want = {k: plain_rows(p, 80, 9, p.shape[0] - 5, p == 0) for k, p in drawn.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sum(map(bool, want.values())) > 5 and not all(want.values())


def test_stars_below_the_texts(spark):
    rng = random.Random(12)
    drawn = {i: draw(rng, 260, 400, 10) for i in range(6)}
    for p in drawn.values():
        for _ in range(40):
            y, x, n = rng.randrange(12, 250), rng.randrange(390), rng.randrange(1, 4)
            for k in range(n):
                p[y : y + 3, x + 5 * k : x + 5 * k + rng.choice([2, 3, 4])] = 200
    rows = table(spark, drawn)
    ink, gold = (planes.runs_of(rows, ["k"], "y", "v", on) for on in (lambda v: v < 80, lambda v: v == 200))
    sizes = spark.createDataFrame([(k, 400, 260, 9, 255) for k in drawn], "k int, w int, h int, top int, bottom int")
    got = {k: [] for k in drawn}
    for r in planes.star_counts(ink, gold, sizes, ["k"]).collect():
        got[r["k"]].append((r["band"], r["col"], r["x0"], r["stars"], r["reliable"]))
    want = {k: plain_rows(p, 80, 9, 255, p == 200, stars=True) for k, p in drawn.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert {s for v in want.values() for *_, s, _ in v} == {0, 1, 2, 3}


def test_colour_masks_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(3)
    rgba = rng.integers(0, 256, (6, 300, 4), dtype=np.uint8)
    rgba[0, :100] = [[230, 180, 40, 255]]
    rgba[1, :100, :3] = rgba[1, :100, :1]
    rows = [(y, [tuple(int(c) for c in px[:3]) for px in row]) for y, row in enumerate(rgba)]
    df = spark.createDataFrame(rows, "y int, v array<struct<r:int,g:int,b:int>>").withColumn("k", F.lit(0))
    for name, on in planes.colour_masks().items():
        got = np.zeros(rgba.shape[:2], bool)
        for r in planes.runs_of(df, ["k"], "y", "v", on).collect():
            got[r["y"], r["x0"] : r["x1"] + 1] = True
        assert (got == kernels.color_masks(rgba)[name]).all(), name


@pytest.mark.parametrize("frames", [1, 2, 4])
def test_edges_of_scrolled_screens(spark, frames):
    rng = np.random.default_rng(frames)
    h, w = 400, 60
    body = rng.integers(0, 256, (2000, w))
    head, foot, rim = rng.integers(0, 256, (37, w)), rng.integers(0, 256, (60, w)), rng.integers(0, 256, (130, w))
    screens = []
    for i in range(frames):
        low = rim.copy()
        screens.append(np.concatenate([head, body[i * 40 : i * 40 + h - 227], low, foot]))
    rows = [(1, i, y, [float(v) for v in row]) for i, s in enumerate(screens) for y, row in enumerate(s)]
    df = spark.createDataFrame(rows, "k int, frame int, y int, v array<double>")
    found = planes.scrolled_between(df, ["k"])
    got = [tuple(r) for r in found.collect()]
    assert got == ([(1, 37, h - 190)] if frames > 1 else [])
    lax = spark.createDataFrame([(1, 37, h)], "k int, header int, footer int")
    assert [r["footer"] for r in planes.without_fixed_foot(df, lax, ["k"]).collect()] == [h - 190 if frames > 1 else h]


def test_seam_search_finds_what_all_shifts_give_with_fewer_pixels(spark):
    rng = np.random.default_rng(8)
    body = np.where(rng.random((600, 50)) < 0.3, 20, 250)
    pairs, saved = [], 0
    for i in range(24):
        h = int(rng.integers(70, 160))
        a = body[: h].copy()
        b = body[int(rng.integers(1, 60)) :][: h].copy()
        if i % 4 == 1:
            b = np.where(rng.random(b.shape) < 0.05, 255 - b, b)
        if i % 4 == 2:
            a[:], b[:] = 255, 255
        if i % 4 == 3:
            a, b = rng.integers(0, 256, a.shape), rng.integers(0, 256, b.shape)
        want = kernels.seam(a, b, 20, 10)
        got, looked = kernels.seam_search(a, b, 20, 10)
        assert got == want
        every = sum((h - d) * 50 for d in range(1, h - 20 + 1))
        alone, few = kernels.seam_search(a, b, 20, 1000)  # without a rival to look for
        assert alone == kernels.seam(a, b, 20, 1000) and few <= looked <= every
        saved += i % 4 < 2 and few < every / 3
        pairs.append((i, [int(v) for v in a.ravel()], [int(v) for v in b.ravel()], 50, want))
    assert saved >= 5
    df = spark.createDataFrame([p[:4] for p in pairs] + [(99, None, [1], 1), (98, [], [], 5), (97, [1, 2], [1], 1)], "k int, a array<int>, b array<int>, w int")
    got = {r["k"]: (r["shift"], r["share"], r["rival"], r["sure"]) for r in planes.seams(df, ["k"], overlap=20, guard=10).collect()}
    for k, _, _, _, want in pairs:
        assert got[k] == ((None,) * 4 if want is None else (want[0], want[1], want[2] if np.isfinite(want[2]) else None, kernels.confident(want)))
    assert got[99] == got[98] == got[97] == (None,) * 4
