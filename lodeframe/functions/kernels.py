"""Image and array kernels in numpy, and the columns that run them in bounded batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gray(rgba: np.ndarray) -> np.ndarray:
    """Luma by 0.299, 0.587, 0.114, rounded down."""
    return np.floor(rgba[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def gray_fixed(rgba: np.ndarray) -> np.ndarray:
    """Luma in integers: (77 R + 150 G + 29 B) >> 8."""
    return (rgba[..., :3].astype(np.int32) @ np.array([77, 150, 29]) >> 8).astype(np.uint8)


def laplacian_variance(g: np.ndarray) -> float:
    """The variance of the 4-neighbour Laplacian over inner pixels."""
    g = g.astype(np.float64)
    if min(g.shape) < 3:
        return 0.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float((lap**2).mean() - lap.mean() ** 2)


def color_masks(rgba: np.ndarray, dark: int = 80) -> dict[str, np.ndarray]:
    """Masks of green and blue (by hue, among clear and bright pixels), gold and dark pixels."""
    r, g, b = (rgba[..., i].astype(np.float64) for i in range(3))
    most, spread = np.maximum(np.maximum(r, g), b), np.ptp(rgba[..., :3].astype(np.float64), axis=-1)
    some = np.where(spread > 0, spread, 1)
    clear = (spread > 0) & (most >= 90) & (spread / np.maximum(most, 1) >= 0.35)
    # Degrees on the colour circle, of pixels in which green or blue is strongest.
    around_green, around_blue = 60 * (2 + (b - r) / some), 60 * (4 + (r - g) / some)
    # The ranges of hue and the levels of gold decide what is found.
    return {
        "green": clear & (most == g) & (around_green >= 65) & (around_green <= 170),
        "blue": clear & (most == b) & (around_blue >= 180) & (around_blue <= 250),
        "gold": (r > 200) & (g > 140) & (r - b > 60), "dark": gray(rgba) < dark,
    }


def find_runs(profile: np.ndarray, threshold: float, gap: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """(first, last) of stretches at or above the threshold, joined over gaps, of ``least`` or more."""
    at = np.flatnonzero(np.asarray(profile) >= threshold)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > gap + 1)
    a, b = at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))]
    return [(int(x), int(y)) for x, y in zip(a, b) if y - x + 1 >= least]


def integral(g: np.ndarray) -> np.ndarray:
    return np.pad(g.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def adaptive_threshold(g: np.ndarray, block: int = 31, c: float = 12) -> np.ndarray:
    """1 where a pixel is darker than its neighbourhood's mean by ``c`` or more; windows are cut at the edges."""
    h, w = g.shape
    s, r = integral(g), block // 2
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    total = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    return (g <= total / ((y1 - y0)[:, None] * (x1 - x0)) - c).astype(np.uint8)


def stretch(g: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """The levels between two percentiles spread over 0 to 255, rounded; a plane without any between them stays as it is."""
    if not g.size:
        return g
    filled = np.bincount(g.ravel(), minlength=256).cumsum()
    a, b = (int(np.argmax(filled >= p * g.size)) for p in (low, high))
    return np.rint(np.clip((g.astype(np.float64) - a) * 255 / (b - a), 0, 255)).astype(np.uint8) if b > a else g


def close(mask: np.ndarray, r: int = 1) -> np.ndarray:
    """Morphological closing with a square."""

    def spread(m, pad, pick):
        p = np.pad(m, r, constant_values=pad)
        views = [p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)]
        return pick(views)

    return spread(spread(mask, 0, lambda v: np.max(v, 0)), 1, lambda v: np.min(v, 0))


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of 4-connected parts, by row runs joined with union-find."""
    root: list[int] = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    spans, above = [], []
    for y, row in enumerate(mask.astype(bool)):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0]))))
        here = []
        for a, b in zip(edge[::2], edge[1::2]):
            k = len(root)
            root.append(k)
            for c, d, j in above:
                if c < b and a < d:
                    root[find(k)] = find(j)
            here.append((a, b, k))
            spans.append((y, int(a), int(b), k))
        above = here
    out: dict[int, list[int]] = {}
    for y, a, b, k in spans:
        o = out.setdefault(find(k), [a, y, b, y + 1, 0])
        o[0], o[1], o[2], o[3], o[4] = min(o[0], a), min(o[1], y), max(o[2], b), max(o[3], y + 1), o[4] + b - a
    return sorted((x0, y0, x1 - x0, y1 - y0, n) for x0, y0, x1, y1, n in out.values())


def ink_height(mask: np.ndarray) -> int:
    rows = np.flatnonzero(mask.any(1))
    return int(rows[-1] - rows[0] + 1) if len(rows) else 0


#: Fixed values of the seam search: the difference of levels that counts, the least rows that overlap, the level from
#: which a pixel is blank, the least share of others, and how far a rival must lie.
DIFFERENT, OVERLAP, BLANK, INK, GUARD = 24, 60, 240, 0.05, 40


def seam(a: np.ndarray, b: np.ndarray, overlap: int = OVERLAP, guard: int = GUARD) -> tuple[int, float, float] | None:
    """(shift, share, rival's share): by how many rows plane ``b`` is scrolled on from ``a``, both of one size.

    The share is that of pixels that differ, over all that overlap; shifts at which less than INK of the pixels are inked
    in either plane tell nothing. Of equals the smallest shift; the rival is the best one more than ``guard`` away, or
    infinite. None if no shift tells anything.
    """
    found = []
    for d in range(1, len(a) - overlap + 1):
        x, y = a[d:].astype(np.int32), b[: len(a) - d].astype(np.int32)
        if ((x < BLANK) | (y < BLANK)).mean() >= INK:
            found.append((float((np.abs(x - y) > DIFFERENT).mean()), d))
    if not found:
        return None
    share, shift = min(found)
    return shift, share, min((r for r, d in found if abs(d - shift) > guard), default=float("inf"))


def seam_search(a: np.ndarray, b: np.ndarray, overlap: int = OVERLAP, guard: int = GUARD, strides: int = 16) -> tuple[tuple[int, float, float] | None, int]:
    """What ``seam`` finds, and how many pixels had to be compared for it.

    Every shift is first measured on one row in ``strides``. What differs there differs for certain, so the share so far,
    of all pixels that overlap, is a lower bound; shifts are carried on only while that is not above the best whole
    share, the most promising first. The rival is looked for in the same way among the shifts that lie far enough off.
    """
    x, y = a.astype(np.int32), b.astype(np.int32)
    h, w = x.shape
    seen = {d: 0 for d in range(1, h - overlap + 1)}
    bad, whole, looked = dict.fromkeys(seen, 0), {}, 0

    def go_on(d: int) -> None:
        nonlocal looked
        at = slice(seen[d], h - d, strides)
        bad[d] += int((np.abs(x[d:][at] - y[: h - d][at]) > DIFFERENT).sum())
        looked += len(range(*at.indices(h - d))) * w
        seen[d] += 1
        if seen[d] == min(strides, h - d):
            inked = ((x[d:] < BLANK) | (y[: h - d] < BLANK)).mean() >= INK
            whole[d] = bad[d] / ((h - d) * w) if inked else None

    def least(shifts: list[int]) -> tuple[float, int] | None:
        bound = lambda d: bad[d] / ((h - d) * w)
        best = None
        for d in shifts:
            if not seen[d]:
                go_on(d)
        for d in sorted(shifts, key=lambda d: (bad[d] / max(1, seen[d]), d)):
            while d not in whole and (best is None or bound(d) <= best[0]):
                go_on(d)
            if whole.get(d) is not None and (best is None or (whole[d], d) < best):
                best = whole[d], d
        return best

    found = least(list(seen))
    if found is None:
        return None, looked
    rival = least([d for d in seen if abs(d - found[1]) > guard])
    return (found[1], found[0], rival[0] if rival else float("inf")), looked


def confident(best: tuple[int, float, float] | None) -> bool:
    """Under 0.03 of the pixels differ, and at least twice as many at the rival's shift."""
    return best is not None and best[1] < 0.03 and best[2] >= 2 * best[1]


def best_order(cost: list[list[float]], most: int = 7) -> list[int]:
    """The order of least summed cost between neighbours, by branch and bound; the first of equals."""
    n = len(cost)
    if n > most:
        raise ValueError(f"more than {most} parts")
    best: list = [float("inf"), []]

    def walk(path, total):
        if total >= best[0]:
            return
        if len(path) == n:
            best[:] = [total, path]
            return
        for j in range(n):
            if j not in path:
                walk([*path, j], total + (cost[path[-1]][j] if path else 0))

    walk([], 0.0)
    return best[1]


def unsharp(g: np.ndarray, amount: float = 0.8) -> np.ndarray:
    p = np.pad(g.astype(np.float64), 1, mode="edge")
    blur = sum(p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)) / 9
    return np.clip(g + amount * (g - blur), 0, 255).astype(np.uint8)


def shift_between(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, float]:
    """(shift, cost): by how much row profile ``b`` lies above ``a``, with the mean difference there."""
    costs = []
    for d in range(-most, most + 1):
        x, y = (a[d:], b[: len(b) - d]) if d >= 0 else (a[:d], b[-d:])
        if len(x) > len(a) // 3:
            costs.append((float(np.abs(x - y).mean()), abs(d), d))
    cost, _, d = min(costs)
    return d, cost


def plane_stats(values: Column, width: int) -> Column:
    """struct(sharpness, dark, runs) of a flat array taken as rows of ``width``: Laplacian variance, share of pixels under the
    adaptive threshold, and the number of runs in the row profile."""

    @F.pandas_udf("sharpness double, dark int, runs int")
    def stats(s: pd.Series) -> pd.DataFrame:
        out = []
        for v in s:
            if v is None or len(v) % width or not len(v):
                out.append((None, None, None))
                continue
            g = np.asarray(v, dtype=np.float64).reshape(-1, width)
            mask = adaptive_threshold(g, 3, 0)
            out.append((laplacian_variance(g), int(mask.sum()), len(find_runs(mask.sum(1), width // 2))))
        return pd.DataFrame(out, columns=["sharpness", "dark", "runs"])

    return stats(values)


def quality_gate(df: DataFrame, width: str, sharp: str, exempt: Column | None = None) -> DataFrame:
    """``problems``: too narrow (below 400), narrow (below 700), blurred (sharpness below 120, unless exempt)."""
    blur = F.col(sharp) < 120
    if exempt is not None:
        blur &= ~exempt
    return df.withColumn("problems", F.array_compact(F.array(
        F.when(F.col(width) < 400, "too narrow"), F.when((F.col(width) >= 400) & (F.col(width) < 700), "narrow"), F.when(blur, "blurred")
    )))
