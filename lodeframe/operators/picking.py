"""Which samples of a recording to keep, so that neighbours overlap and can be joined.

A recording is one ordered walk, whose next step depends on the last, so it is one group; recordings are walked side by
side. What the walk looks at is the interval of samples that the one kept last can reach.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rules:
    """Limits of a seam (share of pixels that differ, the rival's over it), and distances, of which ``far``,
    ``overlap`` and ``weak_overlap`` are shares of the height of the content."""

    bad: float = 0.022
    ratio: float = 2.0
    weak_ratio: float = 1.5
    least: int = 20
    far: float = 0.85
    overlap: float = 0.45
    weak_overlap: float = 0.2
    settled_back: float = 0.15
    settled_on: int = 20


@dataclass(frozen=True)
class Seam:
    """How far the content moves on from one sample to the other, and how well that is known."""

    shift: float
    bad: float
    ratio: float


def walk(pos: list[float], still: list[bool], anchor: list[bool], seam: Callable[[int, int], Seam | None], height: float, rules: Rules = Rules()) -> list[tuple[int, bool]]:
    """(sample, weak) in their order, ``weak`` where the seam from the one before is not sure.

    The first sample and every anchor are kept. From the last kept one, in this order: the next anchor, if it is in
    reach and the seam is sure; if it lies on the very place of the last kept, the anchor takes its place, joined to the
    one before. Then a still sample, the farthest first (the nearest first after a moving one), whose seam may be a bit
    weaker; then, if the next still sample or anchor is out of reach but not beyond two reaches, a bridge: the moving
    sample nearest to the middle from which it is in reach; then any sample that overlaps enough, the farthest first.
    If nothing joins, the next samples are tried in turn, and only if none of them joins the first is kept all the same.
    In the end a last sample that went too far gives way to the still one on which the content came back.
    """
    n = len(pos)
    if not n:
        return []
    reach, last = round(rules.far * height), n - 1
    sure = lambda s: s is not None and s.shift > 0 and s.bad < rules.bad and s.ratio >= rules.ratio
    fair = lambda s: s is not None and s.shift > 0 and s.bad < 2 * rules.bad and s.ratio >= rules.weak_ratio
    wide = lambda s: height - s.shift >= round(height * rules.weak_overlap)
    kept: list[tuple[int, bool]] = [(0, False)]

    def first(of: list[int], also: bool) -> bool:
        for j in of:
            s = seam(kept[-1][0], j)
            if sure(s) or (also and fair(s) and wide(s)):
                kept.append((j, not sure(s)))
                return True
        return False

    while True:
        k = kept[-1][0]
        gap = lambda j: pos[j] - pos[k]  # noqa: B023, E731
        to = next((j for j in range(k + 1, n) if anchor[j]), None)
        end = last if to is None else to
        ahead = [j for j in range(end, k, -1) if j != to]
        if to is not None:
            if gap(to) < rules.least and len(kept) > 1 and not anchor[k]:
                before = seam(kept[-2][0], to)
                if sure(before):
                    kept[-1] = to, False
                else:
                    kept.append((to, not sure(seam(k, to))))
                continue
            if (gap(to) <= reach or gap(to) < rules.least) and first([to], False):
                continue
        calm = [j for j in ahead if still[j] and rules.least <= gap(j) <= reach]
        if first(calm if still[k] else calm[::-1], True):
            continue
        goal = next((j for j in range(k + 1, end + 1) if (still[j] or anchor[j]) and gap(j) > reach), None)
        if goal is not None and gap(goal) <= 2 * reach:
            mid = [j for j in range(k + 1, goal) if max(rules.least, gap(goal) - reach) <= gap(j) <= reach]
            if first(sorted(mid, key=lambda j: abs(gap(j) - gap(goal) / 2)), False):  # noqa: B023
                continue
        if first([j for j in ahead if gap(j) >= rules.least and height - gap(j) >= rules.overlap * height], False):
            continue
        rest = [j for j in range(k + 1, end + 1) if gap(j) >= rules.least]
        if not rest:
            if to is None:
                break
            kept.append((to, not sure(seam(k, to))))
            continue
        if not sure(seam(k, rest[0])):
            over = next((j for j in range(rest[0] + 1, end + 1) if (s := seam(k, j)) and (sure(s) or fair(s)) and wide(s)), None)
            if over is not None:
                kept.append((over, not sure(seam(k, over))))
                continue
        kept.append((rest[0], not sure(seam(k, rest[0]))))
    if len(kept) > 1 and not anchor[kept[-1][0]]:
        k = kept[-1][0]
        calm = next((j for j in range(last, k, -1) if still[j]), None)
        if calm is not None and -round(height * rules.settled_back) <= pos[calm] - pos[k] <= rules.settled_on:
            s = seam(kept[-2][0], calm)
            if sure(s) or fair(s):
                kept[-1] = calm, not sure(s)
    return kept


def picked(samples: DataFrame, seams: DataFrame, by: str, height: float, rules: Rules = Rules()) -> DataFrame:
    """(by, k, n, weak): the kept samples of each recording, ``k`` from 0, see ``walk``.

    ``samples``: by, n (their order), pos, still and anchor; rows without pos are left out. ``seams``: by, a, b, shift,
    bad and ratio of pairs of samples (by n) that were measured; others do not join. A recording's samples and seams are
    one group: seams reach as far as contents overlap, so there are as many as samples times those in reach.
    """
    kinds = {c: samples.schema[c].dataType.simpleString() for c in (by, "n")}

    def run(key: tuple, s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("n", kind="stable")
        at = {n: i for i, n in enumerate(s["n"].tolist())}
        known = {(at.get(r.a), at.get(r.b)): Seam(r.shift, r.bad, r.ratio) for r in t.itertuples()}
        kept = walk(s["pos"].tolist(), s["still"].tolist(), s["anchor"].tolist(), lambda i, j: known.get((i, j)), height, rules)
        ns = s["n"].tolist()
        return pd.DataFrame({by: [key[0]] * len(kept), "k": range(len(kept)), "n": [ns[i] for i, _ in kept], "weak": [w for _, w in kept]})

    left = samples.where("pos IS NOT NULL").selectExpr(by, "n", "cast(pos as double) as pos", "coalesce(still, false) as still", "coalesce(anchor, false) as anchor")
    right = seams.selectExpr(f"{by} as __by", "a", "b", "cast(shift as double) as shift", "cast(bad as double) as bad", "cast(ratio as double) as ratio").where("shift IS NOT NULL AND bad IS NOT NULL AND ratio IS NOT NULL")
    return left.groupBy(by).cogroup(right.groupBy("__by")).applyInPandas(run, f"{by} {kinds[by]}, k int, n {kinds['n']}, weak boolean")
