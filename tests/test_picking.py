"""Which samples are kept: the rules one by one, and the grouped entry against the walk."""

import random

import pytest

from lodeframe.operators import picking
from lodeframe.operators.picking import Seam


def kept(pos, still=(), anchors=(), seams=None, height=1000):
    """Seams are sure where nothing is said; {(a, b): Seam or None} says otherwise, "weak" a fair one."""
    n = len(pos)

    def seam(a, b):
        got = (seams or {}).get((a, b), "sure")
        d = pos[b] - pos[a]
        return {"sure": Seam(d, 0.001, 9), "weak": Seam(d, 0.03, 1.6)}.get(got) if isinstance(got, str) else got

    return picking.walk(pos, [i in still for i in range(n)], [i in anchors for i in range(n)], seam, height)


@pytest.mark.parametrize(
    ("case", "want"),
    [
        (dict(pos=[]), []),
        (dict(pos=[0]), [0]),
        (dict(pos=[0, 5, 10]), [0]),  # nothing moves on
        (dict(pos=[0, 100, 300, 500, 540, 700]), [0, 4, 5]),  # the farthest that overlaps by 0.45
        (dict(pos=[0, 200, 400, 800, 840], still={0, 1, 2, 3}), [0, 3, 4]),  # the farthest still one within 0.85
        (dict(pos=[0, 200, 400, 800, 900], still={1, 2, 3}), [0, 1, 3, 4]),  # after a moving one the nearest still one
        (dict(pos=[0, 300, 600, 700, 1200], still={0, 4}), [0, 2, 4]),  # a bridge at the middle of 1200
        (dict(pos=[0, 300, 600, 700, 1200], still={0, 4}, seams={(0, 2): None}), [0, 3, 4]),  # the next nearest to it
        (dict(pos=[0, 300, 600, 900], anchors={2}), [0, 2, 3]),  # an anchor in reach comes first
        (dict(pos=[0, 200, 500, 505, 900], still={0, 2}, anchors={3}), [0, 3, 4]),
        (dict(pos=[0, 500, 510, 900], anchors={2}, seams={(0, 2): None, (1, 2): None}), [0, 1, "2", 3]),  # no way back: both, weakly
        (dict(pos=[0, 500, 510, 900], anchors={2}, seams={(0, 2): "weak"}), [0, 1, 2, 3]),
        (dict(pos=[0, 400, 800], still={0, 2}, seams={(0, 2): "weak"}), [0, "2"]),  # a still one may join a little worse
        (dict(pos=[0, 600, 700], seams={(0, 1): None}), [0, 2]),  # the first does not join, so look further on
        (dict(pos=[0, 600, 700], seams={(0, 1): None, (0, 2): None}), [0, "1", 2]),  # nothing joins: the first all the same
        (dict(pos=[0, 500, 900, 890], still={0, 1, 3}), [0, 1, 3]),  # too far, and back: the still one at the end
        (dict(pos=[0, 500, 900, 700], still={0, 1, 3}), [0, 3]),  # of still ones in reach the last
    ],
)
def test_rules(case, want):
    got = kept(**case)
    assert [str(i) if weak else i for i, weak in got] == want


def test_the_last_kept_gives_way_to_an_anchor_on_its_place():
    pos = [0, 500, 510, 900]
    still_first = {(0, 2): Seam(510, 0.001, 9)}
    far = kept(pos, still={0, 1}, anchors={2}, height=590, seams=still_first | {(0, 3): None})
    assert [i for i, _ in far][:2] == [0, 1] or [i for i, _ in far][:2] == [0, 2]
    assert 2 in [i for i, _ in far]


def test_grouped_entry_is_the_walk(spark):
    rng = random.Random(5)
    samples, seams, want = [], [], {}
    for rec in range(12):
        n, at, pos = rng.randrange(0, 40), 0.0, []
        for _ in range(n):
            pos.append(at)
            at += rng.choice([0, 3, 40, 150, 300, -20])
        still, anchor = [rng.random() < 0.4 for _ in pos], [rng.random() < 0.1 for _ in pos]
        known = {(i, j): Seam(pos[j] - pos[i], rng.choice([0.001, 0.03, 0.2]), rng.choice([1.2, 1.7, 4.0])) for i in range(n) for j in range(i + 1, n) if pos[j] - pos[i] < 1000 and rng.random() < 0.8}
        samples += [(rec, 10 * i, pos[i], still[i] or None, anchor[i]) for i in range(n)] + [(rec, 10 * n + 5, None, True, True)]
        seams += [(rec, 10 * a, 10 * b, s.shift, s.bad, s.ratio) for (a, b), s in known.items()]
        walked = picking.walk(pos, still, anchor, lambda i, j, k=known: k.get((i, j)), 1000)
        want[rec] = [(k, 10 * i, w) for k, (i, w) in enumerate(walked)]
        assert [i for i, _ in walked] == sorted({i for i, _ in walked}) and {i for i in range(n) if anchor[i]} <= {i for i, _ in walked}
    a = spark.createDataFrame(samples, "rec int, n int, pos double, still boolean, anchor boolean").repartition(5)
    b = spark.createDataFrame(seams, "rec int, a int, b int, shift double, bad double, ratio double")
    got = {r: [] for r in want}
    for r in picking.picked(a, b, "rec", 1000).orderBy("rec", "k").collect():
        got[r["rec"]].append((r["k"], r["n"], r["weak"]))
    assert got == want


def test_query_is_the_walk(spark, sf_dir):
    from lodeframe.plans import screen_queries as q

    samples, seams = q.walked(spark, sf_dir)
    rows, known = {}, {}
    for r in samples.collect():
        rows.setdefault(r["who"], []).append((r["n"], r["pos"], r["still"], r["anchor"]))
    for r in seams.collect():
        known.setdefault(r["who"], {})[r["a"], r["b"]] = Seam(r["shift"], r["bad"], r["ratio"])
    want = set()
    for who, of in rows.items():
        ns, pos, still, anchor = zip(*sorted(of))
        walked = picking.walk(list(pos), still, anchor, lambda i, j, k=known.get(who, {}), ns=ns: k.get((ns[i], ns[j])), 100)
        want |= {(who, k, ns[i], w) for k, (i, w) in enumerate(walked)}
    assert {(r["who"], r["k"], r["n"], r["weak"]) for r in q.frames_picked(spark, sf_dir).collect()} == want and want
