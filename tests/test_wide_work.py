"""Work that makes many rows of few: it is spread, bounded, and gives what brute force gives."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import effects, frames, fuzzy, lineage, planes, planning, selection, stitch
from lodeframe.plans import screen_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [7, 8192])
def test_candidates_by_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(lineage, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), {f"s{rng.randrange(90)}": rng.choice([-1, 0, 1, 2, 3]) for _ in range(rng.randrange(6))}) for i in range(120)]
    df = spark.createDataFrame([(i, key, sorted(m), m) for i, key, m in rows], "id long, key int, sk array<string>, st map<string,int>")
    want = set()
    for i, key, m in rows:
        found = []
        for j, other, o in rows:
            if j != i and other == key:
                all_ = len(m.keys() | o.keys())
                score = int(100 * len(m.keys() & o.keys()) / all_ + 0.5) if all_ else 0
                found.append((all(o.get(s, 0) <= 0 or v <= 0 or o[s] == v for s, v in m.items()), score, j))
        want |= {(i, j, score, exact, p + 1) for p, (exact, score, j) in enumerate(sorted(found, reverse=True)[:5])}
    assert {tuple(r) for r in lineage.candidates(df, df, ["key"], "sk", "st").collect()} == want


def test_shared_defaults_are_those_of_each_owner(spark):
    rng = random.Random(5)
    owners = spark.createDataFrame([(i, i % 4, rng.choice([True, False, None])) for i in range(30)], "owner int, m int, known boolean")
    rows = [(i % 5, i % 3, i, rng.randrange(9), 9 + rng.randrange(4), rng.choice(["must", "may", "no"]), rng.choice([True, False, None])) for i in range(80)]
    options = spark.createDataFrame(rows, "m int, slot int, target int, low int, high int, verdict string, styled boolean")
    want = planning.evolution_defaults(owners.join(options, "m"), F.col("styled"), F.col("known"))
    got = planning.shared_defaults(owners, options, "m", F.col("styled"), F.col("known"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cells_of_rectangles_are_spread(spark):
    box = spark.range(2000).select(F.lit(1).alias("who"), F.col("id").alias("k"), *((F.col("id") % 100 * 10.0 + d).alias(c) for c, d in (("x0", 0), ("x1", 15), ("y0", 0), ("y1", 15))))
    met = selection.rectangles_meet(box, box, "who", 20.0, 20.0)
    assert met.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_of_equal_starts_the_smaller_key(spark):
    left = spark.createDataFrame([(1, 10, 5)], "u int, k int, b int")
    right = spark.createDataFrame([(1, k, 8) for k in (9, 4, 7, 2, 6)] + [(1, 1, 9)], "u int, k int, a int")
    assert [tuple(r) for r in frames.next_start(left, right, "u", 10).collect()] == [(1, 10, 2)]


def test_blocks_are_not_broadcast(spark):
    seen = spark.createDataFrame([(w, p, p + 3 * r, r) for w in range(4) for p in range(9) for r in (1, 2, 3)], "who long, pick long, other long, rank int")
    blocks = spark.range(40).select((F.col("id") % 4).alias("who"), F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("level"))
    assert "Broadcast" not in plan(effects.voted_out(blocks, seen, ["who"]))


def test_screens_are_compared_without_joins_of_pixels(spark):
    rows = spark.range(30).select((F.col("id") % 3).alias("who"), F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("y"))
    rows = rows.withColumn("v", F.array(*(F.col("y") * F.col("frame") % 50 for _ in range(20))))
    found = planes.scrolled_between(rows, ["who"], quiet=8, step=2)
    assert "Join" not in plan(found)
    assert plan(planes.without_fixed_foot(rows, spark.createDataFrame([(0, 0, 40)], "who long, header int, footer int"), ["who"], step=3, least=10)).count("Join") == 1


@pytest.mark.parametrize("skills", [6, 70])
@pytest.mark.parametrize("seed", [3, 50])
def test_best_pairs_by_a_bound(spark, skills, seed):
    rng = random.Random(skills + seed)
    rows = [(i, sum(1 << s for s in range(skills) if rng.random() < 0.4), rng.randrange(30)) for i in range(150)]
    word = lambda b, w: (x := b >> 64 * w & (2**64 - 1)) - (2**64 if x >= 2**63 else 0)
    df = spark.createDataFrame([(i, [word(b, 0), word(b, 1)], s) for i, b, s in rows], "pid long, bits array<long>, score long")
    every = sorted((-(x[1] | y[1]).bit_count(), -(x[2] + y[2]), x[0], y[0]) for x, y in combinations(rows, 2))[:10]
    assert [(-r["n"], -r["score"], r["a"], r["b"]) for r in lineage.best_pairs(df, "pid", "score", 10, seed).collect()] == every


def test_two_cards_of_a_screen_in_one_cell(spark):
    card = lambda f, pos, band, side, key: (1, f, pos, 10 * f + pos, False, band, side, key)
    first = [card(0, 1, 0, 0, "a"), card(0, 2, 0, 1, None), card(0, 3, 0, 1, "x"), card(0, 4, 1, 0, "b"), card(0, 5, 1, 1, "c")]
    then = [card(1, 1, 1, 0, "q"), card(1, 2, 1, 1, "r"), card(1, 3, 2, 0, None), card(1, 4, 2, 1, "c")]
    found = spark.createDataFrame(first + then, "who int, frame int, pos int, id int, gold boolean, band int, side int, key string")
    k = lambda apart: [(r["k"], r["gap"]) for r in stitch.seams(found, ["who"], apart).orderBy("n").collect()]
    assert k(False) == [(0, False), (2, True)] and k(True) == [(0, False), (-1, False)]


def test_equal_reads_are_matched_once(spark, monkeypatch):
    given, near = [], fuzzy.near
    monkeypatch.setattr(fuzzy, "near", lambda r, *a: given.append(r.count()) or near(r, *a))
    reads = spark.createDataFrame([(i, ["ivory lace", "ivorx lace", "ivory zzzz", "", None, "qqqqqqqqqqqqq"][i % 6]) for i in range(60)], "id int, norm string")
    names = spark.createDataFrame([("ivory lace",) * 2, ("ivory lame",) * 2], "name string, norm string")
    got = {tuple(r) for r in fuzzy.near_misses(reads, names, "id").collect()}
    kind = {1: ("fuzzy", "ivory lace", 1), 2: ("typo", "ivory lace", 4), 3: ("other", None, None), 4: ("other", None, None), 5: ("other", None, None)}
    assert got == {(i, *kind[i % 6]) for i in range(60) if i % 6} and given[0] <= 5


def test_closure_has_no_round_that_finds_nothing(spark, monkeypatch):
    rounds, cut = [], planning.cut
    monkeypatch.setattr(planning, "cut", lambda *a: rounds.append(a) or cut(*a))
    edges = spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "c int, p int")
    got = {tuple(r) for r in planning.closure(edges, "c", "p").collect()}
    assert got == {(a, b, a - b) for a in range(1, 5) for b in range(1, a)} and len(rounds) == 3


def test_seams_ahead_need_no_join(spark, sf_dir):
    assert "Join" not in plan(screen_queries.walked(spark, sf_dir)[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_grids_are_voted_out_like_blocks_without_their_shuffle(spark, seed):
    rng, rows = random.Random(seed), []
    for w in range(12):
        for n in rng.sample(range(1, 40), rng.randrange(30)):
            top = rng.choice([None, 3 * n + rng.randrange(3)])
            rows.append((w, n, None if top is None else 20 * top, top, None if top is None else [rng.choice([None, 0, 0, 0, 3, 30]) for _ in range(24 * 2 + rng.randrange(2))]))
    samples = spark.createDataFrame(rows, "who int, n int, pos int, top int, levels array<int>").repartition(3, "who")
    blocks = [(w, n, top + i // 2, i % 2, v) for w, n, _, top, levels in rows if top is not None for i, v in enumerate(levels)]
    blocks = spark.createDataFrame(blocks, "who int, n int, row int, col int, level int")
    want = effects.voted_out(blocks, effects.witnesses(samples, samples, ["who"]), ["who"])
    got = effects.grids_voted_out(samples, ["who"], 2)
    assert "Join" not in plan(got) and plan(got).count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_drafts_walk_through_the_screens_once(spark, sf_dir):
    assert "MapInArrow" not in plan(screen_queries.truth_draft_rows(spark, sf_dir))
