"""Loads of shards beside groups above the mean."""

import random

import pytest

from lodeframe.llm import sharding


def loads(sizes, count):
    out, placed = {}, {}
    for s, b, k in sharding.pack_into(sizes, count):
        out[b] = out.get(b, 0) + s * k
        placed[s] = placed.get(s, 0) + k
    want = {}
    for s, n in sizes:
        if n:
            want[s] = want.get(s, 0) + n
    assert placed == want and set(out) <= set(range(count))
    return sorted(out.values(), reverse=True)


@pytest.mark.parametrize("shares", [[1 / 3], [1 / 3, 1 / 4, 1 / 12]])
def test_groups_above_the_mean_stand_alone(shares):
    rnd = random.Random(3)
    small = [(rnd.randint(1, 5000), rnd.randint(1, 4)) for _ in range(500)]
    rest = sum(s * n for s, n in small)
    big = [int(rest * x / (1 - sum(shares))) for x in shares]
    got = loads([*small, *((s, 1) for s in big)], 24)
    assert len(got) == 24 and got[: len(big)] == sorted(big, reverse=True)
    assert max(got[len(big) :]) <= 1.01 * rest / (24 - len(big)) and min(got) >= 0.9 * rest / (24 - len(big))


def test_few_groups():
    assert max(loads([(10, 30), (1000, 5)], 3)) == 2000
    assert loads([(7, 2)], 24) == [7, 7] and loads([(7, 1), (1, 0)], 1) == [7] and loads([], 4) == []


def test_a_third_in_equal_texts(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 40)) for i in range(2400)]
    third = sum(len(t) + 8 for _, t in rows) // 2
    rows += [(10_000 + i, "the same text in all of these") for i in range(third // 37)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    load = {}
    for r in sharding.shard_documents(df).collect():
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    big, *rest = sorted(load.values(), reverse=True)
    assert len(load) == 24 and abs(big - third) < 64 and max(rest) <= 1.02 * min(rest)


def test_tree_is_a_sorted_list():
    from bisect import bisect_left, insort

    rnd, tree, plain = random.Random(1), sharding.Tree(), []
    for i in range(5000):
        if rnd.random() < 0.6:
            key = rnd.randrange(300), i
            tree.add(key)
            insort(plain, key)
        else:
            key = rnd.randrange(320), -1
            at = bisect_left(plain, key)
            assert tree.pop_least(key) == (plain.pop(at) if at < len(plain) else None)


def test_fixed_capacity(spark):
    import pytest
    from collections import Counter

    from tests.llm.test_text_ops import plain_best_fit

    rnd = random.Random(6)
    rows = [(f"g{i}", rnd.randint(1, 900), k) for i in range(200) for k in range(rnd.randint(1, 3))]
    df = spark.createDataFrame(rows, "group string, size long, k int")
    got = sharding.shard_to_capacity(df, 4000, order=("group", "k")).collect()
    sizes, shards, load = Counter(), {}, Counter()
    for r in got:
        sizes[r["group"]] += r["size"]
        shards.setdefault(r["group"], set()).add(r["shard"])
        load[r["shard"]] += r["size"]
    assert len(got) == len(rows) and all(len(x) == 1 for x in shards.values()) and max(load.values()) <= 4000
    assert sorted(4000 - x for x in load.values()) == plain_best_fit(sizes.values(), 4000)
    with pytest.raises(ValueError):
        sharding.shard_to_capacity(df, 100)


def test_a_group_of_just_the_capacity_fits_and_equal_groups_find_their_shards(spark):
    rows = [("just", 10_001)] + [(f"g{i}", 5_000) for i in range(301)] + [(f"h{i}", 9_999) for i in range(150)]
    got = sharding.shard_to_capacity(spark.createDataFrame(rows, "group string, size long"), 10_001).collect()
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert len(got) == len(rows) and max(load.values()) <= 10_001 and len(load) == 1 + 151 + 150
    with pytest.raises(ValueError):
        sharding.shard_to_capacity(spark.createDataFrame([("over", 10_002)], "group string, size long"), 10_001)
