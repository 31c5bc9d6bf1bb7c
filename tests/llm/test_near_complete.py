"""Near-dedup links exactly the pairs of Jaccard 0.8, and finds nearly all of them."""

import random

from pyspark.sql import functions as F

from lodeframe.llm import simhash
from lodeframe.session import table
from tests.llm.test_text_ops import plain_components  # noqa: F401


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """{doc_id: smallest doc_id of its group} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    holders, shared, root = {}, {}, {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for v in holders.values():
        for i, a in enumerate(v):
            for b in v[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    blank = [d for d, s in sets.items() if not s]
    for d in blank:
        root[d] = min(blank)
    return {d: find(d) for d in sets}


def changed(rnd, words, share):
    out = list(words)
    for i in rnd.sample(range(len(out)), round(share * len(out))):
        out[i] = f"z{rnd.randrange(10**6)}"
    return out


def test_recall_at_the_threshold(spark):
    """Pairs of Jaccard 0.8 to 0.86 only: over nine tenths are linked; pairs of 0.7 to 0.8 never are."""
    rnd = random.Random(3)
    rows, near, far = [], set(), set()
    while len(near) < 300 or len(far) < 100:
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(80, 400))]
        other = changed(rnd, base, rnd.uniform(0.015, 0.04))
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        j = len(a & b) / len(a | b)
        if not 0.7 <= j < 0.86 or len(near if j >= 0.8 else far) >= 300:
            continue
        (near if j >= 0.8 else far).add(len(rows) + 1)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert far <= left and {i for i in range(0, len(rows), 2)} <= left
    assert len(near - left) >= 0.9 * len(near)


def test_recall_of_short_texts(spark):
    """Pairs of Jaccard 0.8 to 0.9 of each class of lengths: over nine tenths are linked."""
    rnd, rows, pairs = random.Random(4), [], {}
    for low, high in ((10, 13), (14, 20), (24, 30)):
        found = 0
        while found < 150:
            base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(low, high))]
            other = base[rnd.randint(0, 2) :]
            other = other[: len(other) - rnd.randint(0, 2)] + [f"z{rnd.randrange(10**6)}"] * rnd.randint(0, 1)
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            if 0.8 <= len(a & b) / len(a | b) < 0.9:
                found += 1
                pairs.setdefault((low, high), set()).add(len(rows) + 1)
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    left = {r["doc_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(0, len(rows), 2)} <= left
    for of, near in pairs.items():
        assert len(near - left) >= 0.9 * len(near), of


def test_like_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    groups = plain_groups([tuple(r) for r in docs.collect()])
    left = {r["doc_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(left ^ set(groups.values())) <= 3 and len(left) < docs.count()


def test_a_large_group_and_its_margin(spark, monkeypatch):
    """A star of hundreds of near copies, crowded buckets and texts paired with very many others."""
    monkeypatch.setattr(simhash, "DENSE", 4)
    monkeypatch.setattr(simhash, "RUN", 8)
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(changed(rnd, base, rnd.choice((0.004, 0.02, 0.03))))) for i in range(250)]
    rows += [(1000 + i, " ".join(f"v{rnd.randrange(5000)}" for _ in range(100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.near_duplicates(df).collect()}
    assert left == set(plain_groups(rows).values())


def candidates(spark, docs):
    """Candidate pairs a node that are held against the complete distance."""
    seen = []
    plain = simhash._close

    def spy(pairs, nodes, *how):
        seen.append(pairs.distinct().count() / max(nodes.count(), 1))
        return plain(pairs, nodes, *how)

    simhash._close = spy
    try:
        simhash.near_duplicates(docs).count()
    finally:
        simhash._close = plain
    return sum(seen)


def test_candidates_do_not_grow(spark, sf_dir):
    small = candidates(spark, table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"))
    large = candidates(spark, table(spark, sf_dir.replace("sf0.001", "sf0.1"), "documents"))
    assert large < 2 * small + 1 < 10


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, None, "z")], "doc_id long, text string, digest string")
    got = simhash.near_duplicates(df.withColumn("digest_", F.lit(3)).withColumn("size", F.lit(4)).withColumn("nid", F.lit(5)))
    assert got.columns == ["doc_id", "text", "digest", "digest_", "size", "nid"]
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "None"]


def test_decontamination_with_columns_of_any_name(spark):
    from lodeframe.llm import decontaminate

    words = " ".join(f"w{i}" for i in range(12))
    rows = [(1, words, 5, "x"), (2, "fine", 6, "y"), (2, "fine", 6, "y"), (None, None, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, digest string")
    items = spark.createDataFrame([("i", words)], "item_id string, text string")
    got = decontaminate.remove_documents(df, items)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == [6, 6, 7]
    assert decontaminate.report(df, items).count() == 4


def test_a_similarity_of_exactly_the_least_is_no_proof(spark):
    """Two texts of 45 shingles that differ in 10 have a similarity of 0.8, those that differ in 11 a lower one."""
    def side(name, more, less, size, mask):
        own = [F.lit(more).alias("more"), F.lit(less).alias("less"), F.lit(size).alias("size")]
        return F.struct(*own, *(F.lit(mask if i == 0 else 0).cast("long").alias(m) for i, m in enumerate(simhash.MASKS))).alias(name)

    one = spark.range(1)
    at = one.select(side("x", 5, 5, 45, 31), side("y", 5, 5, 45, 31 << 5))
    over = one.select(side("x", 6, 5, 45, 63), side("y", 5, 5, 45, 31 << 6))
    told = simhash._too_far("x", "y", 0.8)
    assert [at.select(told).first()[0], over.select(told).first()[0]] == [False, True]


def test_masks_never_prove_too_much(spark):
    """What is measured against a third text bounds how two texts differ from below."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(900)}" for _ in range(200)]
    texts = [" ".join(changed(rnd, base, rnd.choice((0.01, 0.05, 0.1)))) for _ in range(40)] + [" ".join(base)]
    rows = [(i, f"{i}", len(simhash.shingle_hashes(t.encode())), t) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame([(i, i, d, n) for i, d, n, _ in rows], "nid long, doc_id long, digest string, size long")
    docs = spark.createDataFrame([(i, d, t) for i, d, _, t in rows], "doc_id long, digest string, text string")
    pairs = spark.createDataFrame([(i, 40) for i in range(40)], "a long, b long")
    seen = simhash._verified(pairs, nodes, docs, 5, 0.8).drop("linked", "b")
    both = seen.select("a", F.struct(*[c for c in seen.columns if c != "a"]).alias("x")).join(seen.select(F.col("a").alias("b"), F.struct(*[c for c in seen.columns if c != "a"]).alias("y")))
    for r in both.where("a < b").select("a", "b", simhash._apart("x", "y").alias("least")).collect():
        a, b = (set(simhash.shingle_hashes(texts[i].encode()).tolist()) for i in (r["a"], r["b"]))
        assert r["least"] <= len(a ^ b)
