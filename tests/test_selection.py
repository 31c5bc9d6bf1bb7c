"""Orders, truth from reads and the choice of frames on small tables: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from lodeframe.functions.stars import race_label
from lodeframe.operators import planning, ranking, selection, store, truth


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_places_over_many_tasks(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 7919 % 5000).repartition(7)
    got = ranking.places(df, [F.desc("v")])
    assert got.where("place <> 4999 - v").count() == 0 and got.count() == 5000
    tied = ranking.places(df.withColumn("w", F.lit(1)), ["w"])
    assert [r["place"] for r in tied.select("place").orderBy("place").collect()] == list(range(5000))
    assert ranking.places(df.limit(0), ["v"]).count() == 0


def test_four_way_has_all_classes(spark):
    e = spark.createDataFrame([("loop", "l00p"), ("book", "b00k"), ("b0ok", "b00k"), ("twin", "twin"), ("twin", "twin")], "name string, full string").withColumn("strict", F.col("name"))
    r = spark.createDataFrame(
        [(1, "loop", "l00p"), (2, "l0op", "l00p"), (3, "bo0k", "b00k"), (4, "twin", "twin"), (5, "lo0q", "l00q"), (6, "zzzzzz", "zzzzzz"), (7, "", ""), (8, None, None)],
        "id int, strict string, full string",
    )
    want = [(1, "exact", "loop", 0), (2, "via_map", "loop", 0), (3, "ambiguous", None, 0), (4, "ambiguous", None, 0), (5, "ambiguous", None, 1), (6, "unreadable", None, None), (7, "unreadable", None, None), (8, "unreadable", None, None)]
    assert rows(truth.four_way(r, e, "id"), "id", "category", "skill", "distance") == want
    assert truth.four_way(r, e.limit(0), "id").where("category = 'unreadable'").count() == 8


def test_overlap_sample_of_one_and_of_few(spark):
    m = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0), ("b", 1)], "r string, o int")
    assert rows(truth.overlap_sample(m, "r", "o", 1), "r", "o") == [("a", 2), ("b", 1)]
    assert rows(truth.overlap_sample(m, "r", "o", 3), "r", "o") == [("a", 0), ("a", 2), ("a", 4), ("b", 0), ("b", 1)]


def test_decisions_reach_members(spark):
    m = spark.createDataFrame([(1, 7, False), (2, 7, True), (3, None, False), (4, 9, None)], "id int, row int, gold boolean")
    d = spark.createDataFrame([(7, "x", "voted"), (9, None, "override")], "row int, name string, status string")
    assert rows(truth.write_back(m, d, "row", F.col("gold")), "id", "name", "status") == [(1, "x", "voted"), (2, None, "check"), (3, None, "check"), (4, None, "override")]


def test_overscroll_goes_only_where_it_came_back(spark):
    def left(frames):
        df = spark.createDataFrame([("w", i, float(p), s) for i, (p, s) in enumerate(frames)], "who string, o int, p double, still boolean")
        return [r["o"] for r in selection.trim_overscroll(df, "who", "o", "p", F.col("still"), 100.0, 2.0).orderBy("o").collect()]

    assert left([(0, True), (50, False), (60, False), (52, True), (53, False)]) == [0, 1, 3, 4]
    assert left([(0, True), (50, False), (90, False), (52, True)]) == [0, 1, 2, 3]  # over a quarter beyond
    assert left([(0, True), (50, True), (60, False)]) == [0, 1, 2]  # did not come back
    assert left([(0, False), (9, None)]) == [0, 1]  # never still


def test_frames_without_a_measure(spark):
    f = spark.createDataFrame([("a", 1, None), ("a", 2, 10.0), ("a", 3, 7.0), ("b", 4, None)], "who string, t int, sharp double")
    assert rows(selection.sharp_enough(f, "who", "sharp"), "t", "enough") == [(1, False), (2, True), (3, False), (4, False)]
    assert rows(selection.blurriest(f, "who", "sharp", "t"), "t", "place") == [(3, 0)]
    assert selection.kept_gaps(f, "who", "t", "t", F.lit(False)).where("max_gap <> 0").count() == 0


def test_a_gold_counts_by_its_chain(spark):
    gains = spark.createDataFrame([(1, "g"), (2, "w"), (2, "g"), (3, "h"), (3, "h")], "card int, skill string")
    chain = spark.createDataFrame([("g", "a"), ("g", "b")], "skill string, prev string")
    golds = spark.createDataFrame([("g",), ("h",)], "skill string")
    pop = spark.createDataFrame([("b",), ("w",)], "skill string")
    assert rows(planning.score(gains, chain, golds, pop, "card", "skill"), "card", "whites", "golds", "score") == [(1, 1, 1, 2), (2, 2, 1, 3), (3, 0, 0, 0)]


def test_cells_that_only_one_side_has(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "a", 1)], "r int, k string, v int")
    was = spark.createDataFrame([(1, "a", 1), (2, "a", None), (4, "a", 1)], "r int, k string, v int")
    assert rows(store.edited(now, was, "r", ["k"], "v"), "r", "edited") == [(1, False), (2, False), (3, True), (4, True)]


def test_race_labels(spark):
    df = spark.createDataFrame([("2024-03-09", "x"), ("soon", "x"), (None, "x"), (None, None)], "d string, l string")
    assert [r[0] for r in df.select(race_label(F.col("d"), F.col("l"))).collect()] == ["3/9", "x", "x", ""]
