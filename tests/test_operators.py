"""Operators that SQL cannot check, against brute force; and edges of those that it does."""

import io
import itertools
import json
import random
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import kernels, stars, text
from lodeframe.operators import analytics, catalog, facets, frames, fuzzy, ops, planning, store
from lodeframe.sources import catalogs
from lodeframe.streaming import frames as streams


# Text


def test_normalise_passes_do_not_chain(spark):
    df = spark.createDataFrame([("ａｂ ｃ\u3000d\u00a0ー－ーー",), (None,), ("xy",)], "s string")
    got = [r[0] for r in df.select(text.normalise(F.col("s"), {"x": "y", "y": "z"}, {"z": "w", "－": "ー", "-": "ー"})).collect()]
    assert got == ["abcdー", None, "yw"]


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    assert one(text.badge(F.lit(" 12 / 200 ")))["count"] == 12 and one(text.badge(F.lit("x"))) is None
    assert one(text.contains_kana_blind(F.lit("スキル"), F.lit("きる"))) is True
    assert one(text.file_name(F.lit('a/b:c?. . '))) == "a／b：c？"
    assert one(text.bracket_words(F.lit("名＜短距離・逃げ＞"))) == ["短距離", "逃げ"]
    assert one(text.literal_runs(F.lit("x あいうえおか y 漢字"))) == ["あいうえおか"]
    assert one(text.display_width(F.lit("aあ"))) == 3
    assert text.close_map({"a": "b"}, {"a": "α", "b": "β"}) == {"a": "b", "α": "β"}


def test_align_is_shortest_and_prefers_substitutions():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 6))) for _ in range(2))
        d = list(range(len(b) + 1))
        for i in range(1, len(a) + 1):
            p, d[0] = d[0], i
            for j in range(1, len(b) + 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (a[i - 1] != b[j - 1]))
        assert len(text.align(a, b)) == d[-1]
    assert text.align("ab", "ac") == [("sub", "b", "c")] and text.align("a", "ab") == [("del", "", "b")] and text.align("ab", "a") == [("ins", "b", "")]


def test_near_finds_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abc", k=rnd.randint(1, 11)))
    reads, names = list({word() for _ in range(80)}), list({word() for _ in range(60)})
    got = {(r["r_norm"], r["e_norm"], r["distance"]) for r in fuzzy.near(*(spark.createDataFrame([(x,) for x in v], "norm string") for v in (reads, names))).collect()}

    def dist(a, b):
        return len(text.align(a, b))

    limit = lambda n: 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 9 else 3
    assert got == {(a, b, dist(a, b)) for a in reads for b in names if dist(a, b) <= limit(len(b))}


def test_dictionary_keeps_the_first(spark):
    df = spark.createDataFrame([("A", "a", 2), ("a ", "a", 1), ("", "", 0), ("b", "b", 3)], "name string, norm string, pos int")
    assert [r["name"] for r in fuzzy.dictionary(df).orderBy("pos").collect()] == ["a ", "b"]


def test_ties_are_resolved_in_order(spark):
    ties = spark.createDataFrame(
        [("p", 1, "i", 5, 2, ["x", "y"]), ("p", 2, "i", 6, 1, ["y", "z"]), ("q", 1, "i", 1, None, ["x", "y"])],
        "person string, pos int, image string, row int, star int, candidates array<string>",
    )
    taken = spark.createDataFrame([("p", "x", "i", 1, 2), ("q", "x", "j", 1, 2)], "person string, name string, image string, row int, star int")
    got = {(r["person"], r["pos"]): r["resolved"] for r in fuzzy.resolve_ties(ties, taken).collect()}
    assert got == {("p", 1): "y", ("p", 2): "z", ("q", 1): None}


# Stars


def test_unknown_and_missing_stars_stay_apart(spark):
    df = spark.createDataFrame([(1,), (3,), (-1,), (None,)], "s int")
    assert [r[0] for r in df.select(stars.ok(F.col("s"), 1)).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(stars.ok(F.col("s"), 2)).collect()] == [False, True, False, False]
    assert [r[0] for r in df.select(stars.family_sum(1, F.col("s"))).collect()] == [1, 3, 1, 0]
    assert [r[0] for r in df.select(stars.triple(1, F.col("s"))).collect()] == [1, 3, 0, 0]
    m = spark.range(1).select(stars.merge_known(F.expr("map('a', 2, 'b', -1, 'c', 1)"), F.expr("map('a', -1, 'b', 3, 'd', -1)")).alias("m")).first()[0]
    assert m == {"a": 2, "b": 3, "c": 1, "d": -1}
    assert spark.range(1).select(stars.percent_cost(F.lit(90), F.lit(30))).first()[0] == 63


# Store


def test_archive_twice_changes_nothing(spark):
    m = spark.createDataFrame([("r1", "a", 1), ("r2", "a", 2), ("c", "b", 1)], "set_id string, skill_id string, last_send int")
    sets = spark.createDataFrame([("r1", True), ("r2", True), ("c", False)], "set_id string, ended boolean")
    once = store.archive(m, sets, F.lit("c"))
    again = store.archive(once, sets, F.lit("c"))
    assert sorted(once.collect()) == sorted(again.collect()) == [("c", "a", 2), ("c", "b", 1)]


def test_replace_all_and_validation(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        store.replace_all(spark, spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    docs = ["{", '{"format":"f","tool":"t","schema":1,"data":{"a":1}}', '{"format":"x","tool":"t","schema":2,"data":{}}', '{"format":"f","tool":"t","schema":9,"data":{}}', None]
    df = spark.createDataFrame([(d,) for d in docs], "s string").select(store.validate(F.col("s"), "f", "t", 2).alias("v"))
    assert [(r.v.error, r.v.needs_migration) for r in df.collect()] == [("unreadable", False), (None, True), ("format", False), ("newer", False), ("unreadable", False)]


# Facets


def test_three_answers(spark):
    df = spark.createDataFrame([("ok", "ok"), ("ok", None), ("ng", None), ("unknown", "ok")], "a string, b string")
    assert [r[0] for r in df.select(facets.all_of(F.col("a"), F.col("b"))).collect()] == ["ok", "unknown", "ng", "unknown"]
    df = spark.createDataFrame([(["temptation_time"],), ([],), (["other"],)], "t array<string>")
    assert [r[0] for r in df.select(facets.axis(F.col("t"), ["debuff"])).collect()] == [True, True, False]
    assert [r[0] for r in df.select(facets.axis(F.col("t"), ["debuff"], empty_passes=False)).collect()] == [True, False, False]


# Planning


def test_closure_of_cycles_and_diamonds(spark):
    e = [(1, 2), (2, 3), (3, 1), (4, 5), (4, 6), (5, 7), (6, 7), (7, 7)]
    got = {(r[0], r[1], r[2]) for r in planning.closure(spark.createDataFrame(e, "c int, p int"), "c", "p").collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2), (4, 5, 1), (4, 6, 1), (4, 7, 2), (5, 7, 1), (6, 7, 1)}


def brute_cover(groups, k, need, friend):
    best = None
    names = list(groups)
    for n in range(k + 1):
        for some in itertools.combinations(names, n):
            for pick in itertools.product(*(groups[g] for g in some)):
                kinds = [o[3] for o in pick]
                if all(kinds.count(t) >= m for t, m in need.items()) and kinds.count(friend) <= 1:
                    bits = 0
                    for o in pick:
                        bits |= o[2]
                    v = (-bits.bit_count(), len(pick), -sum(o[1] for o in pick), sorted(o[0] for o in pick))
                    best = v if best is None or v < best else best
    return best


def test_cover_against_brute_force():
    rnd = random.Random(11)
    for t in range(150):
        card = itertools.count()
        groups = {g: [(next(card), rnd.randint(0, 1), rnd.getrandbits(7) & rnd.getrandbits(7), rnd.choice("abf")) for _ in range(rnd.randint(1, 3))] for g in range(rnd.randint(1, 5))}
        k, need = rnd.randint(1, 4), {"a": rnd.randint(0, 2)} if t % 2 else {}
        want, got = brute_cover(groups, k, need, "f"), planning.solve_cover(groups, k, need, "f")
        assert got["complete"] and got["feasible"] == (want is not None)
        if want:
            assert (got["n"], got["cards"]) == (-want[0], want[3])


def test_cover_at_a_deadline_is_no_worse_than_greedy():
    rnd = random.Random(2)
    groups = {g: [(g * 3 + i, 0, rnd.getrandbits(60), "a") for i in range(3)] for g in range(20)}
    got = planning.solve_cover(groups, 6, seconds=0.0)
    assert not got["complete"] and got["n"] > 40 and len(got["cards"]) <= 6


def test_cover_kernel_query(spark, sf_dir):
    from lodeframe.plans import lineage_queries as q

    rows = q._cover(spark, sf_dir).collect()
    region = {n: n % 5 for n in range(25)}
    nations = {r["n_nationkey"]: r["n_regionkey"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()} or region
    for r in q.solve_max_cover_kernel(spark, sf_dir).collect():
        groups: dict = {}
        for o in rows:
            if nations[o["grp"]] == r["problem"]:
                groups.setdefault(o["grp"], []).append((o["id"], o["ssr"], o["bits"], "x"))
        assert r["n"] == -brute_cover(groups, 3, {}, None)[0]


# Frames


def test_anchored_groups_and_picks(spark, sf_dir):
    from lodeframe.plans.recognition_queries import _numbered, frames_anchored_groups

    rows = sorted((r["who"], r["pos"], r["value"]) for r in _numbered(spark, sf_dir).collect())
    want, last = {}, None
    for who, pos, v in rows:
        if last is None or last[0] != who:
            last = (who, v, 0)
        elif abs(v - last[1]) > 15:
            last = (who, v, last[2] + 1)
        want[who, pos] = last[2]
    assert {(r["who"], r["pos"]): r["grp"] for r in frames_anchored_groups(spark, sf_dir).collect()} == want


def test_nearest_is_brute_force(spark):
    rnd = random.Random(5)
    left = [(rnd.randint(0, 3), i, rnd.randint(0, 40)) for i in range(80)]
    right = [(rnd.randint(0, 2), i, rnd.randint(0, 40)) for i in range(30)]
    got = {r["k"]: (r["t"], r["distance"]) for r in frames.nearest(spark.createDataFrame(left, "g int, k int, x int"), spark.createDataFrame(right, "g int, t int, x int"), "g", "x", "x", "k", "t").collect()}
    for g, k, x in left:
        best = min(((abs(x - y), t) for h, t, y in right if h == g), default=None)
        assert got.get(k, (None, None)) == ((best[1], best[0]) if best else (None, None))


def test_probes_skip_blanks(spark):
    df = spark.createDataFrame([("a", i, i in (0, 5)) for i in range(20)], "g string, i int, blank boolean")
    got = sorted(r["i"] for r in frames.probes(df, "g", ["i"], F.col("blank"), 4).collect())
    assert got == [1, 6, 10, 15]


# Analytics and operations


def test_replay_touches_only_changed_texts(spark):
    seen = []

    def classify(t):
        seen.append(sorted(r["id"] for r in t.collect()))
        return t.select("id", F.when(F.col("norm").isin("ab", "cd"), F.col("norm")).alias("matched"))

    rows = spark.createDataFrame([(1, "a8", "ab"), (2, "cd", "cd"), (3, "a8", "ab")], "k int, x string, t string")
    got = analytics.replay(rows, "k", "x", "t", classify, "8", F.col("id"), F.translate("id", "8", "b"))
    assert sorted((r["k"], r["before"], r["after"]) for r in got.collect()) == [(1, None, "ab"), (2, "cd", "cd"), (3, None, "ab")]
    assert seen == [["a8", "cd"], ["a8"]]


def test_greedy(spark):
    # Of one source the best stays; x -> z joins 1x and 1z only together with y -> z; tier 2 comes on top of tier 1.
    rows = [("a", "b", 1, 5), ("a", "d", 2, 9), ("x", "z", 1, 9), ("y", "z", 1, 4), ("q", "r", 2, 1), ("a", "e", 3, 99)]
    c = spark.createDataFrame(rows, "src string, dst string, tier int, n int")
    got = {(r["src"], r["dst"]): r["tier"] for r in analytics.greedy_accept(c, ["1x", "1y", "2q", "3a"]).collect()}
    assert got == {("a", "b"): 1, ("a", "d"): 3, ("x", "z"): 1, ("y", "z"): 3, ("q", "r"): 2, ("a", "e"): 3}


def test_shard_plan_query(spark, sf_dir):
    from lodeframe.plans.recognition_queries import lpt_shard_plan

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").collect()
    got = {r["no"]: r["shard"] for r in lpt_shard_plan(spark, sf_dir).collect()}
    for nation in {r["c_nationkey"] for r in c}:
        jobs = [(r["c_custkey"], abs(r["c_acctbal"]) if r["c_custkey"] % 9 else None) for r in c if r["c_nationkey"] == nation]
        known = [s for _, s in jobs if s is not None]
        load = [0.0] * 4
        for no, s in sorted(((n, np.median(known) if s is None else s) for n, s in jobs), key=lambda x: (-x[1], x[0])) if known else ():
            k = min(range(4), key=lambda i: (load[i], i))
            assert got[no] == k
            load[k] += s


def test_personal_data(spark):
    df = spark.createDataFrame([(1, r"C:\Users\ann\x and a.b@c.example.org"), (2, "/home/joe/f"), (3, None), (4, "ok@allowed.org")], "k int, t string")
    got = {(r["k"], r["kind"], r["found"]) for r in ops.personal_data(df, "k", "t", ["ok@allowed.org"]).collect()}
    assert (1, "email", "a.b@c.example.org") in got and (2, "path", "/home/joe") in got and not any(k in (3, 4) for k, *_ in got)


# Kernels


def test_kernels_by_hand():
    g = np.arange(25, dtype=np.uint8).reshape(5, 5)
    assert kernels.laplacian_variance(g) == 0
    rgba = np.array([[[10, 20, 30, 255]]], np.uint8)
    assert kernels.gray(rgba)[0, 0] == 18 and kernels.gray_fixed(rgba)[0, 0] == (77 * 10 + 150 * 20 + 29 * 30) >> 8
    assert kernels.find_runs(np.array([0, 5, 5, 0, 5, 0, 0, 5]), 1, gap=1) == [(1, 4), (7, 7)]
    mask = np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1], [1, 1, 1]], bool)
    assert kernels.components(mask) == [(0, 0, 2, 1, 2), (0, 2, 3, 2, 5)]
    assert kernels.close(np.array([[1, 0, 1]]), 1).tolist() == [[1, 1, 1]]
    rnd = np.random.default_rng(0)
    plane = rnd.integers(0, 255, (60, 20))
    long = rnd.integers(0, 255, (260, 20))
    shift, share, rival = kernels.seam(long[:200], long[30:230])
    assert shift == 30 and share == 0 and rival > 0.5 and kernels.confident((shift, share, rival))
    assert kernels.seam(np.full((200, 20), 250), np.full((200, 20), 250)) is None and not kernels.confident(None)
    assert kernels.seam(long[:100], long[5:105])[2] == float("inf")  # every other shift lies within the guard
    cost = rnd.random((5, 5)).tolist()
    want = min(itertools.permutations(range(5)), key=lambda p: sum(cost[a][b] for a, b in zip(p, p[1:])))
    assert kernels.best_order(cost) == list(want)
    thr = kernels.adaptive_threshold(plane, 5, 3)
    for y, x in ((0, 0), (30, 10), (59, 19)):
        box = plane[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
        assert thr[y, x] == (plane[y, x] <= box.mean() - 3)
    assert kernels.shift_between(np.arange(50.0) ** 2, np.arange(3, 53.0) ** 2, 8)[0] == 3


# Sources


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dataVersion": "2026-01-02a", "category": "x", "entries": [{"id": "1", "n": 2}, {"id": "ex-2", "n": 3}]}))
    rows = catalogs.read_catalog(spark, f"{tmp_path}/c.json").collect()
    assert [(r["pos"], r["id"], r["n"], r["dataVersion"]) for r in rows] == [(0, "1", 2, "2026-01-02a"), (1, "ex-2", 3, "2026-01-02a")]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        catalogs.read_catalogs(spark, {"a": f"{tmp_path}/c.json", "b": f"{tmp_path}/bad.json"}, {"b": T.StructType([T.StructField("id", T.StringType())])})
    (tmp_path / "a.csv").write_text('\ufeffname,value (x)\n"a ""q"", b",1\n')
    df = catalogs.read_csv(spark, f"{tmp_path}/a.csv")
    assert catalogs.column_like(df, "value") == "value (x)" and df.first()["name"] == 'a "q", b'
    (tmp_path / "x.jsonl").write_text('{"no":1}\n{broken\n{"no":2}\n')
    assert catalogs.read_jsonl(spark, f"{tmp_path}/x.jsonl", T.StructType([T.StructField("no", T.IntegerType())])).count() == 2
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>one</t></si><si><t>two</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="B1"><v>9</v></c></row><row><c r="A2" t="s"><v>0</v></c></row></sheetData></worksheet>')
    (tmp_path / "n.xlsx").write_bytes(buf.getvalue())
    assert [r["name"] for r in catalogs.read_xlsx_names(spark, f"{tmp_path}/n.xlsx").orderBy("pos").collect()] == ["two", "one"]


def test_complete_groups(spark, tmp_path):
    for stamp, parts, of in (("1", (1, 2), 2), ("2", (1,), 2), ("3", (1,), 1)):
        for p in parts:
            (tmp_path / f"block-times-{stamp}-s{p}of{of}.jsonl").write_text(f'{{"no":{p},"sec":{stamp}.5}}\n')
    schema = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("sec", T.DoubleType())])
    assert [tuple(r) for r in catalogs.newest_group(spark, str(tmp_path), schema).collect()] == [(1, 3.5)]


def test_inbox_and_writer(spark):
    msg = json.dumps({"format": "f", "persons": [{"uma": str(i), "skills": {"a": 3, "b": 9, "c": -1}} for i in range(5)]})
    df = spark.createDataFrame([(msg,), ("{",), ('{"format":"g"}',)], "s string")
    got = [r["message"] for r in catalogs.parse_inbox(df, "s", "f").collect()]
    assert len(got[0]["persons"]) == 3 and got[0]["persons"][0]["skills"] == {"a": 3, "c": -1} and got[1] is got[2] is None
    old = '{\r\n  "category": "x",\r\n  "entries": [\r\n    {"id": "1"}\r\n  ]\r\n}\r\n'
    assert catalogs.write_rows([{"id": "1"}, {"id": "2"}], {"category": "x"}, old).count("\r\n") == 7
    with pytest.raises(ValueError):
        catalogs.write_rows([], {}, '{"entries": []}')


# Streams


def _stream(spark, path, df, parts):
    for i in range(parts):
        df.where(F.col("n") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 3, i, start + timedelta(seconds=i * 7), None if i % 5 == 0 else float(i % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "who int, n int, ts timestamp, shift double")
    src = df.withColumn("n", F.expr("cast(n div 30 as int)")).withColumn("pos", F.expr("cast((unix_seconds(ts)) as long)"))
    streams.drain(streams.tracked(_stream(spark, f"{tmp_path}/in", src, 3), "who", "pos", "shift"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["who"], r["pos"]): r["position"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want, at, last = {}, {}, {}
    for r in src.orderBy("pos").collect():
        w = r["who"]
        last[w] = r["shift"] if r["shift"] is not None else last.get(w, 0.0)
        at[w] = at.get(w, 0.0) + last[w]
        want[w, r["pos"]] = at[w]
    assert got == want

    streams.drain(streams.sample_first(_stream(spark, f"{tmp_path}/in2", src, 1), "who", "ts", "1 minute", "10 minutes", "shift"), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    batch = frames.first_per_slot(src.select("who", "ts", "shift"), "who", "ts", "1 minute", ["ts"]).count()
    assert 0 <= spark.read.parquet(f"{tmp_path}/out2").count() <= batch

    twice = src.union(src)
    streams.drain(streams.once(_stream(spark, f"{tmp_path}/in3", twice, 1), "pos", "ts", "1 hour"), f"{tmp_path}/out3", f"{tmp_path}/cp3")
    assert spark.read.parquet(f"{tmp_path}/out3").count() == 90


def test_catalog_rules(spark):
    df = spark.createDataFrame([("1", '{"id":1,"x":2}'), ("2", "{}"), ("3", None)], "k string, j string")
    got = {tuple(r) for r in catalog.unknown_keys(df, "j", "k", ["id"], ["id"]).collect()}
    assert got == {("1", "unknown", "x"), ("2", "missing", "id"), ("3", "missing", "id")}


def test_threshold_at_the_very_limit():
    assert kernels.adaptive_threshold(np.full((4, 4), 100, np.uint8), 3, 0).all()
    assert not kernels.adaptive_threshold(np.full((4, 4), 100, np.uint8), 3, 1).any()


def test_colours_by_hue():
    pixels = np.array([[[60, 180, 60, 255], [60, 60, 180, 255], [255, 220, 100, 255], [20, 20, 20, 255], [180, 180, 60, 255], [170, 180, 165, 255], [40, 85, 40, 255]]], np.uint8)
    got = {k: v[0].tolist() for k, v in kernels.color_masks(pixels).items()}
    assert [i for i, x in enumerate(got["green"]) if x] == [0]
    assert [i for i, x in enumerate(got["blue"]) if x] == [1]
    assert [i for i, x in enumerate(got["gold"]) if x] == [2]
    assert [i for i, x in enumerate(got["dark"]) if x] == [3, 6] or 3 in [i for i, x in enumerate(got["dark"]) if x]


def test_stretch_cuts_two_percent():
    g = np.concatenate([np.zeros(2), np.full(48, 50), np.full(48, 150), np.full(2, 255)]).astype(np.uint8).reshape(10, 10)
    out = kernels.stretch(g)
    assert out[g == 0].tolist() == [0, 0] and set(out[g == 150]) == {255} or set(out[g == 150]) <= {150, 255}
    assert (kernels.stretch(np.full((3, 3), 7, np.uint8)) == 7).all()


def test_near_with_any_limit(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("ab", k=rnd.randint(0, 9)))
    reads, names = list({word() for _ in range(60)}), list({word() for _ in range(40)} - {""})
    frames = [spark.createDataFrame([(x,) for x in v], "norm string") for v in (reads, names)]
    for limit in (0, 2, 5):
        got = {(r["r_norm"], r["e_norm"]) for r in fuzzy.near(*frames, limit=lambda n: F.lit(limit)).collect()}
        assert got == {(a, b) for a in reads for b in names if len(text.align(a, b)) <= limit}


def test_closure_of_a_long_chain(spark):
    e = spark.range(100).select(F.col("id").alias("c"), (F.col("id") + 1).alias("p"))
    got = {(r["c"], r["p"]): r["depth"] for r in planning.closure(e, "c", "p").collect()}
    assert got == {(a, b): b - a for a in range(101) for b in range(a + 1, 101)}


def test_pruned_options_lose_no_answer():
    rnd = random.Random(9)
    for _ in range(60):
        groups = {g: [(f"{g}{i}", rnd.randint(0, 1), rnd.randrange(64), rnd.choice("xy")) for i in range(5)] for g in "abc"}
        want = max(
            ((b, -len(c), s, c) for c, b, s in (
                (sorted(o[0] for o in pick if o), (lambda u: u.bit_count())(__import__("functools").reduce(lambda x, o: x | o[2], [o for o in pick if o], 0)), sum(o[1] for o in pick if o))
                for pick in itertools.product(*([None, *v] for v in groups.values())))),
            key=lambda t: (t[0], t[1], t[2], [[-ord(ch) for ch in x] for x in t[3]]),
        )
        got = planning.solve_cover(groups, 3)
        assert (got["n"], got["cards"]) == (want[0], want[3])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to a.b+c@x-y.example.org.", ["a.b+c@x-y.example.org"]), ("x..y@host.de", ["y@host.de"]), ("@host.de a@b c@d.e", []),
        ("a@-x.com a@x-.com a@x.c0m a@x.com9", []), ("<p_q%1@sub.example.museum>, A@B.CO", ["p_q%1@sub.example.museum", "A@B.CO"]),
        (".a@b.cd b.@c.de", ["a@b.cd"]), ("ä@b.cd aä@b.cd ab@ä.cd", []), ("x@y.com@z.net", ["x@y.com"]),
    ],
)
def test_addresses(text, found):
    import re

    assert [m[1] for m in re.finditer(ops.EMAIL, text)] == found
