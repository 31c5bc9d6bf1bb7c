"""Queries over orders and lists, truth from reads, and the choice of frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions import stars as S
from lodeframe.operators import catalog, fuzzy, planning, ranking, selection, store, truth
from lodeframe.plans.base import FAMILY, STARS, READS, family, frames, names, ok_sql, query, reads, stars
from lodeframe.plans.recognition_queries import _NEAR
from lodeframe.session import table

# Orders and lists


@query(f"""WITH {_NEAR}, k AS (SELECT id, name, dist::INT AS distance, row_number() OVER (PARTITION BY id ORDER BY dist, length(name) DESC, name)::INT AS place FROM near)
SELECT id, place, name, distance FROM k WHERE place <= 8""")
def near_candidates(spark, d):
    return ranking.near_candidates(reads(spark, d), names(spark, d), "id")


_DAYS = "days AS (SELECT o_custkey AS pid, max(o_orderdate) AS day, o_custkey AS no FROM orders GROUP BY o_custkey)"


def _days(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("pid")).agg(F.max("o_orderdate").alias("day")).withColumn("no", F.col("pid"))


@query(f"""WITH {FAMILY}, {_DAYS}, n AS (SELECT pid, count(*) FILTER ({' OR '.join(ok_sql(r, 3) for r in ('own', 'g1', 'g2'))}) AS n FROM family GROUP BY pid)
SELECT pid, row_number() OVER (ORDER BY day DESC, no DESC) - 1 AS by_day, row_number() OVER (ORDER BY coalesce(n, 0) DESC, day DESC, no DESC) - 1 AS by_coverage,
  row_number() OVER (ORDER BY c_mktsegment = 'BUILDING' DESC, day DESC, no DESC) - 1 AS by_owner FROM days JOIN customer ON c_custkey = pid LEFT JOIN n USING (pid)""")
def parent_sorts(spark, d):
    """The newest first; those that cover most first; one's own first."""
    n = family(spark, d).groupBy("pid").agg(F.count_if(S.family_has(3, F.col("own"), F.col("g1"), F.col("g2"))).alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_mktsegment") == "BUILDING").alias("self"))
    p = _days(spark, d).join(c, "pid").join(n, "pid", "left").na.fill(0, ["n"])
    newest = [F.desc("day"), F.desc("no")]
    p = ranking.places(p, newest, "by_day")
    p = ranking.places(p, [F.desc("n"), *newest], "by_coverage")
    p = ranking.places(p, [F.desc("self"), *newest], "by_owner")
    return p.select("pid", "by_day", "by_coverage", "by_owner")


@query(f"""WITH {FAMILY}, {_DAYS}, n AS (SELECT pid, count(*) FILTER ({ok_sql('own', 1)}) AS n FROM family GROUP BY pid)
SELECT skill, row_number() OVER (PARTITION BY skill ORDER BY n DESC, day DESC, no DESC)::INT AS place, pid, coalesce(own, 0) AS own, NOT {ok_sql('own', 1)} AS only_gp
FROM family JOIN n USING (pid) JOIN days USING (pid) WHERE {' OR '.join(ok_sql(r, 1) for r in ('own', 'g1', 'g2'))}""")
def skill_holders(spark, d):
    return ranking.holders_list(family(spark, d), _days(spark, d), "pid", "skill").select("skill", "place", "pid", "own", "only_gp")


@query(f"""WITH {_NEAR}, b AS (SELECT id, min(dist) AS dist FROM near GROUP BY id), g AS (SELECT p_name AS name, min(p_partkey) AS pos FROM part WHERE p_size > 10 GROUP BY p_name),
  r AS (SELECT reads.id, reads.id % 20 AS image, norm, CASE WHEN dist = 0 THEN 0 WHEN dist IS NOT NULL THEN 1 ELSE 2 END AS state, pos FROM reads LEFT JOIN b ON b.id = reads.id LEFT JOIN g ON g.name = norm)
SELECT id, image, row_number() OVER (PARTITION BY image ORDER BY state, pos IS NULL, pos, norm, id)::INT AS place FROM r""")
def result_order(spark, d):
    """Decided reads in the game's order, then the others by name."""
    r = reads(spark, d)
    best = fuzzy.near(r, names(spark, d)).groupBy(F.col("r_id").alias("id")).agg(F.min("distance").alias("dist"))
    game = table(spark, d, "part").where("p_size > 10").groupBy(F.col("p_name").alias("norm")).agg(F.min("p_partkey").alias("pos"))
    state = F.when(F.col("dist") == 0, 0).when(F.col("dist").isNotNull(), 1).otherwise(2)
    j = r.join(best, "id", "left").join(game, "norm", "left").withColumn("image", F.col("id") % 20)
    return ranking.result_order(j, "image", state, "pos", F.struct("norm", "id")).select("id", "image", "place")


@query("""SELECT s_suppkey AS k, n_regionkey::BIGINT AS pos, n_regionkey IS NULL AS missing FROM supplier LEFT JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 2) ON n_nationkey = s_nationkey""")
def display_order(spark, d):
    """Rows by the place of their key in an order file; a key that it lacks is an error."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("key"))
    n = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("long").alias("pos"))
    return ranking.display_order(s, n, "key").select("k", "pos", "missing")


@query("""SELECT p_partkey AS k FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND list_has_any(string_split(p_name, ' '), ['small', 'red', 'blue', 'large', 'ring'])
  AND contains(p_name, 'i') AND p_size > 20""")
def visible_rows(spark, d):
    """Rows of the chosen categories, with any of the chosen tags, whose name has the text, of the newer list."""
    p = table(spark, d, "part").withColumn("tags", F.split("p_name", " "))
    chosen = {"p_brand": ["Brand#1", "Brand#2", "Brand#3"], "tags": ["small", "red", "blue", "large", "ring"], "p_type": []}
    return ranking.visible_rows(p, "p_name", " i ", chosen, "new", F.col("p_size") <= 20).select(F.col("p_partkey").alias("k"))


_CELLS = """cells AS (SELECT l_partkey AS skill, l_suppkey AS candidate, CASE WHEN l_returnflag = 'R' THEN l_linenumber - 1 ELSE 0 END AS star FROM lineitem),
  sums AS (SELECT skill, coalesce(sum(star) FILTER (s_suppkey % 3 = 0), 0)::BIGINT AS total FROM cells LEFT JOIN supplier ON s_suppkey = candidate GROUP BY skill)"""


def _sums(spark, d):
    star = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") - 1).otherwise(0)
    cells = table(spark, d, "lineitem").select(F.col("l_partkey").alias("skill"), F.col("l_suppkey").alias("candidate"), star.alias("star"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate"), (F.col("s_suppkey") % 3 == 0).alias("enabled"))
    return ranking.enabled_sums(cells, c, "skill", "candidate", "star")


@query(f"WITH {_CELLS} SELECT skill, total FROM sums")
def enabled_sums(spark, d):
    return _sums(spark, d)


@query(f"WITH {_CELLS} SELECT skill, total FROM sums WHERE total = 0")
def row_filter_zero(spark, d):
    return ranking.row_filter(_sums(spark, d), "zero")


@query(f"WITH {_CELLS} SELECT skill, total FROM sums WHERE total > 0")
def row_filter_nonzero(spark, d):
    return ranking.row_filter(_sums(spark, d), "nonzero")


@query("""SELECT s_suppkey AS key, count(DISTINCT o_custkey) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def set_membership_counts(spark, d):
    """How many records are in each set; a set may be named twice by one, and sets may be empty."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))
    p = li.join(o, "l_orderkey").groupBy("pid").agg(F.collect_list("l_suppkey").alias("sets"))
    return ranking.set_counts(p, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")), "pid", "sets", "key")


@query("""SELECT c_nationkey AS who, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') OR c_acctbal < 0 THEN 'plain' ELSE c_mktsegment END AS kind, count(*) AS n FROM customer GROUP BY ALL""")
def kind_counts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("who"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("kind"))
    return ranking.kind_counts(c, "who", "kind", ["AUTOMOBILE", "MACHINERY"])


@query("""SELECT user_id, count(DISTINCT nullif(upper(trim(CASE WHEN value < 20 THEN ' ' ELSE event_type END)), '')) AS kinds, count(*) AS items FROM events GROUP BY user_id""")
def distinct_kinds(spark, d):
    e = table(spark, d, "events").withColumn("raw", F.when(F.col("value") < 20, " ").otherwise(F.col("event_type")))
    return ranking.distinct_kinds(e, "user_id", F.upper(F.trim("raw")))


@query("""WITH f AS (SELECT o_custkey AS pid, p_brand AS name, min((o_orderkey, l_linenumber, l_partkey)) AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT pid, list(name ORDER BY o, name) AS names FROM f GROUP BY pid""")
def first_seen_names(spark, d):
    """Each record's different names, in the order in which they come first in its nested lists."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    j = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey").join(p, "l_partkey")
    return ranking.first_seen(j, "pid", ["l_orderkey", "l_linenumber", "l_partkey"], "name")


# Joins by place


@query("""SELECT c_nationkey AS who, c_custkey AS block, min(s_suppkey) AS col FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 1500 GROUP BY ALL""")
def containment_first_column(spark, d):
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("who"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("block"))
    c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("who"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("col"))
    return selection.first_column(b, c, "who", "x", "block", "col", 1500.0)


@query("""WITH l AS (SELECT c_nationkey AS who, c_custkey AS k, c_acctbal AS x0, c_acctbal + 1500 AS x1, (c_custkey % 50)::DOUBLE AS y0, c_custkey % 50 + 16.5 AS y1 FROM customer),
  r AS (SELECT s_nationkey AS who, s_suppkey AS k, s_acctbal AS x0, s_acctbal + 2500 AS x1, (s_suppkey % 50)::DOUBLE AS y0, s_suppkey % 50 + 9.5 AS y1 FROM supplier)
SELECT who, l.k AS lk, r.k AS rk FROM l JOIN r USING (who) WHERE l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1""")
def rectangle_overlap_join(spark, d):
    def box(t, p, key, w, h):
        x, y = F.col(f"{p}_acctbal"), (F.col(key) % 50).cast("double")
        return table(spark, d, t).select(F.col(f"{p}_nationkey").alias("who"), F.col(key).alias("k"), x.alias("x0"), (x + w).alias("x1"), y.alias("y0"), (y + h).alias("y1"))

    return selection.rectangles_meet(box("customer", "c", "c_custkey", 1500, 16.5), box("supplier", "s", "s_suppkey", 2500, 9.5), "who", 2000.0, 10.0)


@query("""WITH w AS (SELECT p_partkey AS k, first_value(p_brand) OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS kept, p_brand FROM part) SELECT k, kept, kept <> p_brand AS clash FROM w""")
def conflict_join(spark, d):
    p = table(spark, d, "part")
    return truth.conflicts(p, "p_name", "p_brand", [F.desc("p_size"), "p_partkey"]).select(F.col("p_partkey").alias("k"), "kept", "clash")


# Truth from reads

_FOUR = f"""{READS}, e AS (SELECT name FROM dict UNION ALL SELECT name FROM dict WHERE name LIKE 'blue%'),
  r AS (SELECT id, nullif(norm, '') AS strict, translate(norm, '0c', 'oe') AS ful FROM reads), ef AS (SELECT name, translate(name, '0c', 'oe') AS ful FROM e),
  s AS (SELECT name AS strict, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT ful, count(*) AS n, min(name) AS name FROM ef GROUP BY ful),
  c AS (SELECT r.id, r.ful, s.n AS sn, f.n AS fn, strict, f.name FROM r LEFT JOIN s USING (strict) LEFT JOIN f USING (ful)),
  d AS (SELECT id, min(levenshtein(c.ful, f.ful)) AS dist FROM c JOIN f ON levenshtein(c.ful, f.ful) <= CASE WHEN length(f.ful) <= 2 THEN 0 WHEN length(f.ful) <= 5 THEN 1 WHEN length(f.ful) <= 9 THEN 2 ELSE 3 END WHERE fn IS NULL GROUP BY id)"""


@query(f"""WITH {_FOUR} SELECT id, CASE WHEN sn = 1 THEN 'exact' WHEN fn = 1 THEN 'via_map' WHEN fn > 1 OR dist IS NOT NULL THEN 'ambiguous' ELSE 'unreadable' END AS category,
  CASE WHEN sn = 1 THEN strict WHEN fn = 1 THEN name END AS skill, (CASE WHEN sn = 1 OR fn >= 1 THEN 0 ELSE dist END)::INT AS distance FROM c LEFT JOIN d USING (id)""")
def four_way_classes(spark, d):
    n = names(spark, d).select("name")
    alike = lambda c: F.translate(c, "0c", "oe")
    e = n.union(n.where("name LIKE 'blue%'")).select("name", F.col("name").alias("strict"), alike("name").alias("full"))
    r = reads(spark, d).select("id", F.col("norm").alias("strict"), alike("norm").alias("full"))
    return truth.four_way(r, e, "id")


@query(f"""WITH {READS}, n AS (SELECT id, name, levenshtein(norm, name) AS dist, count(*) OVER (PARTITION BY id) AS n FROM reads JOIN dict ON levenshtein(norm, name) <= CASE WHEN length(name) <= 2 THEN 0 ELSE 1 END)
SELECT id, name FROM n WHERE dist = 0 OR n = 1""")
def strict_post_filter(spark, d):
    """Reads that equal an entry, or have one alone within distance 1."""
    return truth.strict_accept(reads(spark, d), names(spark, d), "id")


@query(f"""WITH {READS}, e AS (SELECT upper(name) AS norm, min(name) AS matched FROM dict GROUP BY ALL) SELECT id, matched FROM (SELECT id, upper(norm) AS norm FROM reads) LEFT JOIN e USING (norm)""")
def pasted_names(spark, d):
    e = names(spark, d).select("name", F.upper("name").alias("norm"))
    return truth.resolve_names(reads(spark, d).select("id", F.upper("norm").alias("norm")), e).select("id", "matched")


@query("""WITH f AS (SELECT l_suppkey AS tab, count(DISTINCT l_partkey) AS kinds FROM lineitem GROUP BY ALL), b AS (SELECT s_suppkey AS tab, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN kinds ELSE 5 END AS expected FROM supplier JOIN f ON tab = s_suppkey)
SELECT tab, kinds, expected, kinds = expected AS complete FROM f LEFT JOIN b USING (tab)""")
def completeness_check(spark, d):
    """Kinds found against what a badge says; a badge that was not read judges nothing."""
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tab"), F.col("l_partkey").alias("kind"))
    n = f.groupBy("tab").agg(F.count_distinct("kind").alias("n"))
    third = F.col("tab") % 3
    expected = F.when(third == 1, F.col("n")).when(third == 2, F.lit(5).cast("long"))
    return truth.completeness(f, n.select("tab", expected.alias("expected")), "tab", "kind", "expected")


@query("""SELECT l_orderkey AS member, l_linenumber AS line, l_partkey AS part, CASE WHEN l_tax > 0.02 THEN name END AS name, coalesce(CASE WHEN l_tax > 0.02 THEN status END, 'check') AS status
FROM lineitem LEFT JOIN (SELECT p_partkey, p_name AS name, CASE WHEN p_size > 25 THEN 'voted' ELSE 'override' END AS status FROM part WHERE p_brand <> 'Brand#1') ON p_partkey = l_partkey""")
def decision_write_back(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("member"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "l_tax")
    rows = table(spark, d, "part").where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "voted").otherwise("override").alias("status"))
    return truth.write_back(li, rows, "part", F.col("l_tax") <= 0.02).select("member", "line", "part", "name", "status")


@query("""SELECT l_orderkey AS card, l_linenumber AS line, need FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT unnest([true, false]) AS need) ON true
WHERE l_returnflag <> 'N' AND (s_nationkey >= 8 OR (NOT need AND l_linestatus <> 'O'))""")
def provisional_truth(spark, d):
    """Cards that count with and without the demand that a person confirmed their set."""
    li = table(spark, d, "lineitem")
    cards = li.select(F.col("l_orderkey").alias("card"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("of"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("name"),
                      F.when(F.col("l_linestatus") == "O", "check").alias("decided_by"))
    sets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("of"), (F.col("s_nationkey") < 8).alias("provisional"))
    both = [truth.usable_truth(cards, sets, "of", need).select("card", "line", F.lit(need).alias("need")) for need in (True, False)]
    return both[0].union(both[1])


_TAB = f"""{READS}, cards AS (SELECT id // 5 AS card, id % 3 AS tab, id AS ord, norm FROM reads), uni AS (SELECT DISTINCT p_partkey % 3 AS tab, p_name AS name FROM part WHERE length(p_name) % 3 <> p_partkey % 3),
  hits AS (SELECT cards.*, uni.name FROM cards LEFT JOIN uni ON uni.tab = cards.tab AND name = norm)"""


def _tabs(spark, d):
    r = reads(spark, d).select(F.expr("id div 5").alias("card"), (F.col("id") % 3).alias("tab"), F.col("id").alias("ord"), "norm")
    u = table(spark, d, "part").where("length(p_name) % 3 <> p_partkey % 3").select((F.col("p_partkey") % 3).alias("tab"), F.col("p_name").alias("name"), F.col("p_name").alias("norm")).distinct()
    return r, u


@query(f"WITH {_TAB} SELECT card, min_by(name, CASE WHEN name IS NOT NULL THEN ord END) AS name FROM hits GROUP BY card")
def exact_in_tab(spark, d):
    """Of each card's reads the first that equals a name of its own tab."""
    r, u = _tabs(spark, d)
    return truth.exact_in_tab(r, u, "card", "tab", "ord", "norm", "name")


@query(f"WITH {_TAB} SELECT ord, tab, norm AS name FROM hits WHERE name IS NULL AND norm IN (SELECT p_name FROM part) AND tab <> 1")
def outside_complete_tab(spark, d):
    """Reads accepted with a name that a complete tab does not hold."""
    r, u = _tabs(spark, d)
    known = table(spark, d, "part").select(F.col("p_name").alias("norm")).distinct()
    accepted = r.join(known, "norm", "left_semi").select("ord", "tab", F.col("norm").alias("name"))
    complete = spark.createDataFrame([(0, True), (1, False), (2, True)], "tab long, complete boolean")
    return truth.outside_tab(accepted, u, complete, "tab", "name").select("ord", "tab", "name")


@query("""WITH w AS (SELECT l_orderkey AS r, l_linenumber AS m, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_suppkey FROM lineitem)
SELECT r, l_suppkey AS s, p, m FROM w WHERE n <= 3 OR i IN (0, n - 1, floor((n - 1) / 2.0 + 0.5))""")
def overlap_sample(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("m"))
    return truth.overlap_sample(li.withColumn("o", F.struct("m", "p", "s")), "r", "o", 3).drop("o")


# Choice of frames


@query("""WITH v AS (SELECT user_id AS who, event_id, CASE WHEN event_type <> 'error' THEN value END AS sharp FROM events),
  k AS (SELECT who, sharp, count(*) OVER (PARTITION BY who) AS n, row_number() OVER (PARTITION BY who ORDER BY sharp) - 1 AS r FROM v WHERE sharp IS NOT NULL),
  s AS (SELECT who, max(sharp) FILTER (r = floor((n - 1) * 0.95::DOUBLE + 0.5)) AS high, max(sharp) FILTER (r = floor((n - 1) * 0.05::DOUBLE + 0.5)) AS low FROM k GROUP BY who)
SELECT event_id, coalesce(sharp >= high * 0.8::DOUBLE, FALSE) AS enough, round(CASE WHEN high > 0 THEN low / high ELSE 0 END, 9) AS spread FROM v LEFT JOIN s USING (who)""")
def relative_threshold(spark, d):
    f = frames(spark, d).withColumn("sharp", F.when(F.col("event_type") != "error", F.col("value")))
    return selection.sharp_enough(f, "who", "sharp").select("event_id", "enough", F.round("spread", 9).alias("spread"))


@query("""WITH k AS (SELECT user_id AS who, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS place FROM events),
  l AS (SELECT *, greatest(1, floor(n * 0.15::DOUBLE + 0.5)) AS low FROM k)
SELECT who, event_id, place::INT AS place FROM l WHERE place < low AND place % ceil(low / 4)::BIGINT = 0""")
def bottom_fraction_sample(spark, d):
    return selection.blurriest(frames(spark, d), "who", "value", "event_id", 0.15, 4).select("who", "event_id", "place")


@query("""WITH f AS (SELECT user_id AS who, event_id, value, event_type FROM events), k AS (SELECT who, abs(value - lag(value) OVER (PARTITION BY who ORDER BY event_id)) AS g FROM f WHERE event_type = 'click')
SELECT who, round(coalesce(g, 0), 6) AS max_gap, round(total, 6) AS total FROM (SELECT who, abs(max_by(value, event_id) - min_by(value, event_id)) AS total FROM f GROUP BY who) LEFT JOIN (SELECT who, max(g) AS g FROM k GROUP BY who) USING (who)""")
def kept_gaps(spark, d):
    g = selection.kept_gaps(frames(spark, d), "who", "event_id", "value", F.col("event_type") == "click")
    return g.select("who", F.round("max_gap", 6).alias("max_gap"), F.round("total", 6).alias("total"))


@query("""WITH f AS (SELECT user_id AS who, value AS a, value + event_id % 50 AS b FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY who) AS n, row_number() OVER (PARTITION BY who ORDER BY a) - 1 AS r FROM f),
  m AS (SELECT who, a AS mid FROM k WHERE r = n // 2) SELECT who, any_value(mid) AS start, max(b) AS end FROM f JOIN m USING (who) WHERE abs(a - mid) <= 4 GROUP BY who""")
def robust_band(spark, d):
    f = frames(spark, d).select("who", F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 50).alias("b"))
    return selection.robust_band(f, "who", "a", "b", 200.0)


@query("""WITH f AS (SELECT user_id AS who, event_id, floor(value / 10) AS place, event_id % 97 AS y, event_type = 'view' AS w, value < 30 AS s FROM events), t AS (SELECT *, min(place) OVER (PARTITION BY who) AS top FROM f),
  k AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY CASE WHEN w AND s THEN 0 WHEN w THEN 1 ELSE 2 END, y, event_id) AS k FROM t WHERE place - top <= 2) SELECT who, event_id FROM k WHERE k = 1""")
def anchor_choice(spark, d):
    f = frames(spark, d).select("who", "event_id", F.floor(F.col("value") / 10).alias("place"), (F.col("event_id") % 97).alias("y"), F.col("event_id").alias("t"),
                                (F.col("event_type") == "view").alias("in_window"), (F.col("value") < 30).alias("still"))
    return selection.pick_anchors(f, ["who"], 2).select("who", "event_id")


@query("""WITH f AS (SELECT user_id AS who, event_id AS o, (event_id // 40 + event_id % 11 * 8)::DOUBLE AS p, event_type = 'view' AS still FROM events),
  l AS (SELECT *, max(CASE WHEN still THEN o END) OVER (PARTITION BY who) AS lo, max(p) OVER (PARTITION BY who) AS most, min(o) OVER (PARTITION BY who) AS first FROM f),
  r AS (SELECT *, max(CASE WHEN o = lo THEN p END) OVER (PARTITION BY who) AS rest, max(CASE WHEN o > lo THEN p END) OVER (PARTITION BY who) AS after FROM l)
SELECT who, o FROM r WHERE NOT coalesce(coalesce(after <= rest + 30, TRUE) AND most - rest <= 100 AND NOT still AND o > first AND p > rest + 24, FALSE)""")
def overscroll_trim(spark, d):
    o = F.col("event_id")
    f = frames(spark, d).select("who", o.alias("o"), (F.expr("event_id div 40") + o % 11 * 8).cast("double").alias("p"), (F.col("event_type") == "view").alias("still"))
    return selection.trim_overscroll(f, "who", "o", "p", F.col("still"), 400.0, 30.0).select("who", "o")


@query("""WITH f AS (SELECT user_id AS who, event_id * 0.7::DOUBLE AS sec, event_id % 9 AS x, event_id % 4 AS y FROM events), a AS (SELECT user_id AS who, 4 AS x, 1 AS y, max(event_id) * 0.7::DOUBLE AS duration FROM events GROUP BY user_id)
SELECT who, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM (SELECT who, greatest(0, min(sec)) AS t0, least(any_value(duration), max(sec) + 0.7::DOUBLE) AS t1 FROM f JOIN a USING (who) WHERE abs(f.x - a.x) <= 2 AND abs(f.y - a.y) <= 2 GROUP BY who) WHERE t1 - t0 >= 1""")
def agreeing_span(spark, d):
    e = F.col("event_id")
    f = frames(spark, d).select("who", (e * 0.7).alias("sec"), (e % 9).alias("x"), (e % 4).alias("y"))
    a = frames(spark, d).groupBy("who").agg((F.max("event_id") * 0.7).alias("duration")).select("who", "duration", F.lit(4).alias("x"), F.lit(1).alias("y"))
    s = selection.agreeing_span(f, "who", "sec", ["x", "y"], a, "duration", 0.7)
    return s.select("who", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query("""WITH f AS (SELECT user_id AS who, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, value > 30 AS on_ FROM events), q AS (SELECT who, pos, pos - row_number() OVER (PARTITION BY who ORDER BY pos) AS g FROM f WHERE NOT on_),
  s AS (SELECT who, min(pos) AS a, max(pos) AS b FROM q GROUP BY who, g HAVING count(*) >= 3) SELECT who, min(a)::INT AS a, arg_min(b, a)::INT AS b FROM s GROUP BY who""")
def first_quiet_run(spark, d):
    pos = F.row_number().over(Window.partitionBy("who").orderBy("event_id"))
    return selection.first_quiet(frames(spark, d).withColumn("pos", pos), "who", "pos", F.col("value") > 30, 3)


# Planning, checks and migration

_POOL = """rows AS (SELECT l_suppkey AS card, CASE min(l_returnflag) WHEN 'A' THEN 'done' WHEN 'N' THEN 'none' ELSE 'seeded' END AS state FROM lineitem GROUP BY ALL),
  cards AS (SELECT s_suppkey AS card, CASE s_nationkey % 3 WHEN 0 THEN 'SSR' WHEN 1 THEN 'SR' ELSE 'R' END AS rarity, s_acctbal < 0 AS grp FROM supplier)"""


@query(f"""WITH {_POOL} SELECT card FROM cards JOIN rows USING (card) WHERE rarity <> 'R' AND NOT grp AND state <> 'seeded' AND card NOT IN (3, 4, 6) AND card NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)""")
def card_pool(spark, d):
    li = table(spark, d, "lineitem")
    flag = F.min("l_returnflag")
    rows = li.groupBy(F.col("l_suppkey").alias("card")).agg(F.when(flag == "A", "done").when(flag == "N", "none").otherwise("seeded").alias("state"))
    s = table(spark, d, "supplier")
    third = F.col("s_nationkey") % 3
    cards = s.select(F.col("s_suppkey").alias("card"), F.when(third == 0, "SSR").when(third == 1, "SR").otherwise("R").alias("rarity"), (F.col("s_acctbal") < 0).alias("is_group"))
    roster = spark.createDataFrame([(3,), (4,), (6,), (10**9,)], "card long")
    excluded = li.where("l_quantity = 50 AND l_linenumber = 7").select(F.col("l_suppkey").alias("card"))
    return planning.card_pool(cards, rows, "card", roster, excluded).select("card")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 1), r(c, p) AS (SELECT c, p FROM s UNION SELECT r.c, s.p FROM r JOIN s ON s.c = r.p),
  gold AS (SELECT p_partkey AS skill FROM part WHERE p_partkey % 7 = 0), pop AS (SELECT p_partkey AS skill FROM part WHERE p_size > 40 AND p_partkey % 7 <> 0),
  own AS (SELECT DISTINCT l_suppkey AS card, l_partkey AS skill FROM lineitem), b AS (SELECT card, own.skill, p FROM own JOIN gold USING (skill) JOIN r ON c = own.skill JOIN pop ON pop.skill = p),
  w AS (SELECT card, count(*) AS n FROM (SELECT card, skill FROM own JOIN pop USING (skill) UNION SELECT card, p FROM b) GROUP BY card), g AS (SELECT card, count(DISTINCT skill) AS n FROM b GROUP BY card)
SELECT card, coalesce(w.n, 0) AS whites, coalesce(g.n, 0) AS golds, coalesce(w.n, 0) + coalesce(g.n, 0) AS score FROM (SELECT DISTINCT card FROM own) LEFT JOIN w USING (card) LEFT JOIN g USING (card)""")
def score_closure(spark, d):
    """What each card brings, the chains of its golds included."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    chain = planning.closure(p.where("p_partkey > 1").select(key.alias("skill"), F.expr("p_partkey div 2").alias("prev")), "skill", "prev")
    golds = p.where("p_partkey % 7 = 0").select(key.alias("skill"))
    pop = p.where("p_size > 40 AND p_partkey % 7 <> 0").select(key.alias("skill"))
    gains = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("card"), F.col("l_partkey").alias("skill"))
    return planning.score(gains, chain, golds, pop, "card", "skill")


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, [CASE WHEN p_size % 2 = 0 THEN 'S' ELSE 'R' END, CASE WHEN p_size % 3 = 0 THEN 'B' ELSE 'other' END] AS tags FROM part),
  n AS (SELECT *, list_filter([CASE WHEN contains(name, 'small') THEN 'S' END, CASE WHEN contains(name, 'red') THEN 'R' END, CASE WHEN contains(name, 'blue') THEN 'B' END], lambda x: x IS NOT NULL) AS named, list_filter(tags, lambda x: x <> 'other') AS known FROM p),
  o AS (SELECT k, list_sort(list_filter(named, lambda x: NOT list_contains(known, x))) AS lacking, list_sort(list_filter(known, lambda x: NOT list_contains(named, x))) AS extra FROM n)
SELECT k, lacking, extra FROM o WHERE len(lacking) > 0 OR len(extra) > 0""")
def tag_name_agreement(spark, d):
    size = F.col("p_size")
    tags = F.array(F.when(size % 2 == 0, "S").otherwise("R"), F.when(size % 3 == 0, "B").otherwise("other"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), tags.alias("tags"))
    return catalog.tag_disagreements(p, "k", "tags", "name", {"S": "small", "R": "red", "B": "blue"})


_BUNDLES = """bundles AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'dirt' ELSE 'turf' END AS surface, CASE s_nationkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'mile' WHEN 2 THEN 'long' ELSE 'else' END AS dist FROM supplier),
  b AS (SELECT id, CASE WHEN surface = 'dirt' THEN 'dirt' WHEN dist = 'else' THEN 'medium' ELSE dist END AS category FROM bundles)"""


def _bundles(spark, d):
    s, li = table(spark, d, "supplier"), table(spark, d, "lineitem")
    at = F.col("s_nationkey") % 4
    dist = F.when(at == 0, "short").when(at == 1, "mile").when(at == 2, "long").otherwise("else")
    want = li.groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set("l_partkey").alias("want"))
    b = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "dirt").otherwise("turf").alias("surface"), dist.alias("dist"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))
    named = li.select("l_orderkey", "l_suppkey").join(o, "l_orderkey").groupBy("pid").agg(F.collect_list("l_suppkey").alias("bundles"))
    return store.migrate_bundles(b.join(want, "id", "left"), named, ["short", "mile", "medium", "long"])


@query(f"""WITH {_BUNDLES} SELECT category, list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)) AS skills FROM b LEFT JOIN lineitem ON l_suppkey = id GROUP BY category""")
def migrate_sets(spark, d):
    return _bundles(spark, d)[0]


@query(f"""WITH {_BUNDLES} SELECT o_custkey AS pid, list_sort(list(DISTINCT category)) AS sets FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN b ON id = l_suppkey GROUP BY o_custkey""")
def migrate_parents(spark, d):
    return _bundles(spark, d)[1]


@query(f"""WITH {STARS}, was AS (SELECT pid, skill, CASE WHEN pid % 5 = 0 AND star = 1 THEN 2 ELSE star END AS star FROM stars WHERE pid % 11 <> 0 OR star <> 3)
SELECT pid, NOT bool_and(coalesce(a.star = b.star, FALSE)) AS edited FROM stars a FULL JOIN was b USING (pid, skill) GROUP BY pid""")
def cells_edited(spark, d):
    """Records whose cells differ from what was read."""
    now = stars(spark, d)
    was = now.where("pid % 11 <> 0 OR star <> 3").withColumn("star", F.when((F.col("pid") % 5 == 0) & (F.col("star") == 1), 2).otherwise(F.col("star")))
    return store.edited(now, was, "pid", ["skill"], "star")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '' ELSE month(o_orderdate) || '/' || day(o_orderdate) END AS label FROM orders""")
def race_labels(spark, d):
    """M/D of a day, else the label that stands for it."""
    third = F.col("o_orderkey") % 3
    day = F.when(third == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(third == 1, "soon")
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), S.race_label(day, F.when(third == 0, F.col("o_orderpriority"))).alias("label"))
