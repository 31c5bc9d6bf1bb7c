"""Queries over dictionary matching, consensus, error analytics, frames, operations and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions import kernels, stars as S, text as X
from lodeframe.operators import analytics, catalog, consensus, frames as O, fuzzy, ops
from lodeframe.plans.base import READS, frames, names, query, reads
from lodeframe.session import table

# Dictionary matching

_NEAR = f"""{READS}, near AS (SELECT id, truth, name, levenshtein(norm, name) AS dist FROM reads JOIN limits ON abs(length(norm) - length(name)) <= lim WHERE levenshtein(norm, name) <= lim)"""


@query(f"WITH {_NEAR} SELECT id, name, dist::INT AS distance FROM near")
def fuzzy_allowed_distance_hits(spark, d):
    n = fuzzy.near(reads(spark, d), names(spark, d))
    return n.select(F.col("r_id").alias("id"), F.col("e_name").alias("name"), "distance")


@query(f"""WITH {_NEAR}, r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY dist, length(name) DESC) AS k FROM near)
SELECT id, min(name) AS name, min(dist)::INT AS distance, count(*)::INT AS n_best, count(*) > 1 AS tied FROM r WHERE k = 1 GROUP BY id""")
def fuzzy_best_candidate(spark, d):
    b = fuzzy.best_candidates(fuzzy.near(reads(spark, d), names(spark, d)), "r_id", "e_name")
    return b.select(F.col("r_id").alias("id"), F.col("e_name").alias("name"), "distance", "n_best", "tied")


@query(f"""WITH {_NEAR}, r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY dist, length(name) DESC) AS k FROM near)
SELECT id, list_sort(list(name)) AS candidates FROM r WHERE k = 1 GROUP BY id HAVING count(*) > 1""")
def fuzzy_ambiguous_ties(spark, d):
    """Reads whose nearest, longest entries are several, with these."""
    found = fuzzy.near(reads(spark, d), names(spark, d))
    k = F.rank().over(Window.partitionBy("r_id").orderBy("distance", F.desc(F.length("e_name"))))
    return found.withColumn("k", k).where("k = 1").groupBy(F.col("r_id").alias("id")).agg(F.array_sort(F.collect_list("e_name")).alias("candidates")).where(F.size("candidates") > 1)


@query(f"""WITH {READS}, m AS (SELECT id, name, levenshtein(norm, name) AS dist, lim FROM reads, limits WHERE levenshtein(norm, name) <= lim + 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist > lim, dist, length(name) DESC, name) AS k FROM m)
SELECT reads.id, CASE WHEN name IS NULL THEN 'other' WHEN dist <= lim THEN 'fuzzy' ELSE 'typo' END AS log, name AS best, dist::INT AS distance
FROM reads LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (id) WHERE dist IS NULL OR dist > 0""")
def fuzzy_near_misses(spark, d):
    """What a person should see of the matching: inexact matches, typing errors just out of reach, and the rest."""
    return fuzzy.near_misses(reads(spark, d), names(spark, d), "id")


@query(f"WITH {_NEAR} SELECT id FROM reads WHERE id NOT IN (SELECT id FROM near)")
def fuzzy_anti_unmatched(spark, d):
    r = reads(spark, d)
    return r.join(fuzzy.near(r, names(spark, d)).select(F.col("r_id").alias("id")), "id", "left_anti").select("id")


@query(f"""WITH {_NEAR}, r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY dist, length(name) DESC) AS k FROM near), b AS (SELECT id, min(name) AS name, min(dist) AS dist, count(*) AS n FROM r WHERE k = 1 GROUP BY id),
  e AS (SELECT id FROM reads WHERE norm IN (SELECT name FROM dict))
SELECT reads.id, CASE WHEN e.id IS NOT NULL THEN norm ELSE b.name END AS matched, (CASE WHEN e.id IS NOT NULL THEN 0 ELSE b.dist END)::INT AS distance, (CASE WHEN e.id IS NOT NULL THEN 1 ELSE b.n END)::INT AS n_best,
  CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'review' ELSE 'none' END AS kind, e.id IS NOT NULL OR coalesce(b.dist >= 1 AND b.n = 1, FALSE) AS auto
FROM reads LEFT JOIN e USING (id) LEFT JOIN b USING (id)""")
def fuzzy_classify_reads(spark, d):
    return fuzzy.classify(reads(spark, d), names(spark, d), "id")


@query("""WITH l AS (SELECT p_partkey AS id, p_name || ' and ' || p_type AS line FROM part), e AS (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '), [p_name, lower(p_type)])) AS entry FROM part),
  h AS (SELECT id, entry FROM l JOIN e ON contains(line, entry))
SELECT id, entry FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = a.id AND b.entry <> a.entry AND contains(b.entry, a.entry))""")
def fuzzy_substring_maximal(spark, d):
    p = table(spark, d, "part")
    lines = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" and "), "p_type").alias("line"))
    e = p.select(F.explode(F.concat(F.split("p_name", " "), F.array("p_name", F.lower("p_type")))).alias("entry")).distinct()
    return fuzzy.maximal_substrings(lines, e, "id", "line", "entry")


@query(f"""WITH {READS}, e AS (SELECT DISTINCT replace(p_name, 'i', 'l') AS wrong, CASE WHEN p_name LIKE 'red%' THEN 'gone' ELSE p_name END AS right_ FROM part WHERE p_name LIKE '%i%')
SELECT id, e.wrong IS NOT NULL AS consumed, dict.name AS corrected FROM reads LEFT JOIN e ON norm = wrong LEFT JOIN dict ON name = right_""")
def fuzzy_errata(spark, d):
    """Listed misreadings; those whose target is no entry are consumed all the same."""
    n = names(spark, d)
    e = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().where("name LIKE '%i%'").select(F.replace("name", F.lit("i"), F.lit("l")).alias("wrong"), F.when(F.col("name").like("red%"), "gone").otherwise(F.col("name")).alias("right"))
    return fuzzy.by_errata(reads(spark, d), e, n).select("id", "consumed", "corrected")


@query(f"""WITH {READS}, n AS (SELECT name AS a FROM dict), p AS (SELECT min(levenshtein(x.a, y.a)) AS m FROM n x JOIN n y ON x.a < y.a)
SELECT least(coalesce(m, 4), 4)::INT AS least, least(1, least(coalesce(m, 4), 4) // 2)::INT AS "limit" FROM p""")
def catalog_min_distance_limit(spark, d):
    return fuzzy.catalog_limit(names(spark, d))


#: The letters in their full-width form, which NFKC takes for the plain ones.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _LETTERS)


@query(f"""WITH p AS (SELECT DISTINCT p_name AS a FROM part), n AS (SELECT a AS name, a FROM p UNION SELECT translate(a, '{_LETTERS}', '{_WIDE}'), a FROM p WHERE a LIKE '%g%'
  UNION SELECT replace(a, ' ', chr(12288)), a FROM p WHERE a LIKE 'h%')
SELECT translate(translate(replace(a, ' ', ''), 'io', '10'), '1eau', 'lccc') AS norm, count(DISTINCT name) AS n FROM n GROUP BY 1 HAVING count(DISTINCT name) > 1""")
def norm_translate_collisions(spark, d):
    """Names, some also in full-width letters or with an ideographic space, that are one under NFKC and two maps."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    wide = n.where("name LIKE '%g%'").select(F.translate("name", _LETTERS, _WIDE).alias("name"))
    spaced = n.where("name LIKE 'h%'").select(F.translate("name", " ", "\u3000").alias("name"))
    norm = X.normalise(F.col("name"), {"i": "1", "o": "0"}, {"1": "l", "e": "c", "a": "c", "u": "c"})
    return catalog.collisions(n.union(wide).union(spaced), "name", norm)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, replace(p_name, ' ', '') AS before, translate(replace(p_name, ' ', ''), 'hotnewldr', 'ooooooooo') AS norm FROM part)
SELECT norm, count(DISTINCT name) AS n FROM n GROUP BY norm HAVING count(DISTINCT before) > 1""")
def collision_introduced_by_map(spark, d):
    """Names that differ without their spaces and are the same under one more map."""
    plain = F.replace("name", F.lit(" "), F.lit(""))
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return catalog.collisions(n, "name", F.translate(plain, "hotnewldr", "ooooooooo"), plain)


@query("SELECT n_name AS name FROM nation WHERE contains(n_name, '_1') EXCEPT SELECT n_name FROM nation WHERE ends_with(n_name, '_1')")
def name_search_only_normalised(spark, d):
    """Names that a search finds in part but not in full."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return n.where(X.contains_kana_blind(F.col("name"), F.lit("_1"))).join(n.where(F.endswith(F.col("name"), F.lit("_1"))), "name", "left_anti")


# Consensus

_OBS = "o AS (SELECT l_partkey AS k, CASE WHEN l_linenumber = 4 THEN NULL ELSE (l_quantity::INT % 4) END AS v, l_returnflag = 'A' AS good FROM lineitem)"


@query(f"""WITH {_OBS}, n AS (SELECT k, v, count(*) AS n, count(*) FILTER (good) AS g FROM o WHERE v > 0 GROUP BY k, v), u AS (SELECT k, v, CASE WHEN sum(g) OVER (PARTITION BY k) > 0 THEN g ELSE n END AS votes FROM n)
SELECT k, v, votes FROM u WHERE votes > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY votes DESC, v) = 1""")
def consensus_mode_smallest(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("int") % 4).alias("v"), (F.col("l_returnflag") == "A").alias("good"))
    return consensus.smallest_mode(o, "k", "v", "good")


_VOTES = """v AS (SELECT user_id AS r, CASE WHEN event_type <> 'error' THEN event_type END AS c, value > 20 AS e FROM events),
  n AS (SELECT r, c, count(*) AS votes, count(*) FILTER (e) AS exact FROM v GROUP BY r, c),
  t AS (SELECT r, c AS top, votes, exact, sum(votes) OVER (PARTITION BY r)::BIGINT AS reads, row_number() OVER w AS k, lead(votes) OVER w AS nv, lead(exact) OVER w AS ne, lead(c) OVER w AS nc
    FROM n WINDOW w AS (PARTITION BY r ORDER BY c IS NULL, votes DESC, exact DESC, c)),
  tally AS (SELECT r, top, CASE WHEN top IS NULL THEN 0 ELSE votes END AS votes, CASE WHEN top IS NULL THEN 0 ELSE exact END AS exact_votes, reads, CASE WHEN top IS NULL THEN 0.0 ELSE votes / reads END AS share,
    top IS NOT NULL AND nc IS NOT NULL AND votes = nv AND exact = ne AS tied FROM t WHERE k = 1)"""


def _tally(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("r"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("c"), (F.col("value") > 20).alias("e"))
    return consensus.vote_tally(e, "r", "c", "e")


@query(f"WITH {_VOTES} SELECT r, top, votes, exact_votes, reads, round(share, 6) AS share, tied FROM tally")
def vote_tally(spark, d):
    return _tally(spark, d).withColumn("share", F.round("share", 6))


@query(f"WITH {_VOTES} SELECT r, top FROM tally WHERE top IS NOT NULL AND NOT tied AND exact_votes > 0 AND share >= 0.25")
def vote_tally_decision(spark, d):
    return consensus.decided(_tally(spark, d), 0.25).select("r", "top")


@query(f"WITH {_VOTES} SELECT least(9, floor(share * 10 / 1.0001))::INT AS bin, count(*) AS n FROM tally GROUP BY 1")
def histogram_share(spark, d):
    return consensus.histogram10(_tally(spark, d), "share")


@query(f"""WITH {_VOTES}, s AS (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4]) AS threshold)
SELECT threshold::DOUBLE AS threshold, count(*) FILTER (share >= threshold) AS decided, count(*) FILTER (share >= threshold AND top <> 'click') AS wrong, count(*) FILTER (share < threshold) AS to_check FROM tally, s GROUP BY threshold""")
def threshold_sweep(spark, d):
    return consensus.sweep(_tally(spark, d).withColumn("right", F.col("top") == "click"), [0.2, 0.25, 0.3, 0.35, 0.4], "share", "right")


@query("""SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND c) AS auto_right, count(*) FILTER (o_orderstatus = 'F' AND NOT c) AS auto_wrong, count(*) FILTER (c IS NULL) AS no_truth
FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 = 0 END AS c FROM orders) GROUP BY 1""")
def accuracy_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("auto"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 3 == 0).alias("correct"))
    return consensus.accuracy(o, "category", "auto", "correct")


@query("""WITH v AS (SELECT l_orderkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'review' ELSE 'none' END AS kind, CASE WHEN l_linenumber % 3 < 2 THEN l_partkey % 2 END AS matched,
    CASE WHEN l_linenumber % 3 < 2 THEN (l_linenumber % 4)::INT END AS distance, l_quantity AS confidence, l_linenumber % 3 = 1 AND l_suppkey % 2 = 0 AS auto FROM lineitem),
  r AS (SELECT *, CASE kind WHEN 'exact' THEN 0.0 WHEN 'review' THEN 1.0 ELSE 2.0 END - CASE WHEN auto THEN 0.5 ELSE 0.0 END AS rk FROM v),
  b AS (SELECT item, kind, matched, distance FROM r QUALIFY row_number() OVER (PARTITION BY item ORDER BY rk, coalesce(distance, 99), confidence DESC, matched NULLS FIRST) = 1),
  s AS (SELECT item, count(DISTINCT CASE WHEN kind = 'exact' OR auto THEN matched END)::INT AS n_sure FROM v GROUP BY item)
SELECT item, CASE WHEN n_sure > 1 THEN 'review' ELSE kind END AS kind, CASE WHEN n_sure <= 1 THEN matched END AS matched, CASE WHEN n_sure <= 1 THEN distance END AS distance, n_sure FROM b JOIN s USING (item)""")
def variant_combine_best(spark, d):
    li, k = table(spark, d, "lineitem"), F.col("l_linenumber") % 3
    v = li.select(
        F.col("l_orderkey").alias("item"), F.when(k == 0, "exact").when(k == 1, "review").otherwise("none").alias("kind"), F.when(k < 2, F.col("l_partkey") % 2).alias("matched"),
        F.when(k < 2, F.col("l_linenumber") % 4).alias("distance"), F.col("l_quantity").alias("confidence"), ((k == 1) & (F.col("l_suppkey") % 2 == 0)).alias("auto"),
    )
    return consensus.combine_variants(v, "item")


@query("SELECT p_name, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1")
def image_union_best_row(spark, d):
    return consensus.best_of_images(table(spark, d, "part").select("p_name", "p_partkey", "p_retailprice"), "p_name", [F.desc("p_retailprice"), "p_partkey"])


@query("""WITH u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [o_custkey % 30, o_custkey % 7] END AS c FROM orders), e AS (SELECT k, unnest(c) AS x FROM u)
SELECT k FROM u WHERE len(c) = 0 UNION ALL SELECT DISTINCT k FROM e WHERE x NOT IN (SELECT n_nationkey FROM nation)""")
def drop_settled_candidates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("o_custkey") % 30, F.col("o_custkey") % 7)).alias("c"))
    return consensus.drop_settled(o, table(spark, d, "nation"), "k", "c", "n_nationkey").select("k")


def _weighted_median(field: str) -> str:
    """The upper median of a field over boxes of weight c.c that are at most 2 from a's."""
    cases = " ".join(f"WHEN coalesce(sum(c.c) FILTER (c.{field} <= a.{field} + ({o})), 0) > sum(c.c) // 2 THEN a.{field} + ({o})" for o in range(-2, 3))
    return f"(CASE {cases} END)::INT AS {field}"


@query(f"""WITH b AS (SELECT l_suppkey % 50 AS s, l_orderkey * 10 + l_linenumber AS k, floor(l_quantity / 10)::INT AS x, (l_discount * 100)::INT AS y, (l_tax * 100)::INT AS w, 10 + l_linenumber % 2 AS h FROM lineitem),
  u AS (SELECT s, x, y, w, h, min(k) AS k, count(*) AS c FROM b GROUP BY ALL),
  g AS (SELECT a.s, a.k, sum(c.c)::BIGINT AS n, {", ".join(_weighted_median(f) for f in "xywh")}
    FROM u a JOIN u c ON a.s = c.s AND abs(a.x - c.x) <= 2 AND abs(a.y - c.y) <= 2 AND abs(a.w - c.w) <= 2 AND abs(a.h - c.h) <= 2 GROUP BY a.s, a.k, a.x, a.y, a.w, a.h),
  t AS (SELECT s, count(*) AS total FROM b GROUP BY s)
SELECT s, x, y, w, h, n, total, n >= 0.6 * total AS ok FROM g JOIN t USING (s) QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, k) = 1""")
def consensus_rect(spark, d):
    li = table(spark, d, "lineitem")
    b = li.select((F.col("l_suppkey") % 50).alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.floor(F.col("l_quantity") / 10).cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("w"), (10 + F.col("l_linenumber") % 2).alias("h"))
    return consensus.consensus_box(b, "s", "k")


@query("""SELECT user_id AS k, list_sort(list(value))[count(*) // 2 + 1] AS upper, round(median(value), 6) AS middle, list_sort(list(value))[round(0.95 * (count(*) - 1))::INT + 1] AS p95 FROM events GROUP BY user_id""")
def two_medians(spark, d):
    """The upper median, the mean-of-two median, and the nearest-rank 95th percentile."""
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.collect_list("value").alias("v"), F.round(F.median("value"), 6).alias("middle"))
    return g.select("k", S.upper_median(F.col("v")).alias("upper"), "middle", S.nearest_rank(F.col("v"), 0.95).alias("p95"))


# Error analytics


@query("""WITH q AS (SELECT p_partkey AS k, p_name AS t, translate(p_name, 'oel', '0c1') AS s, CASE WHEN p_partkey % 5 = 3 AND right(p_name, 1) IN ('o', 'e', 'l') THEN 0 ELSE p_partkey % 5 END AS m, CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS c FROM part),
  r AS (SELECT k, t, s, m, c, CASE m WHEN 3 THEN s || '#' WHEN 4 THEN substr(s, 2) ELSE s END AS x FROM q),
  f AS (SELECT * FROM r WHERE levenshtein(x, t) <= greatest(1, round(length(t) * 0.4))),
  e AS (SELECT 'sub' AS op, substr(s, i::INT, 1) AS a, substr(t, i::INT, 1) AS b, c, k::VARCHAR AS k FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM f)
      WHERE substr(t, i::INT, 1) <> substr(s, i::INT, 1) AND (m <> 4 OR i > 1)
    UNION ALL SELECT 'ins', '#', '', c, k::VARCHAR FROM f WHERE m = 3 UNION ALL SELECT 'del', '', substr(t, 1, 1), c, k::VARCHAR FROM f WHERE m = 4)
SELECT op, a, b, c AS condition, count(*) AS n, count(DISTINCT k) AS n_keys, list_sort(list(DISTINCT k))[1:4] AS examples FROM e GROUP BY GROUPING SETS ((op, a, b), (op, a, b, c))""")
def confusion_tally(spark, d):
    """Reads with substitutions, some with a mark too many or without their first letter."""
    s, m = F.translate("p_name", "oel", "0c1"), F.col("p_partkey") % 5
    x = F.when((m == 3) & ~F.rlike("p_name", F.lit("[oel]$")), F.concat(s, F.lit("#"))).when(m == 4, F.substr(s, F.lit(2))).otherwise(s)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"), x.alias("x"), F.when(F.col("p_partkey") % 2 == 0, "high").otherwise("low").alias("c"))
    return analytics.confusion_tally(p, "x", "t", "k", "c")


@query("""WITH b AS (SELECT p_partkey AS k, p_name AS t, translate(p_name, 'oe', '0c') AS x FROM part), m AS (SELECT k, t, CASE WHEN x IN (SELECT p_name FROM part) THEN x END AS before,
  CASE WHEN x LIKE '%0%' THEN CASE WHEN replace(x, '0', 'o') IN (SELECT p_name FROM part) THEN replace(x, '0', 'o') END WHEN x IN (SELECT p_name FROM part) THEN x END AS after FROM b)
SELECT count(*) FILTER (before IS DISTINCT FROM t AND after = t) AS improved, count(*) FILTER (before = t AND after IS DISTINCT FROM t) AS worsened, count(*) FILTER (before IS DISTINCT FROM after) AS moved,
  count(*) FILTER (before <> t) AS wrong_before, count(*) FILTER (after <> t) AS wrong_after, count(*) FILTER (after <> t) <= count(*) FILTER (before <> t) AS adopt FROM m""")
def replay_delta_metrics(spark, d):
    """What one more confusion in the map would change; only texts with that character are matched again."""
    n = names(spark, d)
    exact = lambda t: t.join(n.select("norm", F.col("name").alias("matched")), "norm", "left").select("id", "matched")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("t"), F.translate("p_name", "oe", "0c").alias("x"))
    got = analytics.replay(rows, "k", "x", "t", exact, "0", F.col("id"), F.translate("id", "0", "o"))
    return analytics.replay_metrics(got, "t")


_SETS = """f AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 47), t AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 4), m AS (SELECT p_partkey AS k FROM part), u AS (SELECT p_partkey AS k FROM part WHERE p_size = 1)"""


@query(f"""WITH {_SETS}, c AS (SELECT (SELECT count(*) FROM f WHERE k IN (SELECT k FROM t)) AS covered, (SELECT count(*) FROM t WHERE k NOT IN (SELECT k FROM f)) AS missing, (SELECT count(*) FROM f WHERE k NOT IN (SELECT k FROM t)) AS outside,
  (SELECT count(*) FROM m WHERE k NOT IN (SELECT k FROM u)) AS reachable, (SELECT count(*) FROM m) AS total)
SELECT *, covered / reachable AS ratio_reachable, covered / total AS ratio_total FROM c""")
def coverage_report_sets(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    at = lambda c: li.where(c).select(F.col("l_partkey").alias("k"))
    return analytics.coverage_report(at("l_quantity > 47"), at("l_quantity < 4"), p, p.where("p_size = 1"), "k")


@query("""WITH x AS (SELECT DISTINCT l_partkey AS k, l_returnflag || l_linestatus AS c FROM lineitem), n AS (SELECT k, count(DISTINCT c) AS n, min(c) AS c FROM x GROUP BY k)
SELECT k, 'all' AS c FROM n WHERE n = (SELECT count(DISTINCT c) FROM x) UNION ALL SELECT k, c FROM n WHERE n = 1""")
def common_and_only_in_condition(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.concat("l_returnflag", "l_linestatus").alias("c"))
    return analytics.common_keys(x, "k", "c").withColumn("c", F.lit("all")).unionByName(analytics.only_in(x, "k", "c"))


@query("""SELECT user_id AS k, CASE WHEN count(*) % 11 = 0 THEN 'conflict' WHEN count(*) % 7 = 0 THEN 'already' WHEN count(*) % 5 = 0 THEN 'collision' WHEN sum(event_id) % 13 = 0 THEN 'new error'
  WHEN count(*) FILTER (value > 30) > 0 AND count(*) FILTER (value < 1) = 0 THEN 'improves' WHEN count(*) FILTER (value > 30) > 0 THEN 'partly worse' ELSE 'none' END AS verdict FROM events GROUP BY 1""")
def candidate_verdict(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"), F.count_if(F.col("value") > 30).alias("up"), F.count_if(F.col("value") < 1).alias("down"))
    n = F.col("n")
    return g.select("k", analytics.verdict(n % 11 == 0, n % 7 == 0, n % 5 == 0, F.col("s") % 13 == 0, F.col("up"), F.col("down")).alias("verdict"))


@query("""SELECT a, b, max(n) AS n FROM (SELECT p_type AS a, p_brand AS b, p_size % 2 AS r, count(*) AS n FROM part GROUP BY ALL) GROUP BY a, b HAVING max(n) >= 3""")
def merge_candidate_reports(spark, d):
    r = table(spark, d, "part").groupBy(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), (F.col("p_size") % 2).alias("r")).agg(F.count("*").alias("n"))
    return analytics.merge_reports(r, ["a", "b"], "n", 3)


@query("""WITH n AS (SELECT p_size AS k, substr(p_brand, 7, 1) AS l, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS total FROM n)
SELECT k, coalesce(string_agg(CASE WHEN n >= 2 OR n * 10 >= total OR total <= 3 THEN l END, '' ORDER BY l), '*') AS marks FROM t GROUP BY k""")
def label_marks(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("k"), F.substring("p_brand", 7, 1).alias("l"))
    return analytics.marks(p, "k", "l")


@query("""SELECT p_partkey AS k, CASE WHEN contains(p_name, 'hot') THEN ['H'] WHEN contains(p_name, 'red') OR contains(p_name, 'ring') THEN list_filter([CASE WHEN contains(p_name, 'red') THEN 'R' END, CASE WHEN contains(p_name, 'ring') THEN 'G' END], lambda x: x IS NOT NULL)
  WHEN contains(p_name, 'bolt') THEN ['B'] ELSE ['?'] END AS labels FROM part""")
def label_classes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), analytics.labels(F.col("p_name"), "hot", {"R": "red", "G": "ring"}, {"B": "bolt"}).alias("labels"))


# Frames


@query("""SELECT user_id AS who, time_bucket(INTERVAL 6 HOUR, ts) AS slot, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL""")
def frames_tumbling_first(spark, d):
    f = O.first_per_slot(frames(spark, d).select("who", "ts", "event_id"), "who", "ts", "6 hours", ["ts", "event_id"])
    return f.select("who", "slot", "event_id")


_POS = "p AS (SELECT user_id AS who, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def _numbered(spark, d):
    return frames(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("who").orderBy("ts", "event_id")))


@query(f"""WITH {_POS}, h AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY who ORDER BY pos) > 2 OR lag(pos) OVER (PARTITION BY who ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS new FROM p WHERE value > 8),
  g AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY pos) AS run FROM h)
SELECT who, min(pos)::INT AS a, max(pos)::INT AS b, count(*) AS n FROM g GROUP BY who, run""")
def frames_gap_islands(spark, d):
    return O.runs(_numbered(spark, d), ["who"], "pos", F.col("value") > 8, gap=1)


@query(f"""WITH {_POS}, h AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 1 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM p WHERE value > 8 WINDOW w AS (PARTITION BY who ORDER BY pos)),
  g AS (SELECT who, min(pos)::INT AS a, max(pos)::INT AS b FROM (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY pos) AS run FROM h) GROUP BY who, run)
SELECT who, a, b FROM g QUALIFY row_number() OVER (PARTITION BY who ORDER BY b - a DESC, a) = 1""")
def frames_longest_run(spark, d):
    return O.longest_run(O.runs(_numbered(spark, d), ["who"], "pos", F.col("value") > 8), "who")


@query(f"""WITH {_POS}, m AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) < 6 THEN 0 ELSE 1 END AS mv FROM p WINDOW w AS (PARTITION BY who ORDER BY pos)), s AS (SELECT *, sum(mv) OVER (PARTITION BY who ORDER BY pos) AS seg FROM m)
SELECT who, min(pos)::INT AS start, max(pos)::INT AS "end", count(*) AS n FROM s GROUP BY who, seg HAVING count(*) >= 2""")
def frames_still_segments(spark, d):
    return O.still_segments(_numbered(spark, d), "who", "pos", "value", 6)


@query(f"WITH {_POS} SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE round(value * 100)::BIGINT END) OVER (PARTITION BY who ORDER BY pos)::BIGINT AS position FROM p")
def frames_cumulative_position(spark, d):
    f = _numbered(spark, d).withColumn("shift", F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long")))
    return O.positions(f, "who", ["pos"], "shift").select("event_id", "position")


@query(f"""WITH {_POS}, b AS (SELECT who, pos AS "at", value AS best FROM p QUALIFY row_number() OVER (PARTITION BY who ORDER BY value, pos) = 1)
SELECT who, "at"::INT AS "at", best, min(CASE WHEN abs(pos - "at") > 40 THEN value END) AS rival FROM p JOIN b USING (who) GROUP BY who, "at", best""")
def frames_argmin_second_best(spark, d):
    return O.best_and_rival(_numbered(spark, d), "who", "pos", "value")


@query(f"WITH {_POS} SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY pos)::BIGINT AS segment FROM p")
def frames_anchor_segments(spark, d):
    return O.anchor_segments(_numbered(spark, d), "who", ["pos"], F.col("event_type") == "signup").select("event_id", "segment")


@query(f"WITH {_POS}, b AS (SELECT *, max(CASE WHEN value < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY who ORDER BY pos) AS bad FROM p) SELECT event_id FROM b WHERE bad = 0")
def frames_take_while(spark, d):
    return O.take_while(_numbered(spark, d), "who", ["pos"], F.col("value") < 40).select("event_id")


@query(f"WITH {_POS} SELECT event_id, min(value) OVER (PARTITION BY who ORDER BY pos) AS low FROM p")
def frames_prefix_min(spark, d):
    return O.prefix_min(_numbered(spark, d), "who", ["pos"], "value").select("event_id", "low")


@query(f"""WITH {_POS}, g AS (SELECT event_id, who, epoch_us(lead(ts) OVER (PARTITION BY who ORDER BY pos)) // 1000000 - epoch_us(ts) // 1000000 AS g FROM p), m AS (SELECT who, median(g) AS mid FROM g GROUP BY who)
SELECT event_id, coalesce(g, mid)::DOUBLE AS gap FROM g JOIN m USING (who)""")
def frames_next_gap(spark, d):
    f = _numbered(spark, d).withColumn("sec", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
    return O.next_gap(f, "who", ["pos"], "sec").select("event_id", F.col("gap").cast("double").alias("gap"))


@query("""WITH l AS (SELECT user_id AS u, event_id AS k, epoch_us(ts) AS x FROM events WHERE event_type = 'click'), r AS (SELECT user_id AS u, event_id AS t, epoch_us(ts) AS y FROM events WHERE event_type = 'purchase')
SELECT u, k, t, abs(x - y) AS distance FROM l JOIN r USING (u) QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(x - y), t) = 1""")
def nearest_placement_join(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("u"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("x"))
    left = e.where("event_type = 'click'").withColumnRenamed("event_id", "k")
    return O.nearest(left, e.where("event_type = 'purchase'").withColumnRenamed("event_id", "t"), "u", "x", "x", "k", "t")


@query("""WITH i AS (SELECT user_id AS u, event_id AS k, event_type AS t, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + (value * 600)::BIGINT AS b FROM events)
SELECT l.u, l.k AS lk, r.k AS rk FROM i l JOIN i r ON l.u = r.u AND l.t = 'click' AND r.t = 'purchase' AND l.a <= r.b AND r.a <= l.b""")
def range_overlap_join(spark, d):
    e, at = table(spark, d, "events"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    i = e.select(F.col("user_id").alias("u"), F.col("event_id").alias("k"), "event_type", at.alias("a"), (at + F.round(F.col("value") * 600).cast("long")).alias("b"))
    return O.overlapping(i.where("event_type = 'click'"), i.where("event_type = 'purchase'"), "u", 20_000)


@query("""WITH i AS (SELECT user_id AS u, event_id AS k, event_type AS t, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 60 AS b FROM events)
SELECT l.u, l.k AS lk, r.k AS rk FROM i l JOIN i r ON l.u = r.u AND l.t = 'view' AND r.t = 'purchase' AND r.a >= l.b AND r.a - l.b <= 40000 QUALIFY row_number() OVER (PARTITION BY l.k ORDER BY r.a) = 1""")
def adjacency_next_start(spark, d):
    e, at = table(spark, d, "events"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    i = e.select(F.col("user_id").alias("u"), F.col("event_id").alias("k"), "event_type", at.alias("a"), (at + 60).alias("b"))
    return O.next_start(i.where("event_type = 'view'"), i.where("event_type = 'purchase'"), "u", 40_000).select("u", "lk", "rk")


@query("""WITH v AS (SELECT user_id AS who, round(value * 10)::BIGINT AS x FROM events), n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY who ORDER BY x) <= 5 THEN 0 ELSE 1 END AS new FROM v),
  c AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT who, min(x) AS low, max(x) AS high, count(*) AS n FROM c GROUP BY who, k HAVING count(*) >= 3""")
def cluster_1d_gap(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("who"), F.round(F.col("value") * 10).cast("long").alias("x"))
    return O.clusters(v, "who", "x", 5)


@query()
def frames_anchored_groups(spark, d):
    """Groups that stay near their first frame: a fold, held against a plain loop in the tests."""
    return O.anchored_groups(_numbered(spark, d), "who", "pos", "value", 15.0)


@query(f"WITH {_POS} SELECT who, (pos // 10)::INT AS g, max_by(event_id, (event_type <> 'error', value, -pos)) AS event_id FROM p GROUP BY ALL")
def frames_best_of_group(spark, d):
    f = _numbered(spark, d).withColumn("g", F.expr("cast(pos div 10 as int)"))
    return O.best_of_group(f.select("who", "g", "event_id", "event_type", "value", "pos"), ["who", "g"], F.col("event_type") != "error", "value", "pos").select("who", "g", "event_id")


@query("WITH i AS (SELECT p_partkey AS k, p_size AS a, p_size + p_partkey % 9 AS b FROM part) SELECT k, a, least(b, 30) AS b FROM i WHERE a < 30")
def interval_clipping(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"), (F.col("p_size") + F.col("p_partkey") % 9).alias("b"))
    return O.clip(p, 30)


# Operations


@query()
def lpt_shard_plan(spark, d):
    """Each nation's customers as jobs on four shards, held against a plain version in the tests."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("plan"), F.col("c_custkey").alias("no"), F.when(F.col("c_custkey") % 9 != 0, F.abs("c_acctbal")).alias("sec"))
    return ops.shard_plan(c, "plan", 4)


@query("""WITH t AS (SELECT l_partkey % 300 AS title, sum(l_quantity) AS sec FROM lineitem GROUP BY 1) SELECT title, sec, round(100 * sec / (SELECT sum(sec) FROM t), 1) AS percent FROM t ORDER BY sec DESC, title LIMIT 20""")
def timing_top20_share(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("title"), "l_quantity")
    return ops.timing_shares(li, "title", "l_quantity")


@query(r"""WITH d AS (SELECT doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'p' || page_id, url || ' C:\Users\u' || page_id || '\x GOLD_G:\ d:\ /home/' || page_id FROM pages),
  s AS (SELECT id, string_split(text, '@') AS parts FROM d WHERE contains(text, '@')),
  m AS (SELECT id, unnest(list_zip(parts[:-2], parts[2:])) AS p FROM s),
  n AS (SELECT id, regexp_extract(p[1], '[0-9A-Za-z_%+.-]*$') AS name, string_split(rtrim(regexp_extract(p[2], '^[0-9A-Za-z.-]*'), '.-'), '.') AS labels FROM m),
  e AS (SELECT id, list_last(string_split(name, '..')) AS name, labels FROM n),
  h AS (SELECT id, 'email' AS kind, ltrim(name, '.') || '@' || array_to_string(labels, '.') AS found FROM e
    WHERE ltrim(name, '.') <> '' AND name NOT LIKE '%.' AND len(labels) >= 2 AND len(list_filter(labels, lambda x: x = '' OR x LIKE '-%' OR x LIKE '%-')) = 0
      AND length(list_last(labels)) >= 2 AND translate(lower(list_last(labels)), 'abcdefghijklmnopqrstuvwxyz', '') = ''
  UNION ALL SELECT id, 'path', unnest(regexp_extract_all(text, '(?:/Users/|/home/|\\Users\\)[A-Za-z0-9_.-]*')) FROM d
  UNION ALL SELECT id, 'drive', unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Za-z]:\\)', 1)) FROM d)
SELECT DISTINCT id, kind, found FROM h""")
def pii_scan(spark, d):
    """Texts, and a line made of every page, in which a drive letter inside a name is none."""
    line = F.concat("url", F.lit(" C:\\Users\\u"), "page_id", F.lit("\\x GOLD_G:\\ d:\\ /home/"), "page_id")
    lines = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), line.alias("text"))
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return ops.personal_data(texts.union(lines), "id", "text")


@query("""WITH t AS (SELECT DISTINCT p_partkey AS k, unnest(string_split(p_name, ' ')) AS term FROM part), f AS (SELECT term, count(*) AS df FROM t WHERE term IN ('red', 'ring', 'bolt', 'cold') GROUP BY term HAVING count(*) <= 260)
SELECT k, round(sum(1 / df), 9) AS score FROM t JOIN f USING (term) GROUP BY k""")
def idf_selective_terms(spark, d):
    want = spark.createDataFrame([("red",), ("ring",), ("bolt",), ("cold",)], "term string")
    got = ops.selective_terms(table(spark, d, "part"), "p_partkey", F.split("p_name", " "), want, 260)
    return got.select(F.col("p_partkey").alias("k"), F.round("score", 9).alias("score"))


@query("""WITH t AS (SELECT s_suppkey AS no, abs(s_acctbal) AS sec FROM supplier WHERE s_suppkey % 4 <> 0) SELECT c_custkey % 5 AS shard, round(sum(coalesce(sec, (SELECT median(sec) FROM t))), 4) AS sec FROM customer LEFT JOIN t ON no = c_custkey GROUP BY 1""")
def shard_estimate(spark, d):
    t = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("no"), F.abs("s_acctbal").alias("sec"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("no"), (F.col("c_custkey") % 5).alias("shard"))
    return ops.estimate(jobs, t, "shard").withColumn("sec", F.round("sec", 4))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def recent_history(spark, d):
    return ops.recent(table(spark, d, "events"), "user_id", [F.desc("ts"), "event_id"]).select("user_id", "event_id")


@query("""WITH f AS (SELECT *, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS u FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT user_id, event_id FROM f WHERE u = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def newest_if_any_unseen(spark, d):
    e = table(spark, d, "events").withColumn("seen", F.col("value") <= 60)
    return ops.newest_if_unseen(e, "user_id", "ts", F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), "seen").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice)::INT AS nth FROM lineitem")
def occurrence_ordinals(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    return ops.ordinals(li, ["l_orderkey", "l_returnflag"], "o").select("l_orderkey", "l_linenumber", "nth")


@query("SELECT coalesce(p_partkey, k) AS p_partkey, coalesce(v, p_name) AS value, CASE WHEN k IS NULL THEN 'auto' ELSE 'manual' END AS origin FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) FULL JOIN (SELECT s_suppkey * 2 AS k, s_name AS v FROM supplier) ON k = p_partkey")
def override_precedence(spark, d):
    auto = table(spark, d, "part").where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_name").alias("value"))
    return ops.overridden(auto, table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("p_partkey"), F.col("s_name").alias("value")), "p_partkey", "value")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2")
def negative_offset_slice(spark, d):
    return ops.last_rows(table(spark, d, "orders"), "o_custkey", "o_orderkey", 2).select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT p_brand, p_type FROM part), b AS (SELECT p_brand, CASE WHEN p_size = 7 THEN lower(p_type) ELSE p_type END AS p_type FROM part)
(SELECT p_brand, p_type, 'a' AS side FROM (FROM a EXCEPT ALL FROM b)) UNION ALL (SELECT p_brand, p_type, 'b' FROM (FROM b EXCEPT ALL FROM a))""")
def version_parity(spark, d):
    """The whole table against a version of it in which some types were changed."""
    p = table(spark, d, "part")
    changed = F.when(F.col("p_size") == 7, F.lower("p_type")).otherwise(F.col("p_type"))
    return ops.parity(p.select("p_brand", "p_type"), p.select("p_brand", changed.alias("p_type")))


@query("""SELECT event_id, floor((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 86400000)::BIGINT AS days, floor((epoch_ms(ts) + 32400000) / 86400000)::BIGINT AS day,
  floor((epoch_ms(TIMESTAMP '2024-01-31') + 32400000) / 86400000) - floor((epoch_ms(ts) + 32400000) / 86400000) <= 10 AS fresh FROM events""")
def day_numbers(spark, d):
    """Whole days since, the day number nine hours ahead of UTC, and freshness."""
    now, ts = F.lit("2024-01-31").cast("timestamp"), F.col("ts")
    return table(spark, d, "events").select("event_id", S.days_since(ts, now).alias("days"), S.zone_day(ts).alias("day"), S.fresh(ts, now, 10).alias("fresh"))


@query("""SELECT doc_id, length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'))::INT AS n FROM documents""")
def html_escape_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.html_escape(F.col("text"))).alias("n"))


# Kernels on arrays

_PLANE = "SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings"


@query(f"""WITH c AS ({_PLANE}), p AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, v::DOUBLE AS v FROM c),
  l AS (SELECT a.vec_id, sum(b.v) - 4 * any_value(a.v) AS l FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY a.vec_id, a.x, a.y)
SELECT vec_id, round(var_pop(l), 6) AS sharpness FROM l GROUP BY vec_id""")
def laplacian_variance(spark, d):
    """Sharpness of each embedding taken as an 8 x 8 image."""
    return table(spark, d, "embeddings").select("vec_id", kernels.plane_stats(F.col("embedding"), 8).alias("s")).select("vec_id", F.round("s.sharpness", 6).alias("sharpness"))


@query(f"""WITH c AS ({_PLANE}), p AS (SELECT vec_id, (i // 8)::INT AS y, (i % 8)::INT AS x, v::DOUBLE AS v FROM c),
  m AS (SELECT a.vec_id, a.y, a.x, any_value(a.v) <= avg(b.v) AS dark FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.y, a.x),
  r AS (SELECT vec_id, y, count(*) FILTER (dark) AS n FROM m GROUP BY vec_id, y), g AS (SELECT *, n >= 4 AND NOT coalesce(lag(n) OVER (PARTITION BY vec_id ORDER BY y) >= 4, FALSE) AS first FROM r)
SELECT vec_id, sum(n)::INT AS dark, count(*) FILTER (first)::INT AS runs FROM g GROUP BY vec_id""")
def integral_threshold_runs(spark, d):
    """Adaptive threshold by an integral image, and the runs of its row profile."""
    return table(spark, d, "embeddings").select("vec_id", kernels.plane_stats(F.col("embedding"), 8).alias("s")).select("vec_id", "s.dark", "s.runs")


@query("""WITH q AS (SELECT p_partkey AS k, 300 + p_size * 10 AS w, p_retailprice / 10 AS s, p_type = 'PROMO' AS e FROM part)
SELECT k, list_filter([CASE WHEN w < 400 THEN 'too narrow' END, CASE WHEN w >= 400 AND w < 700 THEN 'narrow' END, CASE WHEN s < 120 AND NOT e THEN 'blurred' END], lambda x: x IS NOT NULL) AS problems FROM q""")
def quality_gate(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (300 + F.col("p_size") * 10).alias("w"), (F.col("p_retailprice") / 10).alias("s"), "p_type")
    return kernels.quality_gate(p, "w", "s", F.col("p_type") == "PROMO").select("k", "problems")
