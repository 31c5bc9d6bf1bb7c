"""Error analytics: confusions, what-if replay, coverage and condition reports."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions.text import close_map, edit_ops


def confusion_tally(pairs: DataFrame, read: str, truth: str, key: str, condition: str | None = None) -> DataFrame:
    """(op, a, b, condition, n, n_keys, examples): edits between reads and truths, in total (condition null) and by condition.

    Pairs further apart than max(1, 0.4 * length of the truth) are no misreadings and left out. Different pairs are
    aligned once each, however often they occur.
    """
    limit = F.greatest(F.lit(1), F.round(F.length(truth) * 0.4))
    use = pairs.where(F.levenshtein(F.col(read), F.col(truth)) <= limit)
    edits = use.select(read, truth).distinct().withColumn("e", F.explode(edit_ops(F.col(read), F.col(truth))))
    each = use.join(edits, [read, truth])
    cond = F.col(condition) if condition else F.lit("all")
    rows = each.select("e.op", "e.a", "e.b", cond.alias("condition"), F.col(key).cast("string").alias("k"))
    out = rows.groupingSets([["op", "a", "b"], ["op", "a", "b", "condition"]], "op", "a", "b", "condition")
    return out.agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"), F.slice(F.array_sort(F.collect_set("k")), 1, 4).alias("examples"))


def common_keys(df: DataFrame, key: str, condition: str) -> DataFrame:
    """Keys found under every condition."""
    total = df.select(F.count_distinct(condition).alias("__all"))
    return df.groupBy(key).agg(F.count_distinct(condition).alias("__n")).join(F.broadcast(total), F.col("__n") == F.col("__all")).select(key)


def only_in(df: DataFrame, key: str, condition: str) -> DataFrame:
    """Keys found under one condition alone, with it."""
    return df.groupBy(key).agg(F.count_distinct(condition).alias("__n"), F.min(condition).alias(condition)).where("__n = 1").select(key, condition)


def coverage_report(found: DataFrame, truth: DataFrame, master: DataFrame, unreachable: DataFrame, key: str) -> DataFrame:
    """(covered, missing, outside, reachable, total, ratio_reachable, ratio_total) of found keys."""
    f, t, m, u = (x.select(key).distinct() for x in (found, truth, master, unreachable))
    flag = lambda df, n: df.withColumn(n, F.lit(1))
    all_ = flag(m, "m").join(flag(f, "f"), key, "full").join(flag(t, "t"), key, "full").join(flag(u, "u"), key, "full")
    r = all_.agg(
        F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("covered"),
        F.count_if(F.col("t").isNotNull() & F.col("f").isNull()).alias("missing"),
        F.count_if(F.col("f").isNotNull() & F.col("t").isNull()).alias("outside"),
        F.count_if(F.col("m").isNotNull() & F.col("u").isNull()).alias("reachable"), F.count("m").alias("total"),
    )
    return r.withColumn("ratio_reachable", F.col("covered") / F.col("reachable")).withColumn("ratio_total", F.col("covered") / F.col("total"))


def replay(rows: DataFrame, key: str, text: str, truth: str, classify, changed: str, base: Column, new: Column) -> DataFrame:
    """(key, truth, before, after): what rows match with and without a change of the normalisation.

    Only different texts that hold a changed character are matched anew, each once; all others keep their match.
    ``classify`` takes (id, norm) rows and gives (id, matched).
    """
    texts = rows.select(F.col(text).alias("id")).distinct()
    touched = texts.where(F.col("id").rlike(f"[{changed}]"))
    before = classify(texts.withColumn("norm", base)).select("id", F.col("matched").alias("before"))
    again = classify(touched.withColumn("norm", new)).select("id", F.col("matched").alias("again"))
    both = before.join(again.withColumn("__t", F.lit(True)), "id", "left")
    both = both.withColumn("after", F.when(F.col("__t"), F.col("again")).otherwise(F.col("before"))).select("id", "before", "after")
    return rows.join(both, F.col(text) == F.col("id"), "left").select(key, truth, "before", "after")


def replay_metrics(replayed: DataFrame, truth: str) -> DataFrame:
    """(improved, worsened, moved, wrong_before, wrong_after, adopt): adopt unless a wrong match was added."""
    right = lambda c: F.coalesce(F.col(c) == F.col(truth), F.lit(False))
    wrong = lambda c: F.coalesce(F.col(c) != F.col(truth), F.lit(False))
    r = replayed.agg(
        F.count_if(~right("before") & right("after")).alias("improved"), F.count_if(right("before") & ~right("after")).alias("worsened"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("moved"),
        F.count_if(wrong("before")).alias("wrong_before"), F.count_if(wrong("after")).alias("wrong_after"),
    )
    return r.withColumn("adopt", F.col("wrong_after") <= F.col("wrong_before"))


def verdict(conflict: Column, already: Column, collides: Column, new_error: Column, improved: Column, worsened: Column) -> Column:
    """The first that holds of: conflict, already, collision, new error, partly worse, improves, none."""
    return (
        F.when(conflict, "conflict").when(already, "already").when(collides, "collision").when(new_error, "new error")
        .when((improved > 0) & (worsened == 0), "improves").when(improved > 0, "partly worse").otherwise("none")
    )


def merge_reports(reports: DataFrame, by: list[str], count: str, least: int) -> DataFrame:
    return reports.groupBy(*by).agg(F.max(count).alias(count)).where(F.col(count) >= least)


#: The tier of candidates that are refused.
REFUSED = 3


def greedy_accept(candidates: DataFrame, names: list[str], by: tuple[str, ...] = ("n",), homoglyphs: Mapping[str, str] | None = None) -> DataFrame:
    """(src, dst, tier): candidate confusions with the tier they end in; REFUSED ones are not to be used.

    ``candidates``: src, dst, tier and the columns ``by``, of which more is better; equals go by src and dst. First, of the
    candidates for one source, only the best outside REFUSED keeps its tier. Then the first tier's are added to one map
    in that order, then the second's on top, and one that makes two of the different ``names`` the same under the map is
    refused. ``names`` is the dictionary that the map is for, and there are no more candidates than pairs of its
    characters; the fold over one ranking is one task's work.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        order = ["tier", *by, "src", "dst"]
        t = t.sort_values(order, ascending=[True, *[False] * len(by), True, True]).reset_index(drop=True)
        tier = t["tier"].tolist()
        best: set = set()
        for i, src in enumerate(t["src"]):
            if tier[i] != REFUSED:
                tier[i] = REFUSED if src in best else tier[i]
                best.add(src)
        held: dict = {}
        for level in (1, 2):
            for i, (src, dst) in enumerate(zip(t["src"], t["dst"])):
                if tier[i] == level:
                    table = str.maketrans(close_map({**held, src: dst}, homoglyphs or {}))
                    if len({n.translate(table) for n in names}) < len(names):
                        tier[i] = REFUSED
                    else:
                        held[src] = dst
        return pd.DataFrame({"src": t["src"], "dst": t["dst"], "tier": tier})

    names = sorted(set(names))
    return candidates.groupBy(F.lit(0).alias("__all")).applyInPandas(run, "src string, dst string, tier int")


def labels(text: Column, stop: str, patterns: Mapping[str, str], codes: Mapping[str, str]) -> Column:
    """The labels whose pattern a text fits; ``H`` alone if it fits ``stop``, the code patterns if none, else ``?``."""
    which = lambda p: F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(x)), F.lit(n)) for n, x in p.items())))
    first, second = which(patterns), which(codes)
    return F.when(F.rlike(text, F.lit(stop)), F.array(F.lit("H"))).when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(F.array(F.lit("?")))


def marks(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, marks): labels seen twice or more, or in a tenth of the rows, or at all where there are three rows at most; else ``*``."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    keep = (F.col("n") >= 2) | (F.col("n") * 10 >= F.col("total")) | (F.col("total") <= 3)
    got = n.groupBy(by).agg(F.array_sort(F.collect_list(F.when(keep, F.col(label)))).alias("m"))
    return got.select(by, F.when(F.size("m") > 0, F.array_join("m", "")).otherwise("*").alias("marks"))
