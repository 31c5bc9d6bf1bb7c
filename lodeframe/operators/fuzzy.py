"""Dictionary matching of noisy text: exact, by corrections, by containment, by edit distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions.text import allowed_distance

#: A read below this confidence takes no part in fuzzy matching.
LOW_CONFIDENCE = 55
MOST = 3


def dictionary(names: DataFrame, name: str = "name", norm: str = "norm", order: str = "pos") -> DataFrame:
    """Entries without empty names; of those that normalise alike the first stays, so that no tie is made of copies."""
    first = F.row_number().over(Window.partitionBy(norm).orderBy(order))
    return names.where(F.trim(F.col(name)) != "").where(F.col(norm) != "").withColumn("__k", first).where("__k = 1").drop("__k")


def _pieces(text: Column, length: Column, parts: Column) -> Column:
    """``parts`` pieces that make up the text, as (number, start, piece)."""
    size = F.floor(length / parts).cast("int")

    def piece(i: Column) -> Column:
        begin = i * size
        end = F.when(i == parts - 1, length).otherwise(begin + size)
        return F.struct(i.alias("no"), begin.alias("at"), F.substring(text, begin + 1, end - begin).alias("piece"))

    return F.transform(F.sequence(F.lit(0), parts - 1), piece)


def near(reads: DataFrame, entries: DataFrame, read: str = "norm", entry: str = "norm", limit=allowed_distance) -> DataFrame:
    """(every column of both, prefixed r_ and e_, and ``distance``) for reads within the entry's allowed distance.

    Distance at most k leaves one of k + 1 pieces of the entry untouched, at most k places away; so pieces are joined on
    equality instead of all pairs, and only candidates that share a piece and nearly the length are measured. ``limit``
    may be any function of the length.
    """
    r = reads.select(*(F.col(c).alias(f"r_{c}") for c in reads.columns))
    e = entries.select(*(F.col(c).alias(f"e_{c}") for c in entries.columns))
    rn, en = F.col(f"r_{read}"), F.col(f"e_{entry}")
    size = F.length(en)
    e = e.withColumn("__limit", limit(size).cast("int"))
    words = r.select(rn.alias("__word")).distinct()
    # An entry no longer than its limit has no piece that must be left; it is held against all words short enough.
    short = e.where(size <= F.col("__limit")).withColumn("__n", F.explode(F.sequence(F.lit(0), size + F.col("__limit"))))
    brief = words.join(short, F.length("__word") == F.col("__n"))
    e = e.where(size > F.col("__limit")).withColumn("__p", F.explode(_pieces(en, size, F.col("__limit") + 1)))
    e = e.withColumn("__size", F.length("__p.piece"))
    lengths = e.select("__size").distinct()
    spots = words.join(F.broadcast(lengths), F.length("__word") >= F.col("__size")).withColumn(
        "__at", F.explode(F.sequence(F.lit(0), F.length("__word") - F.col("__size")))
    )
    spots = spots.withColumn("__piece", F.expr("substring(__word, __at + 1, __size)"))
    hit = (F.col("__piece") == F.col("__p.piece")) & (F.abs(F.col("__at") - F.col("__p.at")) <= F.col("__limit"))
    hit &= F.abs(F.length("__word") - size) <= F.col("__limit")
    kept = ["__word", "__limit", *(c for c in e.columns if c.startswith("e_"))]
    pairs = spots.join(e, hit).select(*kept).union(brief.select(*kept)).distinct()
    pairs = pairs.withColumn("distance", F.levenshtein(F.col("__word"), en)).where("distance <= __limit").drop("__limit")
    return r.join(pairs, rn == F.col("__word")).drop("__word")


def best_candidates(found: DataFrame, read_key: str, entry_name: str) -> DataFrame:
    """Of each read's candidates the nearest, then longest; ``tied`` tells that others are as good, ``n_best`` how many."""
    order = Window.partitionBy(read_key).orderBy("distance", F.desc(F.length(entry_name)))
    ranked = found.withColumn("__rank", F.rank().over(order)).where("__rank = 1")
    whole = Window.partitionBy(read_key)
    first = F.row_number().over(Window.partitionBy(read_key).orderBy(entry_name))
    return (
        ranked.withColumn("n_best", F.count("*").over(whole).cast("int")).withColumn("__k", first).where("__k = 1")
        .withColumn("tied", F.col("n_best") > 1).drop("__k", "__rank")
    )


def maximal_substrings(lines: DataFrame, entries: DataFrame, line_key: str, line: str, entry: str) -> DataFrame:
    """(line_key, entry) of all entries that a line contains, without those strictly inside another hit of that line."""
    e = entries.select(F.col(entry).alias("entry")).where("entry <> ''").distinct()
    hits = lines.select(line_key, line).join(F.broadcast(e), F.contains(F.col(line), F.col("entry"))).select(line_key, "entry").distinct()
    all_hits = hits.groupBy(line_key).agg(F.collect_set("entry").alias("others"))
    inside = F.exists("others", lambda o: (o != F.col("entry")) & F.contains(o, F.col("entry")))
    return hits.join(all_hits, line_key).where(~inside).select(line_key, "entry")


def by_errata(lines: DataFrame, errata: DataFrame, entries: DataFrame, norm: str = "norm") -> DataFrame:
    """Lines with ``corrected``, the target of a listed misreading, and ``consumed``.

    A line on the list is consumed even where its target is not in the dictionary; then nothing is matched.
    """
    known = entries.select(F.col(norm).alias("__known")).distinct()
    e = errata.select(F.col("wrong").alias("__wrong"), F.col("right").alias("__right"))
    out = lines.join(F.broadcast(e), F.col(norm) == F.col("__wrong"), "left").join(F.broadcast(known), F.col("__right") == F.col("__known"), "left")
    return out.withColumn("consumed", F.col("__wrong").isNotNull()).withColumn("corrected", F.col("__known")).drop("__wrong", "__right", "__known")


def classify(reads: DataFrame, entries: DataFrame, key: str, norm: str = "norm", name: str = "name", confidence: str | None = None) -> DataFrame:
    """One row per read: ``kind`` exact, review or none, ``matched``, ``distance``, ``n_best`` and ``auto``.

    Reads that are no entry are matched by distance; a unique nearest entry is accepted on its own, a tie is left for
    review. Empty and low-confidence reads match nothing.
    """
    usable = F.col(norm) != ""
    if confidence:
        usable &= F.coalesce(F.col(confidence) >= LOW_CONFIDENCE, F.lit(True))
    e = entries.select(F.col(norm).alias("__norm"), F.col(name).alias("__name"))
    exact = reads.where(usable).join(e, F.col(norm) == F.col("__norm")).select(key, F.col("__name").alias("matched"), F.lit(0).alias("distance"), F.lit(1).alias("n_best"))
    rest = reads.where(usable).join(exact.select(key), key, "left_anti").select(key, norm)
    found = best_candidates(near(rest, entries.select(norm, name), norm, norm), f"r_{key}", f"e_{norm}")
    review = found.select(F.col(f"r_{key}").alias(key), F.col(f"e_{name}").alias("matched"), "distance", "n_best")
    got = exact.withColumn("kind", F.lit("exact")).unionByName(review.withColumn("kind", F.lit("review")))
    out = reads.select(key).join(got, key, "left")
    return out.withColumn("kind", F.coalesce("kind", F.lit("none"))).withColumn(
        "auto", F.coalesce((F.col("kind") == "exact") | ((F.col("distance") >= 1) & (F.col("n_best") == 1)), F.lit(False))
    )


def catalog_limit(entries: DataFrame, norm: str = "norm") -> DataFrame:
    """(least, limit): the least distance between two entries, as far as 4, and the distance that is safe in matching."""
    pairs = near(entries, entries, norm, norm, lambda n: F.least(n, F.lit(MOST)))
    pairs = pairs.where(F.col(f"r_{norm}") < F.col(f"e_{norm}"))
    least = pairs.agg(F.coalesce(F.min("distance"), F.lit(MOST + 1)).cast("int").alias("least"))
    return least.withColumn("limit", F.least(F.lit(1), F.floor(F.col("least") / 2)).cast("int"))


RESOLVED = "person string, pos int, resolved string"


def resolve_ties(ties: DataFrame, taken: DataFrame) -> DataFrame:
    """Resolves tied reads of a person in input order: (person, pos, resolved or null).

    ``ties``: person, pos, image, row, star, candidates (array). ``taken``: person, name, image, row, star of what is
    already matched. A candidate that was found on a provably different row goes: another row of the same image, or a
    row of another image whose star is known and differs. A read with one candidate left takes it, and counts as taken
    for those after it. Sequential, so one person is one task's group.
    """

    def run(key: tuple, t: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        at: dict[str, list] = {}
        for r in held.itertuples():
            at.setdefault(r.name, []).append((r.image, r.row, r.star))
        out = []

        def elsewhere(name, read) -> bool:
            for image, row, star in at.get(name, ()):
                if image == read.image and row != read.row:
                    return True
                known = pd.notna(star) and pd.notna(read.star) and star > 0 and read.star > 0
                if image != read.image and known and star != read.star:
                    return True
            return False

        for r in t.sort_values("pos").itertuples():
            left = [c for c in r.candidates if not elsewhere(c, r)]
            name = left[0] if len(left) == 1 else None
            if name:
                at.setdefault(name, []).append((r.image, r.row, r.star))
            out.append((key[0], r.pos, name))
        return pd.DataFrame(out, columns=["person", "pos", "resolved"])

    return ties.groupBy("person").cogroup(taken.groupBy("person")).applyInPandas(run, RESOLVED)


def near_misses(reads: DataFrame, entries: DataFrame, key: str, read: str = "norm", entry: str = "norm", name: str = "name", limit=allowed_distance, beyond: int = 2) -> DataFrame:
    """(key, log, best, distance): what a person should see of the matching, for every read that is no entry itself.

    ``log`` is fuzzy where an entry lies within its limit; else typo where one lies at most ``beyond`` further off; else
    other, without a best one. The best is the nearest, then the longest, then the first by name. Null and empty reads
    are other. Equal reads have the same best, so it is found once for each different one.
    """
    words = reads.select(F.col(read).alias("word")).where("word IS NOT NULL").distinct()
    found = near(words, entries.select(name, entry), "word", entry, lambda n: limit(n) + beyond)
    within = F.col("distance") <= limit(F.length(f"e_{entry}"))
    order = F.struct((~within).cast("int").alias("out"), "distance", (-F.length(f"e_{name}")).alias("short"), F.col(f"e_{name}").alias("best"))
    best = found.groupBy("r_word").agg(F.min(order).alias("b"))
    out = reads.select(key, read).join(best, F.col(read) == F.col("r_word"), "left").where("b IS NULL OR b.distance > 0")
    log = F.when(F.col("b").isNull(), "other").when(F.col("b.out") == 0, "fuzzy").otherwise("typo")
    return out.select(key, log.alias("log"), F.col("b.best").alias("best"), F.col("b.distance").cast("int").alias("distance"))
