"""Families of records: own values and those of two linked ancestors, and questions over their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.functions.stars import ok, triple
from lodeframe.session import spread
from lodeframe.storage import cut, holding


def members(parents: DataFrame, skills: DataFrame, pid: str, links: dict[str, str], skill: str, star: str) -> DataFrame:
    """(pid, skill, own, g1, g2, ...): the stars of each record and of its linked ancestors, a row per skill that any has.

    ``links`` names each member and the column with its id; a link to nothing gives null stars.
    """
    own = parents.select(F.col(pid)).join(skills.select(pid, skill, F.col(star).alias("star")), pid).withColumn("role", F.lit("own"))
    all_ = own
    for role, col in links.items():
        far = skills.select(F.col(pid).alias("__far"), skill, F.col(star).alias("star"))
        all_ = all_.unionByName(
            parents.select(pid, F.col(col).alias("__far")).join(far, "__far").select(pid, skill, "star").withColumn("role", F.lit(role))
        )
    cols = [F.max(F.when(F.col("role") == r, F.col("star"))).alias(r) for r in ("own", *links)]
    return all_.groupBy(pid, skill).agg(*cols)


def missing_links(parents: DataFrame, pid: str, link: str) -> DataFrame:
    """Records whose link is set but leads nowhere."""
    known = parents.select(F.col(pid).alias("__known"))
    return parents.where(F.col(link).isNotNull()).join(known, F.col(link) == F.col("__known"), "left_anti")


def coverage(family: DataFrame, pid: str, skill: str, roles: list[str], threshold: int = 1) -> DataFrame:
    """(pid, skill) that someone of the family satisfies."""
    met = ok(F.col(roles[0]), threshold)
    for r in roles[1:]:
        met |= ok(F.col(r), threshold)
    return family.where(met).select(pid, skill)


def bitmaps(cover: DataFrame, pid: str, number: str, words: int) -> DataFrame:
    """(pid, bits): the covered skill numbers as an array of 64-bit words."""
    word = lambda w: F.bit_or(F.when(F.floor(F.col(number) / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).cast("int") % 64)).otherwise(F.lit(0).cast("long")))
    return cover.groupBy(pid).agg(F.array(*(word(w) for w in range(words))).alias("bits"))


def _ones(a: str, b: str) -> Column:
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _pairs(left: DataFrame, right: DataFrame, pid: str, score: str, fits: Column | None = None) -> DataFrame:
    """(a, b, n, score) of the pairs a < b that may fit; ``fits`` reads aones, ascore, bones and bscore."""
    side = lambda df, s: df.select(F.col(pid).alias(s), F.col("bits").alias(f"{s}bits"), F.col(score).alias(f"{s}score"), F.col("ones").alias(f"{s}ones"))
    on = F.col("a") < F.col("b")
    pairs = spread(side(left, "a"), "a").join(side(right, "b"), on if fits is None else on & fits)
    return pairs.select("a", "b", _ones("abits", "bbits").alias("n"), (F.col("ascore") + F.col("bscore")).alias("score"))


def best_pairs(maps: DataFrame, pid: str, score: str, k: int = 10, seed: int = 1500) -> DataFrame:
    """The ``k`` pairs a < b that cover most, then have the largest sum of ``score``, then come first.

    Of records with one bitmap only the k + 1 of the largest score, then the first, can be in an answer, so pairs are made
    of those. The k-th best pair among the ``seed`` records of the largest scores and as many of the widest bitmaps is a
    lower bound for the k-th best of all. A record goes if it cannot reach that bound even with the widest bitmap and the
    largest score of all beside it, none covering more than all records together; so does a pair of what is left. Where
    the bound covers everything, only sums of scores decide, and few records stay. Only k rows are kept per task.
    """
    best = Window.partitionBy("bits").orderBy(F.desc(score), pid)
    maps = maps.where(F.col(score).isNotNull()).withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k + 1).drop("__k")
    m = cut(maps.select(pid, "bits", score, F.aggregate("bits", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones")), "maps")
    words = len((m.select("bits").first() or [[]])[0])
    most = m.agg(F.max("ones").alias("ones"), F.max(score).alias("score"), F.array(*(F.bit_or(F.get("bits", F.lit(i))) for i in range(words))).alias("all")).first()
    if most["ones"] is None:
        return holding(_pairs(m, m, pid, score).limit(k), m)
    every = sum(bin(w & (2**64 - 1)).count("1") for w in most["all"])
    first = m.orderBy(F.desc(score), pid).limit(seed).union(m.orderBy(F.desc("ones"), F.desc(score), pid).limit(seed)).distinct()
    reached = _pairs(first, first, pid, score).orderBy(F.desc("n"), F.desc("score")).limit(k).select("n", "score").collect()
    if len(reached) < k:
        fit, fits = m, None
    else:
        n, total = min((r["n"], r["score"]) for r in reached)
        can = lambda ones, sums: (F.least(F.lit(every), ones) > n) | ((F.least(F.lit(every), ones) == n) & (sums >= F.lit(total)))
        fit = m.where(can(F.col("ones") + most["ones"], F.col(score) + F.lit(most["score"])))
        fits = can(F.col("aones") + F.col("bones"), F.col("ascore") + F.col("bscore"))
    return holding(_pairs(fit, fit, pid, score, fits).orderBy(F.desc("n"), F.desc("score"), "a", "b").limit(k), m)


def recommend(family: DataFrame, first: DataFrame, pid: str, skill: str, roles: list[str], threshold: int = 1, gene: DataFrame | None = None) -> DataFrame:
    """For each other record: how many of the skills that ``first`` lacks it fills, and with how many stars.

    ``first``: (skill) wanted, with ``covered``. Stars are the known stars of the family for the skills it fills; an
    unknown star may fill a skill and counts nothing. ``gene``: (pid, gene), the third thing to order by; records
    without have 0.
    """
    lack = first.where(~F.col("covered")).select(skill)
    got = family.join(F.broadcast(lack), skill)
    met = ok(F.col(roles[0]), threshold)
    for r in roles[1:]:
        met |= ok(F.col(r), threshold)
    stars = F.when(met, triple(threshold, *map(F.col, roles))).otherwise(0)
    out = got.groupBy(pid).agg(F.count_if(met).alias("fill"), F.sum(stars).alias("stars"))
    return out if gene is None else out.join(gene, pid, "left").fillna(0, ["gene"])


def jaccard(a: Column, b: Column) -> Column:
    """round(100 * common / all) of two sets as arrays; 0 where both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ > 0, F.floor(100 * both / all_ + 0.5)).otherwise(0).cast("int")


#: So many records of a block are held against as many at a time, and so many of these in one array.
CHUNK, ROWS = 8192, 128


def _bitmaps(lists, universe):
    """(words, records) of 64-bit words: which of ``universe`` each list has."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = pc.index_in(lists.flatten(), value_set=universe).to_numpy(zero_copy_only=False)
    out = np.zeros((max(1, -(-len(universe) // 64)), len(sizes)), np.uint64)
    np.bitwise_or.at(out, (at >> 6, np.repeat(np.arange(len(sizes)), sizes)), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def candidates(new: DataFrame, old: DataFrame, key: list[str], skills: str, stars: str, k: int = 5) -> DataFrame:
    """For each new record up to ``k`` old ones with the same ``key``: exact before near, then the more alike, the newer.

    ``exact``: no star known to both differs. (new_id, old_id, score, exact, place). Records of one key are dealt into
    chunks of about CHUNK; each pair of chunks is a group of its own, compared as bitmaps, which keeps k rows of each
    new record, so memory is bounded, the work spreads, and pairs are never rows. Ids are whole numbers.
    """
    import pyarrow as pa

    largest = old.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    most = new.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    parts, others = (-(-n // CHUNK) or 1 for n in (most, largest))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["id", F.col(skills).alias("skills"), F.map_keys(stars).alias("known"), F.map_values(stars).alias("stars")]
    left = new.select(*key, *cols).withColumn("__i", dealt(parts)).withColumn("__j", every(others))
    right = old.select(*key, *cols).withColumn("__j", dealt(others)).withColumn("__i", every(parts))
    names = ["new_id", "old_id", "score", "exact"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        a, b = (t.rename_columns([c[2:] for c in t.column_names]) for t in (a, b))
        b = b.sort_by("id")
        if not len(a) or not len(b):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.bool_())], names=names)
        flat = lambda t, c: t[c].combine_chunks() if not isinstance(t[c].combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(t[c].chunks)
        both = lambda c: pc.unique(pa.concat_arrays([flat(a, c).flatten(), flat(b, c).flatten()]))
        held, known = both("skills"), both("known")
        # A star is told by its skill and its number, a skill with a known one by itself.
        count = max(1, len(known))

        def marks(t):
            ks, vs = flat(t, "known"), flat(t, "stars")
            code = pc.index_in(ks.flatten(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
            value = pc.fill_null(vs.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(t)), pc.fill_null(pc.list_value_length(ks), 0).to_numpy(zero_copy_only=False))
            return code[value > 0], value[value > 0], of[value > 0]

        (ca, va, oa), (cb, vb, ob) = marks(a), marks(b)

        def at(code, of, n):
            out = np.zeros((-(-count // 64), n), np.uint64)
            np.bitwise_or.at(out, (code >> 6, of), np.uint64(1) << (code & 63).astype(np.uint64))
            return out

        values = np.intersect1d(va, vb)
        ka, kb = at(ca, oa, len(a)), at(cb, ob, len(b))
        alike = [(at(ca[va == v], oa[va == v], len(a)), at(cb[vb == v], ob[vb == v], len(b))) for v in values]
        sa, sb = _bitmaps(flat(a, "skills"), held), _bitmaps(flat(b, "skills"), held)
        na, nb = (np.bitwise_count(x).sum(0).astype(np.int32) for x in (sa, sb))
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        out = []
        for i in range(0, len(a), ROWS):
            r = slice(i, i + ROWS)
            common = np.zeros((len(ia[r]), len(ib)), np.int32)
            for x, y in zip(sa, sb):
                common += np.bitwise_count(x[r, None] & y)
            all_ = na[r, None] + nb - common
            score = (200 * common + all_) // np.maximum(2 * all_, 1)
            clash = np.zeros(common.shape, bool)
            for w in range(len(ka)):
                same = np.zeros(common.shape, np.uint64)
                for x, y in alike:
                    same |= x[w, r, None] & y[w]
                clash |= (ka[w, r, None] & kb[w] & ~same) != 0
            rank = (np.where(clash, 0, 128) + score).astype(np.int64) * len(ib) + np.arange(len(ib))
            rank[ia[r, None] == ib] = -1
            if len(ib) > k:
                top = np.argpartition(rank, len(ib) - k, axis=1)[:, -k:]
            else:
                top = np.broadcast_to(np.arange(len(ib)), rank.shape)
            row = np.repeat(np.arange(len(rank)), top.shape[1])
            col = top.ravel()
            row, col = row[rank[row, col] >= 0], col[rank[row, col] >= 0]
            out.append((ia[r][row], ib[col], score[row, col].astype(np.int32), ~clash[row, col]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    on = [*key, "__i", "__j"]
    # The sides may be one table, whose columns would have two meanings without other names.
    tasks = lambda df, s: spread(df.toDF(*(f"{s}{c}" for c in df.columns)), *(f"{s}{c}" for c in on)).groupBy(*(f"{s}{c}" for c in on))
    found = tasks(left, "n_").cogroup(tasks(right, "o_")).applyInArrow(run, "new_id long, old_id long, score int, exact boolean")
    order = Window.partitionBy("new_id").orderBy(F.desc("exact"), F.desc("score"), F.desc("old_id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def plan_match(plans: DataFrame) -> Column:
    """1 if a record and its two ancestors fill one side of a six-slot plan (ancestors in any order), 2 if it is anywhere in it, else 0.

    Columns: ``uma``, ``g1``, ``g2``, ``slots`` (parent and two ancestors of each side).
    """
    gp = F.array_sort(F.array("g1", "g2"))
    side = lambda i: (F.get("slots", F.lit(i)) == F.col("uma")) & (F.array_sort(F.slice("slots", i + 2, 2)) == gp)
    return F.when(F.coalesce(side(0) | side(3), F.lit(False)), 1).when(F.coalesce(F.array_contains("slots", F.col("uma")), F.lit(False)), 2).otherwise(0)


def plan_cover(left: DataFrame, right: DataFrame, words: int) -> DataFrame:
    """The best coverage over one record from either side; an empty side counts as a record that covers nothing."""
    none = F.array(*[F.lit(0).cast("long")] * words)
    fill = lambda df, name: df.select(F.col("bits").alias(name)).union(df.sparkSession.range(1).select(none.alias(name))).distinct()
    return fill(left, "x").join(F.broadcast(fill(right, "y"))).agg(F.max(_ones("x", "y")).alias("best"))


def numbering(df: DataFrame, day: str, order: str) -> DataFrame:
    """``no``: the place within the day, shown only where the day repeats."""
    w = Window.partitionBy(day)
    return df.withColumn("no", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy(order))))


def holders(family: DataFrame, skill: str, own: str = "own") -> DataFrame:
    return family.where(ok(F.col(own), 1)).groupBy(skill).agg(F.count("*").alias("holders"))


def visible(parents: DataFrame, in_set: Column | None, origin: Column, owners: list | None = None, owner: Column | None = None) -> DataFrame:
    """Parents of the current set, or without one all that did not come from an exam; of the chosen owners."""
    shown = parents.where(in_set if in_set is not None else ~origin.eqNullSafe(F.lit("exam")))
    return shown.where(owner.isin(owners)) if owners else shown


def six_columns(family: DataFrame, pid: str, a: int, b: int, skill: str, roles: list[str]) -> DataFrame:
    """(skill, a_own, a_g1, ..., b_g2): two selected records' members side by side."""
    side = lambda p, n: family.where(F.col(pid) == p).select(skill, *(F.col(r).alias(f"{n}_{r}") for r in roles))
    return side(a, "a").join(side(b, "b"), skill, "full")


def pair_detail(family: DataFrame, pid: str, a: int, b: int, skill: str, roles: list[str], threshold: int) -> DataFrame:
    """(covered, missing, stars, unknown) of a pair: what either family satisfies, what neither does, known stars, unknown ones."""
    six = six_columns(family, pid, a, b, skill, roles)
    cols = [F.col(f"{n}_{r}") for n in "ab" for r in roles]
    met = ok(cols[0], threshold)
    for c in cols[1:]:
        met |= ok(c, threshold)
    known = sum((F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in cols[1:]), F.greatest(F.coalesce(cols[0], F.lit(0)), F.lit(0)))
    unknown = sum((F.coalesce(c < 0, F.lit(False)).cast("int") for c in cols[1:]), F.coalesce(cols[0] < 0, F.lit(False)).cast("int"))
    return six.agg(F.count_if(met).alias("covered"), F.count_if(~met).alias("missing"), F.sum(known).alias("stars"), F.sum(unknown).alias("unknown"))


def page_of(df: DataFrame, order: list, first: int, last: int, extra: int = 4) -> DataFrame:
    """``place`` and the rows from ``extra`` before the first shown row to ``extra`` after the last.

    Only the first ``last + extra`` rows of the order are kept by each task before they are numbered.
    """
    top = df.orderBy(*order).limit(last + extra + 1)
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where(F.col("place").between(max(0, first - extra), last + extra))
