"""A mutable document store emulated by whole-table rewrites: upsert, merge, archive, import, expiry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeframe.functions.stars import merge_scalar


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key; all others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def replace_all(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes the whole table beside ``path`` and swaps it in by renames, so readers see the old or the new one."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fresh, gone = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if fs.exists(at(path)):
        fs.rename(at(path), at(gone))
    fs.rename(at(fresh), at(path))
    fs.delete(at(gone), True)


def merge_stars(old: DataFrame, new: DataFrame, keys: list[str], star: str) -> DataFrame:
    """Old and new stars as one table: a new value wins unless it is unknown or missing."""
    both = old.select(*keys, F.col(star).alias("__o")).join(new.select(*keys, F.col(star).alias("__n")), keys, "full")
    return both.select(*keys, merge_scalar(F.col("__o"), F.col("__n")).alias(star))


def add_send(members: DataFrame, sends: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A further send to sets: (members with the last send number of each skill, sets with their number of sends).

    ``members``: set_id, skill_id, last_send. ``sends``: set_id, sends. ``sent``: set_id, skill_id.
    """
    counts = sends.join(sent.select("set_id").distinct().withColumn("__s", F.lit(1)), "set_id", "full").select(
        "set_id", (F.coalesce("sends", F.lit(0)) + F.coalesce("__s", F.lit(0))).cast("int").alias("sends")
    )
    stamped = sent.distinct().join(counts, "set_id").select("set_id", "skill_id", F.col("sends").alias("last_send"))
    all_ = members.select("set_id", "skill_id", "last_send").unionByName(stamped)
    return all_.groupBy("set_id", "skill_id").agg(F.max("last_send").cast("int").alias("last_send")), counts


def old_only(kind: Column, last_send: Column, sends: Column) -> Column:
    """Sent before, but not in the latest send; only sets of some kinds with over one send have such skills."""
    return kind.isin("race", "none", "norace") & (sends > 1) & (last_send < sends)


def in_default_list(origin: Column) -> Column:
    """All but what came from exams; what has no origin is in."""
    return ~origin.eqNullSafe(F.lit("exam"))


def archive(members: DataFrame, sets: DataFrame, target: Column) -> DataFrame:
    """(set_id, skill_id, last_send) after sets that have ended were merged into their category's set.

    ``sets``: set_id, ended, and what ``target`` reads: the id of the archive set. Done twice it changes nothing more.
    """
    where = sets.select("set_id", F.when(F.col("ended"), target).otherwise(F.col("set_id")).alias("to"))
    moved = members.join(where, "set_id").select(F.col("to").alias("set_id"), "skill_id", "last_send")
    return moved.groupBy("set_id", "skill_id").agg(F.max("last_send").alias("last_send"))


def relink(parent_sets: DataFrame, sets: DataFrame, target: Column) -> DataFrame:
    """(parent, set_id) with ended sets replaced by their archive, without repeats."""
    where = sets.select("set_id", F.when(F.col("ended"), target).otherwise(F.col("set_id")).alias("to"))
    return parent_sets.join(where, "set_id").select("parent", F.col("to").alias("set_id")).distinct()


def materialise(parents: DataFrame, gone: DataFrame, pid: str, link: str, copy: list[str]) -> DataFrame:
    """Parents without the ``gone`` ones; who linked to one of them gets a copy of its columns instead of the link."""
    far = parents.join(gone.select(pid), pid, "left_semi").select(F.col(pid).alias("__far"), F.struct(*copy).alias("embedded"))
    left = parents.join(gone.select(pid), pid, "left_anti")
    return left.join(far, F.col(link) == F.col("__far"), "left").withColumn(link, F.when(F.col("__far").isNull(), F.col(link))).drop("__far")


def import_remap(ours: DataFrame, theirs: DataFrame, pid: str, links: list[str]) -> DataFrame:
    """Their rows under ids that we do not have: a colliding id moves behind our largest, in order, and links follow."""
    top = ours.agg(F.coalesce(F.max(pid), F.lit(0)).alias("top"))
    clash = theirs.join(ours.select(pid), pid, "left_semi").select(pid).distinct()
    moved = clash.withColumn("__k", F.row_number().over(Window.orderBy(pid))).join(F.broadcast(top))
    ids = moved.select(F.col(pid).alias("__old"), (F.greatest(F.col("top"), F.lit(0)) + F.col("__k")).alias("__new"))
    out = theirs
    for c in [pid, *links]:
        out = out.join(ids, F.col(c) == F.col("__old"), "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    return out


def import_sets(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Members of sets merged; a skill only they have is stamped before our latest send, but not below 1.

    Both: set_id, skill_id, last_send, sends.
    """
    sends = ours.groupBy("set_id").agg(F.max("sends").alias("ours"))
    full = ours.select("set_id", "skill_id", F.col("last_send").alias("o")).join(
        theirs.select("set_id", "skill_id", F.col("last_send").alias("t")), ["set_id", "skill_id"], "full"
    )
    stamp = F.when(F.col("ours").isNull(), F.col("t")).otherwise(F.greatest(F.lit(1), F.col("ours") - 1))
    return full.join(sends, "set_id", "left").select("set_id", "skill_id", F.coalesce("o", stamp).alias("last_send"))


def pending(handoffs: DataFrame, done: DataFrame) -> DataFrame:
    """The newest hand-off of each receiver that is neither imported nor dismissed; repeats of an id count once."""
    one = handoffs.dropDuplicates(["handoff_id"]).join(done.select("handoff_id"), "handoff_id", "left_anti")
    newest = F.row_number().over(Window.partitionBy("receiver").orderBy(F.desc("created_at"), F.desc("handoff_id")))
    return one.withColumn("__k", newest).where("__k = 1").drop("__k")


def sweep_expired(df: DataFrame, at: str, now: Column, days: int = 3) -> DataFrame:
    """Rows at most ``days`` old; the others are what the store deletes on opening and on every write."""
    return df.where(F.unix_micros(F.col(at).cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - days * 86_400_000_000)


#: The parts of a stored document that an import checks.
DOCUMENT = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("schema", T.IntegerType()), T.StructField("tool", T.StringType()),
    T.StructField("savedAt", T.StringType()), T.StructField("data", T.StringType()),
])


def validate(text: Column, form: str, tool: str, schema: int) -> Column:
    """struct(error, needs_migration, doc) of an exported document; error is null if it can be loaded."""
    doc = F.from_json(text, DOCUMENT)
    error = (
        F.when(doc.isNull() | (doc["format"].isNull() & doc["tool"].isNull()), "unreadable")
        .when(~doc["format"].eqNullSafe(F.lit(form)), "format").when(~doc["tool"].eqNullSafe(F.lit(tool)), "tool")
        .when(doc["schema"].isNull(), "schema").when(doc["schema"] > schema, "newer").when(doc["data"].isNull(), "data")
    )
    return F.struct(error.alias("error"), (error.isNull() & (doc["schema"] < schema)).alias("needs_migration"), doc.alias("doc"))


def register(parents: DataFrame, incoming: DataFrame, pid: str, link: str, star_map: str, sets: str) -> DataFrame:
    """Incoming records merged into the ones they link to, the others added: (pid, stars, sets).

    Merged stars never lose a known value to an unknown one; lists of sets are joined without repeats.
    """
    from lodeframe.functions.stars import merge_known

    new = incoming.where(F.col(link).isNull()).select(pid, star_map, sets)
    to = incoming.where(F.col(link).isNotNull()).select(F.col(link).alias(pid), F.col(star_map).alias("__m"), F.col(sets).alias("__s"))
    merged = parents.join(to, pid, "left").select(
        pid, F.when(F.col("__m").isNull(), F.col(star_map)).otherwise(merge_known(F.col(star_map), F.col("__m"))).alias(star_map),
        F.when(F.col("__s").isNull(), F.col(sets)).otherwise(F.array_union(sets, "__s")).alias(sets),
    )
    return merged.unionByName(new)


def issues(**checks: Column) -> Column:
    """The names of the checks that a record fails."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def migrate_bundles(bundles: DataFrame, parents: DataFrame, distances: list[str], other: str = "medium") -> tuple[DataFrame, DataFrame]:
    """The first schema's bundles as category sets (category, skills), and parents with the ``sets`` their bundles went into.

    Dirt is a category of its own; else the distance is, ``other`` if it is none of the known. ``bundles``: id, surface,
    dist, want; ``parents`` has bundles, which go. Unknown bundles are dropped and sets are named once.
    """
    category = F.when(F.col("surface") == "dirt", "dirt").when(F.col("dist").isin(distances), F.col("dist")).otherwise(other)
    b = bundles.withColumn("category", category)
    skills = b.groupBy("category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("want")))).alias("skills"))
    each = parents.select("pid", F.explode("bundles").alias("id")).join(b.select("id", "category"), "id")
    sets = each.groupBy("pid").agg(F.array_sort(F.collect_set("category")).alias("sets"))
    moved = parents.drop("bundles").join(sets, "pid", "left")
    return skills, moved.withColumn("sets", F.coalesce("sets", F.array().cast("array<string>")))


def edited(cells: DataFrame, read: DataFrame, record: str, keys: list[str], value: str) -> DataFrame:
    """(record, edited): whether any cell differs from what was read, one that only either side has included."""
    a = cells.select(record, *keys, F.col(value).alias("__now"), F.lit(True).alias("__a"))
    b = read.select(record, *keys, F.col(value).alias("__was"), F.lit(True).alias("__b"))
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__now").eqNullSafe(F.col("__was"))
    return a.join(b, [record, *keys], "full").groupBy(record).agg((~F.bool_and(same)).alias("edited"))
