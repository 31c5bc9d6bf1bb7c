"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned against every window of every text.

Only DataFrame functions: one scan, one explode and one hash join in one generated stage, then a group by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.storage import cut, holding

#: A word is a run of other characters than these; A-Z are lower-cased first.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing, and what may stand between words.
_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WINDOW = 10
#: Up to so many different windows (some 400 MB) are broadcast at a time.
BROADCAST_WINDOWS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the fast ``lower`` where no other letter would change."""
    plain = (F.octet_length(text) == F.length(text)) | ~F.rlike(text, F.lit(r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]"))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per different window: ``gram`` (its words joined by a space), ``size`` and ``items``, the ids that hold it.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Ids are
    taken as strings, a null id as the empty string; repeated items fall together.
    """
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = w.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    gram = F.array_join(F.slice("w", F.col("i"), F.col("size")), " ")
    return at.select("item", "size", gram.alias("gram")).groupBy("gram", "size").agg(F.collect_set("item").alias("items"))


def hash_set(grams: DataFrame) -> DataFrame:
    """The windows as a hash table: filed under the hash of their longest word (``key``) at place ``offset``, with the
    hash ``h`` of the whole n-gram. Of words of equal length the last in order of text, at its first place; no window, no
    row. Windows have words, so none is null or empty."""
    w = F.split("gram", " ")
    longest = F.array_max(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return grams.select(
        F.xxhash64(longest).alias("key"), F.array_position(w, longest).cast("int").alias("offset"), "size",
        F.xxhash64(w).alias("h"), "gram", "items",
    )


def _met(base: DataFrame, table: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The matches of one broadcast table, and one row for each document.

    Every token probes the table; where it is the longest word of a window, the n-gram around it is hashed and compared
    with the window's, and equal hashes are verified word by word. All of this happens in the stage that scans the
    texts, where the document's words are at hand and are not copied.
    """
    spread = base.select(*keep, "rid", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    d, g = spread.alias("d"), F.broadcast(table).alias("g")
    first = F.col("d.at") - F.col("g.offset") + 1
    inside = (first >= 1) & (first + F.col("g.size") - 1 <= F.size("d.w"))
    gram = F.slice("d.w", F.greatest(first, F.lit(1)), F.col("g.size"))
    hit = inside & (F.xxhash64(gram) == F.col("g.h")) & (F.array_join(gram, " ") == F.col("g.gram"))
    head = F.col("d.at") == 0
    met = d.join(g, F.xxhash64("d.word") == F.col("g.key"), "left").where(head | (F.col("g.key").isNotNull() & hit))
    found = F.when(~head, F.struct(first.alias("at"), F.col("g.size").alias("size")))
    return met.select(
        "d.rid", *(F.when(head, F.col(f"d.{k}")).alias(k) for k in keep),
        F.when(head, F.size("d.w")).alias("n_words"), found.alias("hit"), F.when(~head, F.col("g.items")).alias("items"),
    )


def scan(docs: DataFrame, items: DataFrame, *keep: str, text: str = "text", window: int = WINDOW, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: the columns ``keep``, ``n_words``, ``hits`` and ``items``.

    ``hits`` lists (at, size) of every window of the document that is a window of an item, ``items`` the ids of those
    items, sorted as strings. The benchmark's windows are counted first: up to ``limit`` they are broadcast; more are
    broadcast in blocks of that many, each scanning the texts once. Only matches and one row per document are shuffled,
    so neither a passage found in a third of all documents nor a document full of hits meets in one task beyond its own
    rows. Repeated rows stay repeated; without documents or without items the result has no rows or no hits.
    """
    table = hash_set(benchmark_windows(items, window))
    blocks = max(1, -(-table.count() // limit))
    base = docs.select(*keep, F.col(text).alias("__text")).withColumn("rid", F.monotonically_increasing_id())
    if blocks > 1:
        base = cut(base, "numbered")  # every block must see the same numbers
    base = base.select(*keep, "rid", words_of(F.col("__text")).alias("w"))
    parts = [table.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [table]
    met = reduce(DataFrame.union, (_met(base, p, keep) for p in parts))
    return (
        met.groupBy("rid")
        .agg(
            *(F.max(k).alias(k) for k in keep),
            F.max("n_words").cast("long").alias("n_words"),
            F.array_sort(F.collect_list("hit")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .drop("rid")
    )


def hit_words(hits: Column) -> Column:
    """How many words lie inside any hit; ``hits`` sorted by place."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["size"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["at"])).cast("long").alias("n"))

    return F.aggregate(hits, zero, step, lambda a: a["n"])


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words and no hits; texts are read whole; windows that overlap count their words once; a
    null id is kept; repeated rows stay repeated; without items nothing is contaminated, without documents no row; other
    columns are ignored.
    """
    found = scan(docs, items, doc_id, **how)
    return found.select(
        F.col(doc_id),
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs``, with all their columns, without those that hold a benchmark window.

    Hit documents are told by id and digest, so repeated and null ids do no harm. That list is narrow; Spark broadcasts
    it where it is small and else shuffles. Null and empty texts stay, repeated rows stay or go together, an empty table
    stays empty, columns may have any names.
    """
    digest = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    own = docs.select(F.col(doc_id).alias("id"), digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    found = scan(own, items, "id", "digest", **how).where(F.size("hits") > 0)
    hit = cut(found.select("id", "digest").distinct(), "hit")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("h.id")) & (digest(F.col(f"d.`{text}`")) == F.col("h.digest"))
    return holding(docs.alias("d").join(hit.alias("h"), same, "left_anti"), hit)


def remove_spans(docs: DataFrame, items: DataFrame, *keep: str, text: str = "text", **how) -> DataFrame:
    """The columns ``keep`` of each row and ``clean_text``: its text without the words inside hits.

    What stands between words is kept, but for what follows a removed word. A null text stays null.
    """
    own = docs.select(*keep, F.col(text).alias("__raw"))
    found = scan(own, items, *keep, "__raw", text="__raw", **how)
    gone = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    parts = F.regexp_extract_all("__raw", F.lit(f"{_CASED}{_GAP}"), F.lit(0))
    lead = F.regexp_extract("__raw", f"^{_GAP}", 0)
    staged = found.withColumn("__gone", gone).withColumn("__parts", parts)
    left = F.filter("__parts", lambda p, i: ~F.array_contains("__gone", i + 1))
    clean = F.when(F.size("hits") == 0, F.col("__raw")).otherwise(F.concat(lead, F.array_join(left, "")))
    return staged.select(*keep, clean.alias("clean_text"))
