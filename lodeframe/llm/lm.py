"""Cross-entropy difference between matched target and background bigram models.

Both models have one shared vocabulary, the same order and smoothing, and differ only in the documents they count; a
document's score is the mean over its tokens of target loss minus background loss. Every n-gram is counted by itself, in
tables that grow with the corpus, and every document is scored by models that did not count it: its own counts are taken
away first, so a target document is no likelier for being one. Each model's estimates of the words of the vocabulary sum
to one after every history.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.batch import worker_cache
from lodeframe.storage import cut, holding

#: The weight of the bigram estimate against the unigram one, and the count added to every word of the vocabulary.
MIX, ADD = 0.7, 0.5
#: Up to so many target ids (some 50 MB) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Bytes of text whose n-grams are combined before they are shuffled, and bytes of text for each range of n-gram hashes.
BATCH, RANGE = 4 << 20, 8 << 20
#: The 64-bit hash that stands for the history of a first token in exact counts.
FIRST = 0x5851F42D4C957F2D


def _marked(docs: DataFrame, target_ids: DataFrame, limit: int) -> DataFrame:
    """doc_id, text and whether the id is listed (``__in``)."""
    ids = target_ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().withColumn("__in", F.lit(True))
    if ids.count() <= limit:
        ids = F.broadcast(ids)
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left")
    return found.select("doc_id", "text", F.coalesce("__in", F.lit(False)).alias("__in"))


def _grams(texts: list[str | None]):
    """Of the tokens of some texts: text number, place of word and history in ``kinds``, these, place of bigram, bigrams.

    ``kinds`` (the different words and FIRST) and the bigrams are sorted 64-bit hashes.
    """
    import numpy as np
    import xxhash

    hashes, ends = [], [0]
    for text in texts:
        words = text.encode().lower().split() if text else []
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
        ends.append(ends[-1] + len(words))
    h = np.concatenate([*hashes, np.array([FIRST], np.uint64)])
    kinds, at = np.unique(h, return_inverse=True)
    h, word, first = h[:-1], at[:-1], at[-1]
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), sizes)
    history = np.concatenate(([first], word[:-1])) if len(word) else word
    history[np.array(ends[:-1])[sizes > 0]] = first
    pair = kinds[history] * np.uint64(0x9E3779B97F4A7C15) + h
    pair = (pair ^ pair >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    pairs, which = np.unique(pair ^ pair >> np.uint64(31), return_inverse=True)
    return doc, word, history, kinds, which, pairs


def _pack(counts) -> bytes:
    """Rows of counts as deflated planes of bytes, the mostly zero high bytes side by side."""
    import numpy as np

    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(counts, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(raw: bytes, rows: int):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").reshape(rows, -1)


def score(docs: DataFrame, target_ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (bits a token) and their difference, for every row of ``docs``.

    The background counts all documents, the target those whose doc_id is listed in ``target_ids``. The lower the
    difference, the closer to the target. Words and bigrams are told by 64-bit hashes, and the vocabulary is the number of
    different words. Documents are put together in batches of BATCH bytes; each batch sends every different n-gram with
    its counts once to the range of its hash, where they are added up, and gets the sums back in the same order. Ranges
    grow in number with the texts, so none grows with them, and a common n-gram is one entry a batch. Only three totals
    reach the driver.

    Null and empty texts have no tokens and zeros; a null id is never in the target; repeated ids in the list count once;
    repeated rows stay repeated and count each other; a text is scored whole, however long; other columns are ignored; an
    empty table gives an empty result.
    """
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType
    held = T.StructType(
        [T.StructField("batch", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", T.ArrayType(id_type))]
        + [T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("own", T.ArrayType(T.BooleanType()))]
    )

    def gather(batches):
        import os

        worker_cache(None)

        def row(rows, size):
            one = [[int.from_bytes(os.urandom(8), "big") >> 1], [size], *([list(x)] for x in zip(*rows))]
            kinds = [pa.int64(), pa.int64(), pa.list_(ids), pa.list_(pa.string()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(one, kinds)], names=held.names)

        rows, size, ids = [], 0, pa.int64()
        for b in batches:
            ids = b.column(0).type
            for i, text, own in zip(b.column(0), b.column(1), b.column(2)):
                rows.append((i.as_py(), text.as_py(), own.as_py()))
                size += len(rows[-1][1] or "")
                if size >= BATCH:
                    yield row(rows, size)
                    rows, size = [], 0
        if rows:
            yield row(rows, size)

    packed = cut(_marked(docs, target_ids, limit).mapInArrow(gather, held), "batches", group_bytes=BATCH)
    ranges = -(-(packed.agg(F.sum("size")).first()[0] or 0) // RANGE) or 1

    def send(batches):
        import numpy as np

        worker_cache(None)
        bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
        for b in batches:
            for batch, texts, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                doc, word, history, kinds, which, pairs = _grams(texts.as_py())
                mine = np.array(own.as_py(), bool)[doc]
                of = lambda at, n: [np.bincount(at, minlength=n), np.bincount(at[mine], minlength=n)]
                for bigrams, keys, sums in (
                    (False, kinds, np.array(of(word, len(kinds)) + of(history, len(kinds)))), (True, pairs, np.array(of(which, len(pairs)))),
                ):
                    ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    full = [(r, i, j) for r, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
                    cols = [[r for r, _, _ in full], [bigrams] * len(full), [batch] * len(full)]
                    cols += [[keys[i:j].tobytes() for _, i, j in full], [_pack(sums[:, i:j]) for _, i, j in full]]
                    kind = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kind)], names=["range", "bigrams", "batch", "keys", "n"])

    def add(t: pa.Table) -> pa.Table:
        import numpy as np

        keys = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        bigrams = t["bigrams"][0].as_py()
        n = np.hstack([_unpack(x, 2 if bigrams else 4) for x in t["n"].to_pylist()])
        same, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.array([np.bincount(at, weights=x, minlength=len(same)) for x in n]).astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        totals = [0, 0, 0] if bigrams else [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
        cols = [t["batch"], t["bigrams"], t["range"], pa.array([_pack(sums[:, at[i:j]]) for i, j in zip(ends, ends[1:])], pa.binary())]
        cols += [pa.array([x] + [0] * (len(t) - 1), pa.int64()) for x in totals]
        return pa.table(cols, names=["batch", "bigrams", "range", "n", "kinds", "background", "target"])

    sent = packed.select("batch", "texts", "own").mapInArrow(send, "range int, bigrams boolean, batch long, keys binary, n binary")
    back = "batch long, bigrams boolean, range int, n binary, kinds long, background long, target long"
    added = cut(sent.groupBy("range", "bigrams").applyInArrow(add, back), "counts")
    size, *tokens = (x or 0 for x in added.agg(F.sum("kinds"), F.sum("background"), F.sum("target")).first())

    names = ["n_tokens", "loss_target", "loss_background", "difference"]
    types = [T.LongType(), *[T.DoubleType()] * 3]
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t, False) for n, t in zip(names, types)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        doc, word, history, kinds, which, pairs = _grams(left["texts"][0].as_py())
        member = np.array(left["own"][0].as_py(), bool)[doc]

        def own(at, n):
            """How often each token's document holds what stands at ``at``."""
            _, place, times = np.unique(doc * n + at, return_inverse=True, return_counts=True)
            return times[place]

        own_word, own_history, own_pair = own(word, len(kinds)), own(history, len(kinds)), own(which, len(pairs))
        got = sorted(zip(right["bigrams"].to_pylist(), right["range"].to_pylist(), right["n"].to_pylist()), key=lambda r: r[:2])
        single = np.hstack([_unpack(x, 4) for bigrams, _, x in got if not bigrams])
        double = np.hstack([np.zeros((2, 0), np.int64), *(_unpack(x, 2) for bigrams, _, x in got if bigrams)])
        ids = left["ids"].combine_chunks().flatten()
        n = np.bincount(doc, minlength=len(ids))
        loss = []
        for k in (1, 0):
            mine = member if k else 1
            one = (single[k][word] - mine * own_word + ADD) / (tokens[k] - mine * n[doc] + ADD * size)
            seen = single[2 + k][history] - mine * own_history
            pair = (double[k][which] - mine * own_pair) / np.maximum(seen, 1)
            loss.append(-np.log2(np.where(seen > 0, MIX * pair + (1 - MIX) * one, one)))
        cols = [np.bincount(doc, weights=x, minlength=len(ids)) / np.maximum(n, 1) for x in (*loss, loss[0] - loss[1])]
        return pa.table([ids, pa.array(n.astype(np.int64)), *map(pa.array, cols)], names=schema.names)

    kept = packed.select("batch", "ids", "texts", "own").groupBy("batch")
    sums = added.select("batch", "bigrams", "range", "n").groupBy("batch")
    return holding(kept.cogroup(sums).applyInArrow(finish, schema), packed, added)
