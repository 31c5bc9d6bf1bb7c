"""Token ids in patched frame-of-reference files.

A file is a byte string: a header, the ids and first tokens of its documents, the byte starts of its blocks, then the
blocks. A block holds up to BLOCK ids: the least of them, the others' distances from it packed at a width that fits most
of them, and a list of exceptions for the rest. Files are rows of a Parquet table, so any store that Spark reaches will
do and a lost task writes only its own files anew.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm.batch import coded_words, joined, slices, word_of, worker_cache

BLOCK = 2048
#: A file is closed at this many ids; documents are never cut, so a longer one makes a longer file of its own.
FILE_IDS = 1 << 18
#: The width of a block is that of one of these percentiles of its distances, whichever takes the fewest bytes.
PERCENTILES = (50, 75, 90, 95, 98, 99, 100)
END = 0

_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQI")
_BLOCK = struct.Struct("<HBIH")


def pack_block(ids) -> bytes:
    """One block of 1 to BLOCK unsigned 32-bit ids."""
    import numpy as np

    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    order = np.sort(rest)
    n = len(order)
    best = None
    for p in PERCENTILES:
        width = int(order[-(-p * n // 100) - 1]).bit_length()
        out = n - int(np.searchsorted(order, (1 << width) - 1, side="right"))
        cost = n * width + out * 48
        if best is None or cost < best[0]:
            best = cost, width
    width = best[1]
    over = np.flatnonzero(rest > np.uint32((1 << width) - 1))
    kept = rest.copy()
    kept[over] = 0
    if width == 0:
        body = b""
    elif width <= 16:
        bits = np.unpackbits(kept.astype("<u2").view(np.uint8).reshape(n, 2), axis=1, bitorder="little", count=width)
        body = np.packbits(bits, bitorder="little").tobytes()
    else:
        bits = np.unpackbits(kept.astype("<u4").view(np.uint8).reshape(n, 4), axis=1, bitorder="little", count=width)
        body = np.packbits(bits, bitorder="little").tobytes()
    return _BLOCK.pack(n, width, low, len(over)) + body + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(raw, at: int = 0):
    import numpy as np

    n, width, low, n_over = _BLOCK.unpack_from(raw, at)
    at += _BLOCK.size
    size = -(-n * width // 8)
    out = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        room = 2 if width <= 16 else 4
        full = np.packbits(bits, axis=1, bitorder="little")
        wide = np.zeros((n, room), np.uint8)
        wide[:, : full.shape[1]] = full
        out = wide.view("<u2" if room == 2 else "<u4").ravel().astype(np.uint32)
    at += size
    if n_over:
        out[np.frombuffer(raw, "<u2", n_over, at)] = np.frombuffer(raw, "<u4", n_over, at + 2 * n_over)
    return out + np.uint32(low)


def pack_file(docs: list[tuple[int | None, object]]) -> bytes:
    """A file of (doc_id, ids) in their order."""
    import numpy as np

    lengths = np.array([len(i) for _, i in docs], dtype="<u8")
    flat = np.concatenate([i for _, i in docs]) if docs else np.zeros(0, np.uint32)
    blocks = [pack_block(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8") if blocks else np.zeros(0, "<u8")
    return b"".join([
        _HEAD.pack(_MAGIC, len(docs), len(flat), len(blocks)),
        bytes(d is None for d, _ in docs), np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes(),
        (np.cumsum(lengths) - lengths).astype("<u8").tobytes(), starts.tobytes(), *blocks,
    ])


class TokenFile:
    """Reads a file; ``ids(i)`` decodes only the blocks that document ``i`` lies in."""

    def __init__(self, raw: bytes):
        import numpy as np

        magic, n, self.total, blocks = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        null = np.frombuffer(raw, np.uint8, n, at)
        at += n
        self.docs = [None if x else int(d) for x, d in zip(null, np.frombuffer(raw, "<i8", n, at))]
        at += 8 * n
        self.starts = [*map(int, np.frombuffer(raw, "<u8", n, at)), self.total]
        at += 8 * n
        self.blocks = np.frombuffer(raw, "<u8", blocks, at)
        self.at, self.raw, self._last = at + 8 * blocks, raw, (-1, None)

    def block(self, k: int):
        if self._last[0] != k:
            self._last = k, unpack_block(self.raw, self.at + int(self.blocks[k]))
        return self._last[1]

    def all(self):
        """The ids of all documents, one after another."""
        import numpy as np

        return np.concatenate([np.zeros(0, np.uint32), *(unpack_block(self.raw, self.at + int(k)) for k in self.blocks)])

    def ids(self, i: int):
        import numpy as np

        lo, hi = self.starts[i], self.starts[i + 1]
        if lo == hi:
            return np.zeros(0, np.uint32)
        got = [self.block(k) for k in range(lo // BLOCK, (hi - 1) // BLOCK + 1)]
        skip = lo // BLOCK * BLOCK
        return np.concatenate(got)[lo - skip : hi - skip]


#: Unicode white space, as the tokenizer's pattern has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer splits a text before a space that a non-space follows, and within and after white space, so texts can
#: be cut here without changing an id.
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_marks() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: What Arrow may not split: white space after a space, other white space than spaces and line breaks, runs of line breaks
#: that are one chunk.
_ODD = " [\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]| $|\n\n[\n ]|\n\n$|" + (
    "[\\t\\x0b-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
#: Letters of which every version of Unicode says that they are letters.
_LETTERS = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class Encoder:
    """Ids by the tokenizers library; a chunk between two cuts is encoded once for as long as it is remembered.

    Texts are cut, and their chunks numbered, by Arrow for a whole batch; the ids of all chunks stand in one array, from
    which those of the texts are gathered. The tokenizer's pattern makes one word of a space and letters, and one of the
    marks behind them, so such chunks are put together from these two; all others go through the whole tokenizer. Texts
    that hold a special token go through it whole, unless ``plain_specials`` takes these for ordinary text.
    """

    #: Marks that may follow letters; an apostrophe may not, for the pattern knows contractions.
    MARKS = '.,;:!?)("-*#$%&|<>=+/'

    def __init__(self, path: str, remember: int = 700_000, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        known = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if plain_specials else [t.content for t in known]
        self.remember, self.shown = remember, _byte_marks()
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.place: dict[str, int] = {}  # key of a chunk -> its row in ``where``
        self.tails: dict[str, list[int]] = {}
        self.where = np.zeros((1 << 16, 2), np.int64)  # where a chunk's ids start in ``flat``, how many
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _marks(self, tail: str) -> list[int]:
        if tail not in self.tails:
            self.tails[tail] = [t.id for t in self.tokenizer.model.tokenize(tail)]
        return self.tails[tail]

    def _learn(self, new: list[str]) -> None:
        """Notes the ids of the chunks of some keys, none of which is known."""
        import numpy as np

        ids: list[int] = []
        ends, whole, tokenize, marks = [], [], self.tokenizer.model.tokenize, self.MARKS
        for i, c in enumerate(new):
            if c.isascii() and c.isalpha():  # letters and marks stand for themselves
                ids += [t.id for t in tokenize("\u0120" + c)]
            else:
                word = word_of(c)
                head = word.rstrip(marks)
                if head and _LETTERS.fullmatch(head):
                    shown = head.replace(" ", "\u0120") if head.isascii() else head.encode().decode("latin-1").translate(self.shown)
                    ids += [t.id for t in tokenize(shown)]
                    if len(head) < len(word):
                        ids += self._marks(word[len(head) :])
                else:
                    whole.append(i)
            ends.append(len(ids))
        ends = np.array(ends, np.int64)
        size = np.diff(ends, prepend=0)
        start = ends - size
        for i in range(0, len(whole), 20_000):
            some = whole[i : i + 20_000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([word_of(new[k]) for k in some], add_special_tokens=False)):
                start[k], size[k] = len(ids), len(e.ids)
                ids += e.ids
        flat = np.array(ids, np.uint32)
        n, m = len(self.place), len(new)
        while n + m > len(self.where):
            self.where = np.concatenate([self.where, np.zeros_like(self.where)])
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.where[n : n + m, 0], self.where[n : n + m, 1] = self.filled + start, size
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.place.update(zip(new, range(n, n + m)))

    def encode(self, texts) -> list:
        """For each text (of a list or an Arrow array) its ids and END, as unsigned 32-bit integers."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        marked = pa.array([False] * len(texts))
        for content in self.special:
            marked = pc.or_(marked, pc.match_substring(texts, content))
        regular = pc.invert(pc.or_(marked, pc.match_substring_regex(texts, _ODD)))
        keys, which, sizes = coded_words(pc.if_else(marked, "", texts), regular, _CHUNK.findall, False, True)
        if len(self.place) > self.remember:
            self._forget()
        row = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        used = np.zeros(len(keys), bool)
        used[which] = True
        new = np.flatnonzero((row < 0) & used)
        row[new] = np.arange(len(self.place), len(self.place) + len(new))
        self._learn([keys[i] for i in new.tolist()])
        at = self.where[row[which]]
        flat, ends = joined(self.flat, at[:, 0], at[:, 1])
        cuts = np.concatenate([[0], ends])[np.cumsum(sizes)]
        lengths = np.diff(cuts, prepend=0)
        out = np.full(len(flat) + len(lengths), END, np.uint32)
        ends = np.cumsum(lengths + 1)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = flat
        done = np.split(out, ends[:-1])
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            done[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, END], np.uint32)
        return done


FILE_SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType(), False), T.StructField("seq", T.IntegerType(), False),
    T.StructField("start", T.LongType(), False), T.StructField("n_docs", T.LongType(), False),
    T.StructField("n_tokens", T.LongType(), False), T.StructField("file", T.BinaryType(), False),
])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text, appends END, and writes token files at ``path`` in ascending ``doc_id`` order.

    Texts are shuffled once, by ranges of ids, and sorted within them; a task then encodes, packs and emits one file
    after the other, so it holds one file's ids at a time. Null texts count as empty; rows with a null id come first,
    rows with equal ids in the order of their texts.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        enc, part = worker_cache(("tokens", tokenizer), lambda: Encoder(tokenizer)), TaskContext.get().partitionId()
        held, size, seq, start = [], 0, 0, 0

        def close():
            nonlocal held, size, seq, start
            row = [[part], [seq], [start], [len(held)], [size], [pack_file(held)]]
            start, seq, held, size = start + size, seq + 1, [], 0
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=FILE_SCHEMA.names)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).fill_null("")
            for i, j in slices(texts):
                for d, tokens in zip(ids[i:j], enc.encode(texts[i:j])):
                    held.append((d, tokens))
                    size += len(tokens)
                    if size >= FILE_IDS:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Rows with a null id would all meet in one range; there they are told apart by their texts.
    rows = rows.repartitionByRange("doc_id", F.when(F.col("doc_id").isNull(), F.substring("text", 1, 64)))
    rows = rows.sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens and ids_crc32.

    ``start`` counts the ids of all documents before it: a file's place within its range, and the sum of the ranges
    before, of which the driver gets one number each.
    """
    import pyarrow as pa

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for p, n in parts:
        base[p], at = at, at + n
    base = spark.sparkContext.broadcast(base)

    def run(batches):
        for b in batches:
            for part, start, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                f = TokenFile(raw.as_py())
                n = len(f.docs)
                flat = memoryview(f.all().astype("<u4")).cast("B")
                crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(f.starts, f.starts[1:])]
                at = [base.value[part] + start + s for s in f.starts[:-1]]
                size = [f.starts[i + 1] - f.starts[i] for i in range(n)]
                cols = [pa.array(c, pa.int64()) for c in (f.docs, at, size, crc)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "start", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
