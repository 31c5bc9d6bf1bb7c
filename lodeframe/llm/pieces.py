"""SentencePiece BPE with seeded merge-dropout, and lossless decoding.

Of a text's candidate merges the best-scored, then leftmost, is taken from the agenda; a keyed hash decides whether it is
skipped. Skips depend on the seed, the document's key, the word's number in it, the place in the word and the merged piece
alone, so every occurrence of a word is cut by itself, and every run, on any cluster, gives the same ids; with dropout 0 they are the library's own.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.batch import coded_words, joined, slices, word_of, worker_cache

DROPOUT = 0.1
SEED = 20240229
#: Words longer than this run through an agenda in a heap, shorter ones side by side.
SIDE_BY_SIDE = 24
#: Words that a Python worker remembers (some 0.6 kB each), and bytes of text that it cuts at a time.
REMEMBER, SLICE = 200_000, 2 << 20

_SPACE = "▁"
#: What no piece crosses: spaces stand only at the beginning of a piece, line breaks in none.
_WORD = re.compile(" *[^ \n]+| +|\n")
_NONE = 1 << 30
_MULTIPLIER = 0x9E3779B97F4A7C15


class Segmenter:
    """A SentencePiece BPE model: its pieces, merges and scores."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, remember: int = REMEMBER):
        import numpy as np
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        self.dropout, self.seed, self.remember = dropout, seed, remember
        names = [m.id_to_piece(i) for i in range(size)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(size)]
        byte = [m.is_byte(i) for i in range(size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if byte[i]}
        plain = {names[i]: i for i in range(size) if not special[i] and not byte[i]}
        self.decoded = [
            b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(_SPACE, " ").encode()
            for i in range(size)
        ]
        # Symbols: the pieces, then characters that only occur inside pieces.
        self.symbol = dict(plain)
        for c in sorted({c for p in plain for c in p}):
            self.symbol.setdefault(c, len(names) + len(self.symbol))
        self.size = size
        scores = sorted({m.get_score(i) for i in plain.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        merges = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = place[m.get_score(i)], i
        self.merges = merges
        self._tabulate(merges)
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.chars[ord(_SPACE)] = -1  # in a text it is no space
        self.chars[ord(" ")] = self.symbol.get(_SPACE, -1)
        self._forget()

    def _tabulate(self, merges: dict) -> None:
        """The merges as an open-addressed hash table of at most a quarter's load."""
        import numpy as np

        self.bits = max(12, (4 * len(merges)).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank, self.slot_piece = np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        for key, (rank, piece) in merges.items():
            at = ((key * _MULTIPLIER) % 2**64) >> (64 - self.bits)
            while self.slot_key[at] >= 0:
                at = (at + 1) % size
            self.slot_key[at], self.slot_rank[at], self.slot_piece[at] = key, rank, piece

    def _forget(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}  # key of a word -> the node of its first candidate
        # Nodes: a candidate's place and piece and the nodes after it is taken or skipped, -1 while unknown. The end of
        # an agenda is a node of piece -1 that holds where its ids start in ``flat`` and how many they are.
        self.nodes = np.zeros((1 << 16, 4), np.int32)
        self.used = 0
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0

    # One hash for both ways through the agenda.
    def _skipped(self, variant, place, piece):
        import numpy as np

        if variant is None or not self.dropout:
            return np.zeros(np.shape(piece), bool)
        u = np.uint64
        with np.errstate(over="ignore"):
            h = np.asarray(piece).astype(u) * u(0x9E3779B97F4A7C15) + np.asarray(place).astype(u) * u(0xC2B2AE3D27D4EB4F)
            h = h ^ (np.asarray(variant).astype(u) * u(0x165667B19E3779F9) + u(self.seed))
            h = (h ^ (h >> u(30))) * u(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> u(27))) * u(0x94D049BB133111EB)
            h = h ^ (h >> u(31))
        return (h >> u(11)).astype(np.float64) / (1 << 53) < self.dropout

    def _look(self, a, b):
        """(rank, piece) of the merges of symbols a and b; rank _NONE where there is none."""
        import numpy as np

        key = a.astype(np.int64) << 32 | b
        at = ((key.astype(np.uint64) * np.uint64(_MULTIPLIER)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slot_key[at]
        wrong = (got != key) & (got >= 0)
        while wrong.any():
            at[wrong] = (at[wrong] + 1) & (len(self.slot_key) - 1)
            got[wrong] = self.slot_key[at[wrong]]
            wrong &= (got != key) & (got >= 0)
        return np.where(got == key, self.slot_rank[at], _NONE).astype(np.int32), self.slot_piece[at]

    def _together(self, words: list[str], variants):
        """(ids of all words, where each word's start, how many, steps) of words of one length.

        Every word's agenda moves on by one candidate in each step; ``steps`` lists (words' numbers, places, pieces,
        skipped) of each. Without ``variants`` nothing is skipped.
        """
        import numpy as np

        n, width = len(words), len(words[0])
        sym = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")].reshape(n, width)
        place = np.tile(np.arange(width, dtype=np.int16), (n, 1))
        start, size, made, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        row, left, k = np.arange(n), np.full(n, width), np.arange(width)
        rank, piece = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)
        rank[:, :-1], piece[:, :-1] = self._look(sym[:, :-1], sym[:, 1:])  # the last symbol has no right neighbour
        variants = None if variants is None else np.asarray(variants)
        steps = []
        while len(row):
            best = rank.argmin(1)
            at = np.arange(len(row))
            over = rank[at, best] == _NONE
            if over.any():
                end, r, inside = sym[over], row[over], k < left[over][:, None]
                plain = ((end >= 0) & (end < self.size) | ~inside).all(1)
                for ids, of, lengths in (
                    (end[plain][inside[plain]], r[plain], left[over][plain]),
                    *self._bytewise(end[~plain], place[over][~plain], left[over][~plain], r[~plain], words),
                ):
                    made.append(ids.astype(np.uint32))
                    size[of] = lengths
                    start[of] = filled + np.cumsum(lengths) - lengths
                    filled += len(ids)
                on = ~over
                sym, place, rank, piece, row, left, best = (x[on] for x in (sym, place, rank, piece, row, left, best))
                variants = None if variants is None else variants[on]
                if not len(row):
                    break
                at = np.arange(len(row))
            new, where = piece[at, best], place[at, best]
            skip = self._skipped(variants, where, new)
            steps.append((row, where, new, skip))
            rank[at[skip], best[skip]] = _NONE
            go = np.flatnonzero(~skip)
            if not len(go):
                continue
            b = best[go]
            sym[go, b] = new[go]
            left[go] -= 1
            # The symbol after the merged one goes. Pair k stands between symbols k and k + 1: the merged pair goes, and
            # its two neighbours are new.
            pair = np.where(skip, width, best)[:, None]
            low = int(b.min())
            moves, behind = k[low : width - 1] >= pair, k[low : width - 1] > pair
            for table, gone in ((sym, behind), (place, behind), (rank, moves), (piece, moves)):
                table[:, low : width - 1] = np.where(gone, table[:, low + 1 :], table[:, low : width - 1])
            rank[go, width - 1] = _NONE
            for side in (b - 1, b):
                ok = (side >= 0) & (side + 1 < left[go])
                g, s = go[ok], side[ok]
                rank[g, s], piece[g, s] = self._look(sym[g, s], sym[g, s + 1])
                out = (side >= 0) & ~ok
                rank[go[out], side[out]] = _NONE
            if (most := int(left.max())) < width:
                width, k = most, k[:most]
                sym, place, rank, piece = (x[:, :most] for x in (sym, place, rank, piece))
        return np.concatenate([np.zeros(0, np.uint32), *made]), start, size, steps

    def _bytewise(self, symbols, places, left, rows, words):
        """(ids, row, how many) of each word that holds characters without a piece, as bytes."""
        import numpy as np

        for s, p, n, r in zip(symbols, places, left.tolist(), rows.tolist()):
            ids = self._ids([(int(x), words[r][int(y)]) for x, y in zip(s[:n], p[:n])])
            yield np.frombuffer(ids, "<u4"), np.array([r]), np.array([len(ids) // 4])

    def _alone(self, word: str, variant: int | None, trace: list | None = None) -> bytes:
        """The ids of one word, by an agenda in a heap; (place, piece, skipped) of each candidate go to ``trace``."""
        import heapq

        n = len(word)
        sym = [int(self.chars[ord(c)]) for c in word]
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (got := self.merges.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (got[0], i, j, sym[i], sym[j], got[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, a, b, piece = heapq.heappop(heap)
            if sym[i] != a or nxt[i] != j or sym[j] != b:
                continue
            skip = variant is not None and bool(self._skipped(variant, i, piece))
            if trace is not None:
                trace.append((i, piece, skip))
            if skip:
                continue
            sym[i], sym[j] = piece, -2
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return self._ids([(sym[i], word[i]) for i in range(n) if sym[i] != -2])

    def _ids(self, symbols: list[tuple[int, str]]) -> bytes:
        import numpy as np

        out: list[int] = []
        for s, c in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                out += (self.bytes[x] for x in (_SPACE if c == " " else c).encode())
        return np.array(out, "<u4").tobytes()

    def _grow(self, words: list[str], variants, depth: int):
        """The nodes that the agendas of ``words`` reach at ``depth``; they and all that follow are added."""
        import numpy as np

        first = np.zeros(len(words), np.int64)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for width, at in by.items():
            group, own = [words[i] for i in at], variants[at]
            if width > SIDE_BY_SIDE or len(group) < 4:
                traces: list = [[] for _ in group]
                done = [np.frombuffer(self._alone(w, v, t), "<u4") for w, v, t in zip(group, own, traces)]
                ids, size = np.concatenate(done), np.array([len(x) for x in done])
                start = np.cumsum(size) - size
                n = np.array([len(t) for t in traces])
                place, piece, skip = np.array([x for t in traces for x in t], np.int64).reshape(-1, 3).T
                rows, at_step = np.repeat(np.arange(len(group)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                late = at_step >= depth
                steps = [(rows[late], place[late], piece[late], skip[late].astype(bool), at_step[late] - depth)]
            else:
                ids, start, size, steps = self._together(group, own)
                n = np.zeros(len(group), np.int64)
                for rows, *_ in steps:
                    n[rows] += 1
                steps = [(*step, k) for k, step in enumerate(steps[depth:])]
            # Each word's nodes stand in a row, the end of its agenda last.
            n = n - depth + 1
            last = np.cumsum(n) - 1
            total = int(n.sum())
            self._room(total, len(ids))
            head = self.used + last - n + 1
            for rows, place, piece, skip, k in steps:
                node = head[rows] + k
                self.nodes[node, 0], self.nodes[node, 1] = place, piece
                self.nodes[node, 2], self.nodes[node, 3] = np.where(skip, -1, node + 1), np.where(skip, node + 1, -1)
            last += self.used
            self.nodes[last, 1], self.nodes[last, 2], self.nodes[last, 3] = -1, self.filled + start, size
            first[at] = head
            self.flat[self.filled : self.filled + len(ids)] = ids
            self.used, self.filled = self.used + total, self.filled + len(ids)
        return first

    def _room(self, nodes: int, ids: int) -> None:
        import numpy as np

        if self.used + nodes > len(self.nodes):
            self.nodes = np.concatenate([self.nodes, np.zeros((max(nodes, len(self.nodes) // 4), 4), np.int32)])
        if self.filled + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(ids, len(self.flat) // 4), np.uint32)])

    def encode(self, texts, keys) -> list:
        """For each text (a list or an Arrow array of strings) its ids; ``keys`` are the documents' own.

        An empty text has none. What an agenda does is remembered as a tree by word: at each candidate the hash of the
        occurrence decides whether it is taken or skipped, and only ways that no occurrence went before are run anew. So
        every occurrence goes its own way, at the price of its candidates' hashes.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        regular = pc.and_(pc.invert(odd), pc.greater(pc.binary_length(texts), 0))
        keyed, which, sizes = coded_words(texts, regular, lambda t: _WORD.findall(" " + t) if t else [], True)
        if len(self.known) > self.remember or self.used > 10 * self.remember:
            self._forget()
        number = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            own = np.repeat(np.array([k % 2**64 for k in keys], np.uint64), sizes) * np.uint64(0xFF51AFD7ED558CCD)
            own = (own ^ own >> np.uint64(33)) + number.astype(np.uint64)
            own = (own ^ own >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
            own = own ^ own >> np.uint64(29)
        node = np.fromiter(map(self.known.get, keyed, repeat(-1)), np.int64, len(keyed))
        used = np.full(len(keyed), -1)
        used[which[::-1]] = np.arange(len(which))[::-1]  # the first occurrence of each word
        new = np.flatnonzero((node < 0) & (used >= 0))
        if len(new):
            fresh = [keyed[i] for i in new.tolist()]
            node[new] = self._grow([word_of(w) for w in fresh], own[used[new]], 0)
            self.known.update(zip(fresh, node[new].tolist()))
        at = node[which]
        on, depth = np.arange(len(at)), 0
        while True:
            c = at[on]
            t = self.nodes[c]
            live = t[:, 1] >= 0
            on, c, t = on[live], c[live], t[live]
            if not len(on):
                break
            depth += 1
            skip = self._skipped(own[on], t[:, 0], t[:, 1])
            to = np.where(skip, t[:, 3], t[:, 2]).astype(np.int64)
            lost = np.flatnonzero(to < 0)
            if len(lost):
                way, rep, back = np.unique(c[lost] * 2 + skip[lost], return_index=True, return_inverse=True)
                rep = on[lost[rep]]
                made = self._grow([word_of(keyed[i]) for i in which[rep].tolist()], own[rep], depth)
                self.nodes[way >> 1, 2 + (way & 1)] = made
                to[lost] = made[back]
            at[on] = to
        start, size = self.nodes[at, 2].astype(np.int64), self.nodes[at, 3].astype(np.int64)
        flat, ends = joined(self.flat, start, size)
        cuts = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return np.split(flat, cuts[:-1])

    def decode(self, ids) -> str:
        """The text of ``ids``: whatever was skipped, exactly the text that was encoded."""
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
        return raw.removeprefix(b" ").decode(errors="replace")


def _key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"))


def encode(docs: DataFrame, model: str, *keep: str, doc_id: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED, ids: bool = True, remember: int = REMEMBER, slice_bytes: int = SLICE) -> DataFrame:
    """The columns ``keep`` of each row, ``n_tokens``, ``ids`` (if asked for), ``ids_crc32``, ``text_crc32`` and ``lossless``.

    ``text_crc32`` is that of the text decoded from the ids, and ``lossless`` tells whether that is the text itself.
    Null and empty texts have no ids. A literal U+2581, which the library would turn into a space, is written as bytes.
    No shuffle; texts pass in pieces of ``slice_bytes``, and workers remember ``remember`` words: both are paid in memory and
    only change the time it takes. Repeated rows give equal ids; an empty table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    more = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType(), False)), ("ids_crc32", T.LongType()), ("text_crc32", T.LongType()), ("lossless", T.BooleanType())]
    more = [(n, t) for n, t in more if ids or n != "ids"]
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(n, t, False) for n, t in more])

    def run(batches):
        m = worker_cache(("pieces", model, dropout, seed, remember), lambda: Segmenter(model, dropout, seed, remember))
        for whole in batches:
            for i, j in slices(whole.column(len(keep)), slice_bytes):
                b = whole.slice(i, j - i)
                raw = b.column(len(keep)).fill_null("")
                got, texts = m.encode(raw, b.column(len(keep) + 1).to_pylist()), raw.to_pylist()
                back = [m.decode(g) for g in got]
                cols = [pa.array([len(g) for g in got], pa.int64())]
                if ids:
                    cols.append(_lists(got))
                cols += [
                    pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    pa.array([x == y for x, y in zip(back, texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text"), _key(F.col(doc_id)).alias("__key")).mapInArrow(run, schema)


def _lists(got: list):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.int32)))
