"""Texts of an Arrow batch as numbers of their different words."""

from __future__ import annotations

#: Begins the key of a word that no space precedes; the key of any other word is what follows its first space.
BARE = "\x00"


def key_of(word: str) -> str:
    return word[1:] if word[0] == " " and word[1:2] != BARE else BARE + word


def word_of(key: str) -> str:
    return key[1:] if key[:1] == BARE else " " + key


#: A full stop or comma by itself between a letter and a space or line break.
_LONE_MARK = r"([A-Za-z\x{c0}-\x{24f}])([.,])([ \n])"

_cache: dict[tuple, object] = {}


def worker_cache(key: tuple | None, make=None):
    """What ``make`` returned for this key in this Python worker, kept for its next tasks.

    Only the last key's is kept, so that what one operator remembers does not stay in memory while another runs; a null
    key only frees it, and gives memory that is no longer used back to the system.
    """
    if key not in _cache:
        import ctypes

        import pyarrow as pa

        _cache.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the GNU C library
            pass
        if key is None:
            return None
        _cache[key] = make()
    return _cache[key]


def coded_words(texts, regular, split, spaced: bool, lone_marks: bool = False):
    """(keys of the different words, each word occurrence's number among them, words in each text) of an Arrow array.

    In texts where ``regular`` (a boolean array) holds, words are a space and what follows it up to the next space or
    line break, line breaks, and what follows these; if ``spaced`` the first word is taken to have a space before it.
    If ``lone_marks``, a full stop or comma between a letter and a space or line break is a word of its own. This is done
    by Arrow on the whole batch. Of other texts, and those that hold the mark, ``split`` lists the words.
    Texts must not be null.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    regular = pc.and_(regular, pc.invert(pc.match_substring(texts, BARE)))
    parts = pc.replace_substring_regex(texts, _LONE_MARK, f"\\1 {BARE}\\2\\3") if lone_marks else texts
    parts = pc.replace_substring(parts, "\n", f" {BARE}\n {BARE}")
    if not spaced:
        parts = pc.binary_join_element_wise(pa.scalar(BARE, parts.type), parts, "")
    lists = pc.split_pattern(pc.if_else(regular, parts, BARE), " ")  # a lone mark: no word
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    which, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    empty = pc.index(coded.dictionary, pa.scalar(BARE, coded.dictionary.type)).as_py()
    if empty >= 0:
        full = which != empty
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], np.cumsum(full)])
        sizes, which = before[ends] - before[ends - sizes], which[full]
    odd = np.flatnonzero(~regular.to_numpy(zero_copy_only=False)).tolist()
    if odd:
        seen = dict(zip(keys, range(len(keys))))
        cuts = np.split(which, np.cumsum(sizes)[:-1])
        for i in odd:
            own = [seen.setdefault(key_of(w), len(seen)) for w in split(texts[i].as_py())]
            cuts[i], sizes[i] = np.array(own, np.int64), len(own)
        which, keys = np.concatenate(cuts), list(seen)
    return keys, which, sizes


def slices(texts, limit: int = 4 << 20):
    """(from, to) of slices of an Arrow array of strings that hold about ``limit`` bytes each."""
    import pyarrow.compute as pc

    at = size = 0
    n = len(texts)
    for i, s in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += s
        if size >= limit or i + 1 == n:
            yield at, i + 1
            at, size = i + 1, 0


def joined(flat, starts, sizes):
    """The elements ``starts``[i] .. ``starts``[i] + ``sizes``[i] of ``flat`` for all i, one after another, and their ends."""
    import numpy as np

    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], ends
