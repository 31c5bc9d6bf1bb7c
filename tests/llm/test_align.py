"""Token alignment against a plain version that encodes whole texts with the libraries."""

import hashlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeframe.llm import align
from lodeframe.llm.queries import QUERIES, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(A))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE = byte_of()


def tokens(libraries, text):
    """(A tokens, B tokens) as (id, bytes), or None where a text has none."""
    t, m = libraries
    if not text:
        return None
    a = [(i, bytes(BYTE[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def groups(a, b):
    ends = lambda ts: np.cumsum([len(x) for _, x in ts]).tolist()
    ea, eb = ends(a), ends(b)
    out, last = [], 0
    for end in sorted(set(ea) & set(eb)):
        out.append(([i for (i, _), e in zip(a, ea) if last < e <= end], [i for (i, _), e in zip(b, eb) if last < e <= end]))
        last = end
    return out


def plain(libraries, rows):
    found, count = [], Counter()
    for doc, text in rows:
        got = tokens(libraries, text)
        gs = groups(*got) if got else []
        links = [p for x, y in gs for p in product(x, y)]
        count.update(set(links))
        found.append((doc, gs, links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for doc, gs, links in found:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        out.append((
            doc, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links),
            sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if gs else "",
        ))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(docs, **how):
    got = align.align(docs, "doc_id", a=tokenizer_path(A), b=tokenizer_path(B), **how)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_is_the_plain_version(spark, sf_dir, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_tokenizer_alignment"](spark, sf_dir).select(*COLUMNS).collect()), key=str)
    assert got == plain(libraries, rows)


ODD = [
    None, "", " ", "  ", "\n", "\n\n", "\n\n\n a", " a", "a ", "a  b", "  a\n\n  b  ", "a\tb\t\tc", "a \n b", "\r\n x\r\n", "x y 　z",
    "▁", "a▁b", "<|endoftext|>", "a <|endoftext|> b <s> </s> <unk> <0x41>", "don't we'll I'M 's", "etc. e.g. (x) ... --- $$$ ## a.b,c",
    "漢字かな交じり文", "emoji 👍🏽 é ﬁ İ", "a\x00b \x00", "\x1c\x1d x\x85y", "tab\t after", "9 99 999 1e10 3.14", "x" * 3000, "ab " * 3000,
    "é" * 400, "word\nword\nword", "\nstart", "end\n", "a\n\nb", "a\n \nb", "﻿bom", "zero​width",
]


def test_odd_texts_repeated_rows_nulls_and_names(spark, libraries):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.select("*", *(F.lit(1).alias(n) for n in ("part", "row", "codes", "word", "pair", "docs", "h", "groups")))
    want = plain(libraries, rows)
    assert run(docs) == want
    assert run(docs, part_bytes=50, limit=0) == want
    with pytest.raises(ValueError):
        align.align(docs.withColumn("n_a", F.lit(1)), "n_a", a=tokenizer_path(A), b=tokenizer_path(B))


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    assert run(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab9 é漢\n\t.'▁-\x00　\x85"), max_size=24))
def test_words_are_cut_where_both_tokenizers_cut(libraries, text):
    import pyarrow as pa

    whole = tokens(libraries, text)
    words = align._CUT.split(" " + text) if text else []
    assert "".join(words) == (" " + text if text else "")
    got = [lib.tokens(pa.array(words, pa.string())).to_pylist() for lib in LIBRARIES()]
    if whole is None:
        assert not words or any(not x["ids"] for g in got for x in g)
        return
    for g, want in zip(got, whole):
        assert [t for w in g for t in zip(w["ids"], w["lens"])] == [(i, len(x)) for i, x in want]


_LIBRARIES = []


def LIBRARIES():
    if not _LIBRARIES:
        _LIBRARIES.extend(align.Library(tokenizer_path(n)) for n in (A, B))
    return _LIBRARIES


@given(st.lists(st.lists(st.integers(0, 2**31), max_size=9), max_size=5))
def test_packed_numbers(lists):
    flat = np.array([x for y in lists for x in y], np.int64)
    got = align.pack(flat, np.array([len(y) for y in lists], np.int64))
    assert [align.unpack(x.as_buffer()).tolist() for x in got] == lists
