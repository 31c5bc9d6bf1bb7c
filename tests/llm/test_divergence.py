"""Source divergence against a plain count, with sketches that are too small to rule anything out and ample ones."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ[@é漢 \n1\x00İ"), max_size=8), max_size=6), st.integers(0, 3))
def test_terms_of_a_batch(texts, skip):
    words, doc = divergence.terms(pa.array(texts, pa.string()).slice(skip))
    want = [(w, i) for i, t in enumerate(texts[skip:]) for w in terms(t)]
    assert list(zip(words.to_pylist(), doc.tolist())) == want


def plain(rows, least, top):
    rows = [(a or "", b or "", terms(t)) for a, b, t in rows]
    docs, count, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, ts in rows:
        docs[lang].update(set(ts))
        count[lang, source].update(ts)
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in kept} for (k, s), c in count.items() if k == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        p = {s: {t: share(c, sum(g.values()), len(kept)) for t, c in g.items()} for s, g in groups.items()}
        q = {t: share(c, sum(whole.values()), len(kept)) for t, c in whole.items()}
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(n=400):
    rng = random.Random(5)
    words = [a + b for a in "abcdefgé漢İ" for b in ("x", "Yz", "", "Ä")]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(30)))) for _ in range(n)]
    return rows + [("en", "only null", None), ("xx", "alone", "rare words"), ("", "s1", "a b"), ("en", "s1", "long " * 20_000), *[("de", "copy", "ax bx cx")] * 90]


@pytest.mark.parametrize("widths", [(4, 4), (16, 24)])
def test_audit(spark, monkeypatch, widths):
    monkeypatch.setattr(divergence, "WIDTHS", widths)
    monkeypatch.setattr(divergence, "BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    docs = docs.selectExpr("*", "1 AS n", "'x' AS item", "2 AS value", "3 AS docs", "4 AS term")
    got = sorted(tuple(r) for r in divergence.audit(docs, least=20, top=5).collect())
    assert got == plain(rows, 20, 5) and any(r[2] == "term" for r in got)


def test_the_sketch_never_underestimates_and_rules_terms_out(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").fillna("").repartition(3)
    bits = 8
    table = divergence.sketch(docs, bits, 20)
    df = defaultdict(int)
    for lang, _, t in rows:
        for w in set(terms(t)):
            df[lang or "", w] += 1
    below = 0
    for (lang, w), n in df.items():
        low = min(int(table[c[0]]) for c in divergence.cells_of([w], [lang], np.array([0]), bits))
        assert low >= min(n, 20)
        below += low < 20
    assert below
    n = divergence.counts(docs, table, bits, 20).select("lang", "term").distinct().count()
    assert n == len(df) - below


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).collect() == []
    docs = spark.createDataFrame([("en", "a", None), ("en", "b", "")], docs.schema)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
