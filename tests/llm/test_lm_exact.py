"""The registered LM scores against plain counts of every word and bigram."""

import math
import random
import urllib.parse
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lodeframe.llm import lm
from lodeframe.llm.queries import op2_lm_scoring
from lodeframe.session import table
from tests.llm.test_text_ops import AWKWARD


def plain_scores(rows, listed):
    words, histories, pairs = ([Counter(), Counter()] for _ in range(3))
    split = [(d, (t or "").encode().lower().split()) for d, t in rows]
    for d, w in split:
        for k in (0, 1)[: 1 + (d in listed)]:
            words[k].update(w)
            histories[k].update([None, *w][: len(w)])
            pairs[k].update(zip([None, *w], w))
    out = []
    for d, w in split:
        loss = []
        for k in (1, 0):
            mine = k == 0 or d in listed  # a document's own counts are taken away
            own = [Counter(w), Counter([None, *w][: len(w)]), Counter(zip([None, *w], w))] if mine else [Counter()] * 3
            total, s = sum(words[k].values()) - mine * len(w) + lm.ADD * len(words[0]), 0.0
            for a, b in zip([None, *w], w):
                one = (words[k][b] - own[0][b] + lm.ADD) / total
                seen = histories[k][a] - own[1][a]
                s -= math.log2(lm.MIX * (pairs[k][a, b] - own[2][a, b]) / seen + (1 - lm.MIX) * one if seen else one)
            loss.append(s / max(len(w), 1))
        out.append((str(d), len(w), *loss, loss[0] - loss[1]))
    return sorted(out)


def same(got, want):
    got = sorted((str(r[0]), *r[1:]) for r in got)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], abs=1e-9)


def test_query_counts_every_bigram(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 1 << 16)  # many batches and ranges
    monkeypatch.setattr(lm, "RANGE", 1 << 16)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    good = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").collect()}
    same(op2_lm_scoring(spark, sf_dir).collect(), plain_scores(rows, good))


def test_estimates_sum_to_one():
    """The formula, over the vocabulary, after a history: counted words, smoothed words and unseen ones."""
    words, after = Counter("a b a c".split()), Counter({"b": 1, "c": 1})  # after a
    total = sum(words.values()) + lm.ADD * len(words)
    assert math.isclose(sum(lm.MIX * after[w] / 2 + (1 - lm.MIX) * (words[w] + lm.ADD) / total for w in words), 1)


def test_copies_score_apart(spark):
    """A document that occurs twice is likelier under the background than one that occurs once."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[1]])), "doc_id long, text string")
    got = {r["doc_id"]: r["difference"] for r in lm.score(df, df.where("doc_id between 20 and 39").select("doc_id")).collect()}
    assert min(got[i] for i in (0, 1, 40, 41)) > max(got[i] for i in range(2, 40))


def test_exact_awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, score int, digest string")
    listed = spark.createDataFrame([(1,), (1,), (None,), (6,)], "doc_id long")
    same(lm.score(df, listed).collect(), plain_scores([r[:2] for r in AWKWARD], {1, 6}))
    assert lm.score(df.limit(0), listed).count() == 0


def test_a_batch_of_texts_is_a_row_group(spark, monkeypatch):
    made, whole = [], lm.cut
    monkeypatch.setattr(lm, "BATCH", 1 << 12)
    monkeypatch.setattr(lm, "cut", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    docs = spark.createDataFrame([(i, f"w{i} " * 1000) for i in range(30)], "doc_id long, text string").coalesce(1)
    lm.score(docs, docs.limit(3).select("doc_id"))
    assert [pq.ParquetFile(f.removeprefix("file:")).num_row_groups >= 15 for f in (urllib.parse.unquote(x.replace("file://", "file:")) for x in made[0].inputFiles())] == [True]
