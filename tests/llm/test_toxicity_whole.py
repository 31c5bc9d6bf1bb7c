"""Toxicity features and tree scores against plain versions."""

import random
import re
import unicodedata
from math import log1p

import numpy as np
import pytest

from lodeframe.llm import toxicity


def test_marks_after_many_blanks():
    lexicon = toxicity._Memo({})
    assert toxicity.features(" " * 1000 + "!!!", lexicon) == toxicity.features("!!!", lexicon) != toxicity.features(" " * 2000, lexicon)


LEXICON = {"=idiot": 3.0, "stup~": 2.0, "dumme~": 1.5}


def plain_features(text):
    words = re.findall(r"[^\W_]+", text)
    n = len(words)

    def weight(w):
        return max(LEXICON.get(k, 0.0) for k in ("=" + w, *(w[:k] + "~" for k in (4, 5, 6) if len(w) >= k)))

    scores = [weight(w.lower()) for w in words]
    you = [i for i, w in enumerate(words) if w.lower() in toxicity.SECOND_PERSON]
    hits = [i for i, s in enumerate(scores) if s]
    kinds = [unicodedata.category(c) for c in text]
    upper, letters = sum(k in ("Lu", "Lt") for k in kinds), sum(k[0] == "L" for k in kinds)
    mixed = [m.lower() for m in re.findall(r"[^\W\d_]+(?:[0-9@$*!|.\-]+[^\W\d_]+)+", text)]
    hidden = [m for m in mixed if weight("".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", ".": "", "-": ""}.get(c, c) for c in m))]
    return [
        len(hits) / n, log1p(len(hits)), max(scores), sum(scores) / n, sum(any(abs(h - y) <= 5 for y in you) for h in hits) / n, len(you) / n,
        upper / max(letters, 1), sum(len(w) > 1 and w.isupper() for w in words) / n, sum(k[0] in "PS" for k in kinds) / len(text),
        sum(c in "!?" for c in text) / n, len(mixed) / n, len(hidden) / n, log1p(n),
    ]


def test_features_are_of_the_whole_text():
    rnd = random.Random(2)
    words = "YOU ARE a big fat IDIOT you stupid, st\u00dcpid! \u00c9T\u00c9 \u00df Dummerweise du i.d.i.o.t 1d1ot _x_ \u65e5\u672c \U0001f600 \u00bfqu\u00e9? \u0130 \u01c5a ,".split(" ")
    for n in (1, 3, 30, 3000):
        for _ in range(20):
            text = " ".join(rnd.choices(words, k=n)) + " end"
            assert toxicity.features(text, toxicity._Memo(LEXICON)) == pytest.approx(plain_features(text))


def test_capitals_count_in_any_share():
    at = toxicity.FEATURES.index("words in capitals")
    assert toxicity.features("YOU ARE a big fat thing", toxicity._Memo({}))[at] == 2 / 6


def test_scores_walk_the_trees():
    rnd = np.random.default_rng(5)
    x = rnd.random((400, 4))
    y = (x[:, 0] + 0.2 * rnd.random(400) > 0.6).astype(float)
    trees = toxicity.Trees(rounds=10).fit(x, y)
    points, values = toxicity.isotonic(trees.raw(x), y)
    model = toxicity.Model({}, trees, points, values)
    for row, score, raw in zip(x, model.score(x), trees.raw(x)):
        total = trees.base
        for splits, value in trees.trees:
            node = 0
            for level in splits:
                f, c = level[node]
                node = 2 * node + (sum(e < row[f] for e in trees.edges[f]) > c)
            total += value[node]
        step = [v for p, v in zip(points, values) if p <= total + 1e-12]
        assert abs(total - raw) < 1e-9
        assert abs(score - (0.99 * (step[-1] if step else values[0]) + 0.01 / (1 + np.exp(-total)))) < 1e-9
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
