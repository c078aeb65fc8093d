"""The fitted models against plain dense or slow versions of the same method."""

from __future__ import annotations

import math
import random

import numpy as np

from foldline.llm import langid, quality

from .conftest import words


def texts_of(rnd, n):
    tails = {"en": "ing the of", "de": "en der ung", "es": "os el ción"}
    out = []
    for i in range(n):
        lang = list(tails)[i % 3]
        out.append((" ".join(w + rnd.choice(tails[lang].split()) for w in words(rnd, rnd.randint(3, 30))), lang))
    return out


def plain_grams(text):
    """Slots of the distinct n-grams of one to four characters, letters in lower case, all else one space."""
    clean, out = " ", set()
    for c in text.lower():
        clean += c if c.isalpha() else "" if clean.endswith(" ") else " "
    clean = clean if clean.endswith(" ") else clean + " "
    for i in range(len(clean)):
        h = 0
        for c in clean[i : i + langid.GRAMS]:
            h = (h * 0x01000193 + ord(c)) * 0x9E3779B1 % 2**32
            out.add(h >> 17)
    return out


def test_kernels_against_sets():
    rnd = random.Random(1)
    sample = [t for t, _ in texts_of(rnd, 12)] + ["a", "Ünï códe 12 ß", "x  --  y"]
    dense = np.stack([langid.presence(t) for t in sample])
    sets = [plain_grams(t) for t in sample]
    assert all(set(np.flatnonzero(d)) == s for d, s in zip(dense, sets, strict=True))
    k = langid.kernels(dense, dense.astype(np.float32), dense.sum(1).astype(np.float32))
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(k, want, atol=1e-5)


def test_ridge_on_nystroem_features_against_a_plain_solution():
    rnd = random.Random(2)
    data = texts_of(rnd, 150)
    packed = [np.packbits(langid.presence(t)).tobytes() for t, _ in data]
    model = langid.fit(packed, [lang for _, lang in data])
    assert model.languages == ["de", "en", "es"] and len(model.landmarks) == langid.LANDMARKS
    x = np.stack([langid.presence(t) for t, _ in data]).astype(np.float64)
    marks = np.unpackbits(model.landmarks, axis=1).astype(np.float64)
    kernel = lambda a, b: (a @ b.T) / np.sqrt(a.sum(1)[:, None] * b.sum(1)[None, :])
    c, w = kernel(x, marks), kernel(marks, marks)
    # The landmarks' kernel to the power of minus a half, by its spectrum.
    value, vector = np.linalg.eigh(w)
    features = c @ (vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T)
    features = np.hstack([features, np.ones((len(x), 1))])
    label = np.array([model.languages.index(lang) for _, lang in data])
    share = np.array([1 / (label == k).sum() for k in label])
    for k in range(3):
        target = np.where(label == k, 1.0, -1.0)
        a = features * np.sqrt(share)[:, None]
        # Ridge regression as least squares with rows of its own for the penalty.
        beta = np.linalg.lstsq(np.vstack([a, math.sqrt(langid.RIDGE) * np.eye(a.shape[1])]), np.append(target * np.sqrt(share), np.zeros(a.shape[1])), rcond=None)[0]
        mine = c @ model.weights[:-1, k] + model.weights[-1, k]
        assert np.abs(mine - features @ beta).max() < 2e-2
    names, scores = langid.Scorer(model)([t for t, _ in data])
    assert sum(a == b for a, (_, b) in zip(names, data, strict=True)) >= 0.97 * len(data) and ((scores > 0) & (scores <= 1)).all()


def test_statistics_by_hand():
    got = dict(zip(quality.FEATURES, quality.statistics("Ab ab ab, C1!\n\n|x| ab ab"), strict=True))
    text = "Ab ab ab, C1!\n\n|x| ab ab"
    assert got["log_chars"] == math.log1p(24) and got["log_words"] == math.log1p(7) and got["word_length"] == sum(map(len, text.split())) / 7
    assert got["distinct_words"] == 5 / 7 and got["repeats"] == 1 / 7 and got["lines"] == 3 / 7 and got["distinct_lines"] == 1.0
    assert got["line_length"] == 24 / 3 and got["bars"] == 2 / 24 and got["bangs"] == 1 / 24 and got["digits"] == 1 / 24 and got["capitals"] == 2 / 5
    share = [text.count(c) / 24 for c in set(text)]
    assert abs(got["byte_entropy"] + sum(p * math.log(p) for p in share)) < 1e-12
    assert quality.statistics("") == quality.statistics(None) == [0.0] * len(quality.FEATURES)


def plain_split(x, g, h):
    """Best (gain, feature, threshold) over all cuts between distinct values, by trying each."""
    best = (1e-6, None, None)
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.RIDGE)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < quality.LEAF:
                continue
            gain = score(left) + score(~left) - score(np.ones(len(x), bool))
            if gain > best[0] + 1e-9:
                best = gain, j, cut
    return best


def test_first_tree_against_trying_every_cut(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 1)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 4)).astype(np.float64)  # few values, so bins lose nothing
    y = ((x[:, 1] > 5) ^ (x[:, 2] > 8) ^ (rng.random(300) < 0.1)).astype(np.float64)
    forest, p = quality.fit(x, y), y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))

    def walk(node, rows, depth):
        gain, j, cut = plain_split(x[rows], g[rows], h[rows]) if depth < quality.DEPTH else (0, None, None)
        if j is None:
            assert forest.left[node] == node
            return
        left = rows & (x[:, forest.feature[node]] <= forest.threshold[node])
        right = rows & ~left
        mine = sum(g[r].sum() ** 2 / (h[r].sum() + quality.RIDGE) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + quality.RIDGE)
        assert abs(mine - gain) < 1e-9
        for child, own in ((forest.left[node], left), (forest.right[node], right)):
            assert abs(forest.value[child] - quality.RATE * g[own].sum() / (h[own].sum() + quality.RIDGE)) < 1e-9
            walk(child, own, depth + 1)

    walk(forest.root[0], np.ones(len(y), bool), 0)


def test_boosting_lowers_the_loss(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(np.float64)
    losses = []
    for n in (1, 5, 20, 60):
        monkeypatch.setattr(quality, "TREES", n)
        p = np.clip(quality.fit(x, y).score(x), 1e-9, 1 - 1e-9)
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2
