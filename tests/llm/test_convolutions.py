"""The classifiers' fast paths against plain convolutions of the same model, and texts that must not depend on their neighbours."""

from __future__ import annotations

import numpy as np

from firnspark.llm import langid, toxicity


def toxic_model(seed):
    rng = np.random.default_rng(seed)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    model = toxicity.Model(
        rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)), [rng.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        rng.normal(0, 0.5, n), rng.normal(0, 0.2, n), 0.1, np.array([0.4, 0.6]), rng.normal(0, 1, (toxicity.BUCKETS, 1)),
    )
    model.embedding[0] = model.votes[0] = 0
    return model


def plain_raw(model, rows):
    """A text's words and padding behind them, window by window."""
    v = [model.embedding[r] for r in rows] + [np.zeros(toxicity.DIM)] * (2 * max(toxicity.WIDTHS))
    features = [max(sum(v[p + k] @ f[k][:, c] for k in range(w)) for p in range(len(rows) + 1)) for w, f in zip(toxicity.WIDTHS, model.filters, strict=True) for c in range(toxicity.FILTERS)]
    x = float(np.maximum(np.array(features) + model.bias, 0) @ model.out + model.out_bias)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


TEXTS = ["one", "", "Two words", "a b c d e f g", " \n", "x " * 300, "One", "é à ü", "b3 b4", "a b c d e f g h"]


def test_toxicity_against_a_plain_convolution(monkeypatch):
    for seed in range(3):
        model = toxic_model(seed)
        rows = [toxicity.token_rows(t) for t in TEXTS]
        want = [plain_raw(model, r) for r in rows]
        for chunk in (toxicity.CHUNK, 3):
            monkeypatch.setattr(toxicity, "CHUNK", chunk)
            np.testing.assert_allclose(toxicity.raw_scores(model, rows), want, rtol=1e-4, atol=1e-5)
            scorer = toxicity.Scorer(model, 0.7)
            group = [1 if len(r) else 0 for r in rows]
            scaled = [toxicity.calibrated(x, model.thresholds[g], 0.7) for x, g in zip(want, group, strict=True)]
            for order in (range(len(TEXTS)), reversed(range(len(TEXTS))), [3, 1, 3, 8]):
                own = list(order)
                np.testing.assert_allclose(scorer([TEXTS[k].encode() for k in own]), [scaled[k] for k in own], rtol=1e-4, atol=1e-5)


def test_toxicity_learns_from_each_text_alone():
    """One text whose second half is another's first: what is learned doesn't reach across."""
    rows = [toxicity.token_rows(t) for t in ("good day to all", "bad words in here", "good day again", "so bad words again")] * 12
    labels = np.array([0, 1, 0, 1] * 12)
    raw = toxicity.raw_scores(toxicity.train(rows, labels, epochs=30), rows)
    assert (raw[labels == 1] > 0.7).all() and (raw[labels == 0] < 0.3).all()


def test_language_against_a_plain_convolution():
    rng = np.random.default_rng(1)
    n = langid.FILTERS * len(langid.WIDTHS)
    model = langid.Model(["aa", "bb", "cc"], [rng.normal(0, 0.5, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], rng.normal(0, 0.3, n), rng.normal(0, 0.3, (n, 3)), rng.normal(0, 0.1, 3))
    texts = ["One text", "", "x", "Ünïcode " * 90, "12 34", "z" * langid.WINDOW, "z" * (langid.WINDOW + 1)]

    def plain(text):
        data = text.encode().lower()
        data += b" " * (-len(data) % langid.WINDOW or (0 if data else langid.WINDOW))
        out = []
        for lo in range(0, len(data), langid.WINDOW):
            x = data[lo : lo + langid.WINDOW]
            features = [max(sum(f[k][x[p + k], c] for k in range(w)) for p in range(len(x) - w + 1)) for w, f in zip(langid.WIDTHS, model.filters, strict=True) for c in range(langid.FILTERS)]
            y = np.maximum(np.array(features) + model.bias, 0) @ model.out + model.out_bias
            out.append(np.exp(y - y.max()) / np.exp(y - y.max()).sum())
        return np.mean(out, axis=0)

    names, scores = langid.Predictor(model)([t.encode() for t in texts])
    want = [plain(t) for t in texts]
    assert names == [model.languages[int(w.argmax())] if any(c.isalpha() for c in t) else "und" for t, w in zip(texts, want, strict=True)]
    np.testing.assert_allclose(scores, [w.max() if any(c.isalpha() for c in t) else 0.0 for t, w in zip(texts, want, strict=True)], rtol=1e-4, atol=1e-6)
