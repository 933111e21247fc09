"""What spares decontamination work, held against the plain way."""

import numpy as np
from corvane.llm import decontaminate


def test_a_span_with_too_few_words_costs_no_sums(monkeypatch):
    item, has = np.arange(1, 21, dtype="<u4"), np.arange(60) < 21
    has[0] = False
    text = np.concatenate((np.arange(1, 10), np.arange(30, 50))).astype("<u4")  # nine of twenty words
    nothing = np.zeros(0, "<u4")

    def refuse(*_a, **_b):
        raise AssertionError("sums over a span that can hold no leak")

    with monkeypatch.context() as m:
        m.setattr(decontaminate.np, "cumsum", refuse)
        assert decontaminate.best_window(text, 0, len(text), item, has, nothing) == (0.0, 0, False)
    assert decontaminate.best_window(np.concatenate((text[9:], item)), 0, 40, item, has, item[-2:])[0] == 1.0


def test_products_of_rows_of_any_length():
    rng = np.random.default_rng(3)
    weights = np.concatenate(([0.0], rng.random(49) + 0.5))
    texts = [rng.integers(0, 50, n).astype("<u4") for n in [0, 1, 2, 3, 24, 48, 49, 200, 5, 1000]]
    rows, basis = decontaminate.Passages(texts, weights), rng.random((50, 7)).astype(np.float32)
    dense, at = np.zeros((len(rows.sizes), 50)), 0
    for k, n in enumerate(rows.sizes.tolist()):
        dense[k, rows.terms[at : at + n]] = rows.values[at : at + n]
        at += n
    assert len(set(rows.sizes.tolist())) > 3
    made = np.concatenate([rows.times(basis, *c) for c in rows.chunks()])
    np.testing.assert_allclose(made, dense @ basis, rtol=1e-5)
    own = np.bincount(rows.ones[2], minlength=50)[:, None] * basis
    np.testing.assert_allclose(rows.gram(basis), dense.T @ dense @ basis + own, rtol=1e-4)
