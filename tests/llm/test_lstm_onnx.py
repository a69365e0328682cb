import time

import numpy as np
import pytest

from quaestor.llm import lstm_onnx
from quaestor.llm.lstm_crf import BiLstmCrf
from quaestor.llm.pii_model import LABELS, SYMBOLS, tag_windows, tagger, windows

TEXTS = ["Экономический рынок формирует когнитивное управление. " * 12, "Руководитель: Дарья Денисовна Драгляднина, тел. +7 (537) 597-21-01. " * 9, "И. о. декана: смотри стр. 5", "x"] * 40


def _batch(r, symbols, t_n, b):
    return r.integers(1, symbols, (t_n, b)), np.arange(t_n)[:, None] < np.sort(r.integers(1, t_n + 1, b))[::-1]


def _pieces():
    ids, spots = windows(TEXTS)
    return [ids[s + a : s + b] for _, a, b, s in spots]


@pytest.mark.skipif(not lstm_onnx.runtime(), reason="ONNX Runtime is not installed")
def test_graph_gives_the_emissions():
    for model, t_n, b in ((tagger(), 75, 40), (BiLstmCrf.fresh(50, 8, 5), 16, 3), (tagger(), 1, 2)):
        ids, mask = _batch(np.random.default_rng(5), len(model.p["pf"]), t_n, b)
        got, want = lstm_onnx.Emissions(model.p)(ids, mask), model.emissions(ids, mask)[0].transpose(2, 0, 1)
        assert np.abs(got - want)[:, mask].max() < 1e-4


def test_window_said_to_be_outside_has_no_label():
    r = np.random.default_rng(6)
    for _ in range(20):
        model = BiLstmCrf.fresh(30, 8, LABELS, int(r.integers(1000)))
        model.p["tr"][:] = r.normal(0, 2, (LABELS, LABELS))
        model.p["st"][:] = r.normal(0, 2, LABELS)
        mask = _batch(r, 30, 12, 400)[1]
        e = r.normal(0, 2, (LABELS, 12, 400)).astype(np.float32)
        e[0] += 12
        out, path = model.outside(e, mask), model.paths(e, mask)
        assert not (path * mask)[:, out].any()


def test_labels_are_those_of_every_path_looked_for():
    model, pieces = tagger(), _pieces()
    longest = max(map(len, pieces))
    ids, mask = np.zeros((longest, len(pieces)), np.int64), np.zeros((longest, len(pieces)), bool)
    for j, x in enumerate(pieces):
        ids[: len(x), j], mask[: len(x), j] = x, True
    want = model.decode(ids, mask)
    got = tag_windows(model, pieces)
    assert all((x == want[: len(x), j]).all() for j, x in enumerate(got)) and any(x.any() for x in got)
    plain = model.outside(model.scores(ids, mask), mask)
    assert plain.sum() > 0.8 * sum(not x.any() for x in got)


@pytest.mark.skipif(not lstm_onnx.runtime(), reason="ONNX Runtime is not installed")
def test_tagging_takes_at_most_two_thirds_of_the_numpy_steps():
    model, pieces = tagger(), [x for x in _pieces() if len(x) == 192][:256]
    ids = np.stack(pieces, 1)
    mask = np.ones(ids.shape, bool)

    def least(f) -> float:
        best = np.inf
        for _ in range(4):
            began = time.thread_time()
            f()
            best = min(best, time.thread_time() - began)
        return best

    assert SYMBOLS == len(model.p["pf"]) and least(lambda: tag_windows(model, pieces)) < 2 / 3 * least(lambda: model.decode(ids, mask))
