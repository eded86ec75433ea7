"""Weights of the language model: stored once below the shared folder, not in what Spark sends to every executor."""

import random

import numpy as np
import pytest
from pyspark import cloudpickle

from tapestudy.llm import lm


@pytest.fixture
def docs(spark):
    r = random.Random(8)
    return spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(80))) for i in range(240)], "doc_id bigint, text string").repartition(6)


@pytest.fixture
def sent(monkeypatch):
    """Sizes of the functions that go to the tasks."""
    sizes = []

    def noted(make):
        def wrap(*args):
            run = make(*args)
            sizes.append(len(cloudpickle.dumps(run)))
            return run
        return wrap

    monkeypatch.setattr(lm, "_follow_gradient", noted(lm._follow_gradient))
    return sizes


def test_weights_stay_out_of_the_functions(docs, sent):
    counts = np.full(lm.CLASSES, 10**5)
    lm.train_classes(docs, lm.Classes([b"a", b"bb"]), counts, size=1 << 15)
    assert len(sent) == 2 and max(sent) < 200_000  # 8.5 MB with the weights


def test_stored_weights(docs):
    """Both rounds move the weights, tasks read what the round before has stored, and few tasks send changes of a small corpus."""
    counts, classes, size = np.full(lm.CLASSES, 300), lm.Classes([b"a", b"bb"]), 1 << 13
    one, _ = lm.train_classes(docs, classes, counts, rounds=1, size=size)
    two, bias = lm.train_classes(docs, classes, counts, size=size)
    first, second = (lm._stored(x, size) for x in (one, two))
    assert first.shape == second.shape == (size, lm.CLASSES) and np.isfinite(second).all()
    assert (first != 0).any() and (second != 0).any() and not lm._stored(None, size).any()
    batch = docs.where("doc_id < 9").toArrow().to_batches()
    again = list(lm._follow_gradient(two, size, bias, classes, 1e-6)(batch))  # hardly moves: what is sent is a change
    assert again and all(np.abs(np.frombuffer(b.column("change")[0].as_py(), np.float16)).max() < 1e-2 for b in again)


def test_row_sums():
    r = np.random.default_rng(5)
    for n in (1, 7, 900, 1024):
        rows, g = r.zipf(1.3, (4, n)).clip(1, 8000).astype(np.uint16), r.normal(size=(n, lm.CLASSES)).astype(np.float32)
        for of, (unique, total) in zip(rows, lm._row_sums(g, rows), strict=True):
            want = np.unique(of)
            assert unique.tolist() == want.tolist()
            assert np.allclose(total, [g[of == x].sum(axis=0) for x in want], atol=1e-3)
