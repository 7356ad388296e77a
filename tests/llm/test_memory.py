"""Memory of the driver after a fit."""

import sys

import numpy as np
import psutil
import pytest

from kerf.llm import common, nbsvm


@pytest.mark.skipif(sys.platform != "linux", reason="the C library of Linux keeps what is freed")
def test_tidy_gives_freed_arrays_back(spark):
    own = psutil.Process().memory_info
    before = own().rss
    rows = [np.ones(1 << 13, np.uint8) for _ in range(1 << 14)]
    pins = rows[:: 1 << 10]
    del rows
    common.tidy(spark)
    assert len(pins) == 16 and own().rss - before < 40e6


def test_scoring_starts_after_the_fit_is_tidied(spark, monkeypatch):
    called = []
    monkeypatch.setattr(nbsvm, "tidy", called.append)
    model = nbsvm.Model(np.zeros(1 << nbsvm.BITS, np.float32), 0.0, 1.0, 0.0)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(r["score"] for r in nbsvm.score_texts(docs, model, nbsvm.token_ngrams).collect()) == [0.5, 0.5]
    assert called == [spark]
