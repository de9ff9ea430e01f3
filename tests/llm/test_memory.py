"""What a Python worker holds while it goes through texts."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tessarine.llm import lm


@pytest.fixture
def texts():
    """Batches of 2 MB of text, about 360,000 words of 100,000; what is held when each is asked for."""
    held, words = [], np.array([f"{i:05d}" for i in range(100_000)])

    def batches(n):
        rng = np.random.default_rng(3)
        for i in range(n):
            held.append(tracemalloc.get_traced_memory()[0])
            yield pa.record_batch([pa.array(np.arange(60) + 60 * i), pa.array([" ".join(words[rng.integers(0, len(words), 6000)]) for _ in range(60)])], ["doc_id", "text"])
        held.append(tracemalloc.get_traced_memory()[0])

    tracemalloc.start()
    yield batches, held
    tracemalloc.stop()


def test_count_holds_no_slice_while_the_next_is_read(texts):
    """Of a counted batch nothing but its result, 12 bytes a key, is held when the next one is read; counting takes at most 100 bytes a token."""
    batches, held = texts
    list(lm._count(32)(batches(1)))
    held.clear()
    tracemalloc.reset_peak()
    for _ in lm._count(32)(batches(3)):
        pass
    assert max(held) - held[0] < 12 << 20
    assert tracemalloc.get_traced_memory()[1] - held[0] < 360_000 * 100


def test_score_holds_no_slice_while_the_next_is_read(texts, monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(lm, "RECALLED_BITS", 10)
    batches, held = texts
    keys = np.sort(np.random.default_rng(4).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    bits = lm.segment_bits(keys, np.ones(1000, np.int64))
    shared = SimpleNamespace(value=lm.Recalled(lm.CountFilter(bits, np.array([8 * len(bits)]))))
    hot = SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0)))
    score = lambda n: sum(r.num_rows for r in lm._score(shared, hot, lm.Smoothing(10**6, 10**5), 1e6)(batches(n)))
    assert score(1) >= 60
    held.clear()
    assert score(3) >= 180
    assert max(held) - held[0] < 2 << 20


def test_tally_counts_each_key():
    for keys in ([], [7], [3, 1, 3, 2**63, 1, 3]):
        got, n = lm.tally(np.array(keys, np.uint64))
        assert dict(zip(got.tolist(), n.tolist(), strict=True)) == {k: keys.count(k) for k in keys} and (np.diff(got.astype(object)) > 0).all()
