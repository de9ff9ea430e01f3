"""What round 4 found."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from tessarine.llm import lm


def scored(docs):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs).collect())


def test_a_filter_that_is_not_broadcast_writes_less_than_the_texts(spark, small, monkeypatch):
    """F1: what its scores need of the shared folder doesn't outgrow the texts, and they are the same."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole, paths = scored(docs), []

    def noted(df, label, materialize=lm.materialize):
        kept = materialize(df, label)
        paths.append(kept._tessarine_path)
        return kept

    monkeypatch.setattr(lm, "materialize", noted)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lm, "SLICE_TEXT", 1 << 14)
    assert scored(docs) == whole
    size = sum(os.path.getsize(os.path.join(at, f)) for p in paths for at, _, files in os.walk(p.removeprefix("file:")) for f in files if f.endswith(".parquet"))
    assert paths and size < 1.5 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_repeated_documents_of_a_slice_are_rows_of_their_own(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b a"), (None, None), (None, "a  c"), (2, ""), (3, " A\tb c" * 50)], "doc_id long, text string")
    docs = texts.crossJoin(spark.range(40)).drop("id")
    whole = scored(docs)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    assert len(whole) == 200 and scored(docs) == whole


def test_planes_keep_values():
    for values in (np.empty(0, np.uint64), np.array([0, 1, 2**63 + 5, 2**64 - 1], np.uint64)):
        assert (lm.of_planes(lm.planes(values)) == values).all()
