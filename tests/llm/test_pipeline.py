"""The pipeline's rows against plain Python over the same model."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import bpe, features, toxicity

from .test_operators import brute_links, brute_mix


def test_run_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r, s in zip(rows, toxicity.scores(model, pa.array([t for _, t, _ in rows])), strict=True) if s < toxicity.THRESHOLD]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = sorted(min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values())
    _, root = brute_links([t for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    held, sizes, target = brute_mix(rows)
    copies = {}
    for s, own in held.items():
        start, goal = 0, round(target[s])
        for _, i, n in sorted(own):
            copies[i] = sum(n > 0 and 2 * min(max(goal - start - p * sizes[s], 0), n) >= n for p in (0, 1))
            start += n
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in rows:
        ids = own.encode_ordinary(t)
        if copies[i]:
            want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] = copies[i]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want and want


def test_stages_keep_the_columns_and_take_empty_and_odd_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "", None, None, 0)], docs.schema)
    for frame in (docs.limit(0), odd):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.written(stage(spark, now, small), "odd")
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, small).count()


def test_the_driver_does_not_fit_the_toxicity_model(spark, small, monkeypatch):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    want = toxicity.fit(features.sample(docs, labels, "toxic", toxicity.SAMPLE, features.held_out(F.col("doc_id"), 3, 1)))

    def refused(rows):
        raise AssertionError("fitted by the driver")

    monkeypatch.setattr(toxicity, "fit", refused)
    got = toxicity.fit_toxicity(docs, labels)
    assert got.rows.any() and np.allclose(got.rows, want.rows, atol=1e-6) and (got.bias, got.length) == pytest.approx((want.bias, want.length))
