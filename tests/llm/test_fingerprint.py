"""Fingerprints against plain minima and true similarities, edited texts against slices of the whole table."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.llm import fingerprint as P
from spindle.llm.textkernel import shingles

SCHEMA = "doc_id long, text string, part int, kind string, fingerprint long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def jaccard(a, b, k=5):
    a, b = set(shingles(a.encode(), k).tolist()), set(shingles(b.encode(), k).tolist())
    return len(a & b) / max(len(a | b), 1)


def test_bins_hold_minima_and_donors_are_fixed():
    scheme = P.Scheme(bins=64, bits=8)
    rng = random.Random(1)
    for n in (1, 3, 40, 900):
        hashes = shingles(prose(rng, n).encode(), 5)
        want = {}
        for x in hashes.tolist():
            want[x >> 58] = min(want.get(x >> 58, 1 << 64), x)
        full, value = scheme.minima(hashes)
        assert dict(zip(full.tolist(), value.tolist())) == want
        dense = scheme.dense(full, value).tolist()
        for i in range(64):
            donor = min(want, key=lambda j: scheme.orders[i][j])
            assert dense[i] == want.get(i, want[donor])
    assert sorted(scheme.orders[7].tolist()) == list(range(64))


@pytest.mark.parametrize("bins,bits", [(512, 4), (1024, 2), (256, 8), (2048, 1)])
def test_estimates_are_unbiased(bins, bits):
    """Long and sparse texts; the mean error of many pairs is near 0, a single one within some standard errors."""
    scheme = P.Scheme(bins=bins, bits=bits)
    rng = random.Random(bins)
    assert len(scheme.of(prose(rng, 30))) == bins * bits // 8
    for n, spread in ((900, 0.12), (60, 0.45)):
        errors = []
        for i in range(60):
            text = prose(rng, n)
            cut = rng.randint(n // 8, n // 2)
            other = " ".join([*text.split()[:-cut], prose(rng, cut)])
            errors.append(scheme.likeness(scheme.of(text), scheme.of(other)) - jaccard(text, other))
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < spread
    apart = [scheme.likeness(scheme.of(prose(rng, 200)), scheme.of(prose(rng, 3))) for _ in range(20)]
    assert max(apart) < 0.2 and np.mean(apart) < 0.05


def test_edited_documents(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(60)] + ["", None, "  \n", "ein Wort", "ü" * 20, "Same text " * 9, "Same text " * 9, prose(rng, 40_000)]
    rows = [(3 * i + 1, t, 1, "k", 2) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in P.edit_likeness(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    scheme = P.Scheme()
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (doc, text, *_) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(changed.encode()).hexdigest())
        assert (bytes(r.fingerprint), bytes(r.edited_fingerprint)) == (scheme.of(text), scheme.of(changed))
        assert r.near_edited == scheme.likeness(scheme.of(text), scheme.of(changed)) and r.near_next == scheme.likeness(scheme.of(text), scheme.of(following))
        if len(text.split()) > 60 and len(following) > n:
            assert abs(r.near_edited - jaccard(text, changed)) < 0.2 and r.near_next < 0.1
    same = [bytes(r.fingerprint) for r in got.values() if r.doc_id in [3 * i + 1 for i, t in enumerate(texts) if t == "Same text " * 9]]
    assert len(same) == 2 and len(set(same)) == 1


def test_edges(spark):
    scheme = P.Scheme()
    assert scheme.of(None) == scheme.of("") == scheme.of(" \t") == b"" and scheme.likeness(b"", b"") == 1 and scheme.likeness(b"", scheme.of("a")) == 0
    assert scheme.of("Some WORDS here") == scheme.of("some words\nhere") and scheme.likeness(scheme.of("a b"), scheme.of("a b")) == 1
    with pytest.raises(ValueError):
        P.Scheme(bins=100)
    none = P.edit_likeness(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "doc_id"
    [one] = P.edit_likeness(spark.createDataFrame([(1, "a b c d e f", 0, "", 0)], SCHEMA)).collect()  # its own next
    assert one.edited_sha256 == sha256(b"a b c d a b").hexdigest() and one.near_next == 1
    rows = [(None, "x y z", 0, "", 0)] * 30 + [(5, f"row {i}", 0, "", 0) for i in range(30)]
    got = P.edit_likeness(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 60 and sum(r.doc_id is None for r in got) == 30 and sum(r.near_next == 1 for r in got if r.doc_id is None) == 29
    both = P.fingerprints(spark.createDataFrame(rows, SCHEMA)).withColumn("same", P.likeness(F.col("fingerprint"), F.col("fingerprint")))
    assert {r.same for r in both.collect()} == {1.0}
