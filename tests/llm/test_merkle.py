"""Merkle manifests against a tree built level by level, in chunks that lie anyhow to the trees."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from spindle.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, digest int, path string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def siblings(tree, i, fanout):
    """[(place, others)] from a leaf to the root."""
    out = []
    for level in tree[:-1]:
        first = i - i % fanout
        run = level[first : first + fanout]
        out.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= fanout
    return out


def brute(rows, shown, fanout):
    """{(id, leaf): (subroot, root, proof, folded)}; ``shown`` makes what is presented of a row."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]], fanout)
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = defaultdict(list)
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i, fanout) + siblings(top, k, fanout)
            now = leaf(shown(r))
            for place, others in path:
                now = h(*others[:place], now, *others[place:])
            out[r[0], leaf(r)].append((trees[s][-1][0], top[-1][0], h(*[x for _, others in path for x in others]), now))
    return out


def made(rng, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(rng.randrange(3 * n) - n, s, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "ü" * rng.randint(0, 9), "x\n" * 3000]), 5, 6, "p") for _ in range(n)]
    return rows


@pytest.mark.parametrize("fanout,chunk", [(3, 4), (3, 7), (2, 5), (5, 1), (3, 4096)])
def test_audit_equals_brute_force(spark, fanout, chunk):
    rng = random.Random(fanout * 100 + chunk)
    rows = made(rng, {None: 5, "a": 1, "b": 28, "": 3, "ü": 2, "n": 81 if chunk > 1 else 9, "s": 10})
    rows += [rows[0]] * 4 + [(None, "b", None, None, None, 0, 0, "")] * 2
    tampered = (F.pmod(F.col("doc_id"), F.lit(2)) == 0) & F.col("doc_id").isNotNull()
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = M.audited(docs, COLUMNS, [*[F.col(c) for c in COLUMNS[:-1]], text], fanout=fanout, chunk_rows=chunk).collect()
    want = brute(rows, lambda r: (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[0] % 2 == 0 and r[4] else r, fanout)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id, r.leaf].append((r.subroot, r.root, r.proof, r.folded))
        assert r.verified == (r.folded == r.root)
    assert len(got) == len(rows)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r.verified for r in got} == {True, False}


def test_node_records_and_roots(spark):
    """Every inner node of the trees once, wherever it was completed; one partition, and none."""
    rows = [(i, f"s{i % 3}" if i < 90 else "s0", None, i, f"t{i}", 0, 0, "") for i in range(140)]
    docs = spark.createDataFrame(rows, SCHEMA)
    built = M.manifest(docs, "source", "doc_id", M.leaf_digest(*[F.col(c) for c in COLUMNS]), fanout=3, chunk_rows=6)
    starts, want, at = {}, set(), 0
    for s in ("s0", "s1", "s2"):
        leaves = [leaf(r) for r in sorted(rows) if r[1] == s]
        starts[s] = (at, levels(leaves, 3))
        want |= {(at, lv, i, x) for lv, level in enumerate(starts[s][1]) if lv for i, x in enumerate(level)}
        at += len(leaves)
    nodes = [(r.tree, r.level, r.idx, bytes(r.digest).hex()) for r in built.trees.nodes.collect()]
    assert len(nodes) == len(want) and set(nodes) == want
    assert {(r.partition, r.n_leaves, bytes(r.subroot).hex()) for r in built.subroots().collect()} == {(s, len(t[0]), t[-1][0]) for s, (_, t) in starts.items()}
    assert built.root.hex() == levels([starts[s][1][-1][0] for s in ("s0", "s1", "s2")], 3)[-1][0]
    one = docs.where("doc_id = 3")
    [r] = M.audited(one, COLUMNS, [F.col(c) for c in COLUMNS]).collect()
    assert (r.leaf, r.subroot, r.root, r.proof, r.folded, r.verified) == (leaf(rows[3]),) * 3 + (h(), leaf(rows[3]), True)
    none = M.audited(docs.limit(0), COLUMNS, [F.col(c) for c in COLUMNS])
    assert none.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded", "verified"] and none.count() == 0


def test_ranges_merge_at_any_border():
    """A tree of n leaves, grown in stretches, gives the same nodes as one grown at once; nothing is padded."""
    rng = random.Random(5)
    for n in [1, 2, 3, 4, 9, 10, 27, 28, *[rng.randint(1, 200) for _ in range(40)]]:
        fanout = rng.choice([2, 3, 4])
        leaves = [sha256(bytes([i % 256, n])).digest() for i in range(n)]
        whole = M.Mountains(n, fanout)
        want = {x for i, d in enumerate(leaves) for x in whole.push(0, i, d)}
        borders = sorted({0, n, *[rng.randint(0, n) for _ in range(4)]})
        peaks, got = [], []
        for a, b in zip(borders, borders[1:]):
            part = M.Mountains(n, fanout)
            for i in range(a, b):
                got += part.push(0, i, leaves[i])
            assert len(part.peaks) <= 2 * (fanout - 1) * len(part.widths)
            peaks += part.peaks
        merged = M.Mountains(n, fanout)
        for p in peaks:
            got += merged.push(*p)
        assert len(got) == len(set(got)) and set(got) == want and merged.peaks == whole.peaks and len(merged.peaks) == 1
