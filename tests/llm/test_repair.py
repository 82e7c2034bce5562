"""Conversation repair against all edits tried one by one, in chunks of any size."""

from __future__ import annotations

import random
import re
from functools import lru_cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from spindle.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos long, chunk int"


def brute(rows):
    """(cost, audit, turns): every edit of every turn and up to two turns added at each place."""
    seen, fates, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.strip(R.WHITE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        fates.append(fault)
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, shape, added):
        options = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape) else []
        rest = shape.removeprefix("s")
        short = shape[: len(shape) - len(rest)] + (rest if len(rest) < 3 else "u" if len(rest) % 2 else "ua")  # turns of the shape so far that matter

        def go(letter, cost, i2, role, text, added2):
            initials = (short + role[:1]) if role else short
            if role and not any(re.fullmatch("(s?(ua)+)?", initials + more) for more in ("", "a", "ua")):
                return
            c, a, t = best(i2, initials, added2)
            if c < 1 << 40:
                options.append((c + cost, letter + a, ((f"{role}:{text}",) if role is not None else ()) + t))

        if added < 2:
            for role in ("user", "assistant"):
                go("I", 5, i, role, "", added + 1)
        if i < len(rows):
            role, text = rows[i]
            go("D", 2, i + 1, None, None, 0)
            if fates[i] in (None, 2):
                more = 5 if fates[i] == 2 else 0
                if role:
                    go("K", more, i + 1, role, text, 0)
                for other in ("user", "assistant"):
                    go("R", 1 + more, i + 1, other, text, 0)
        return min(options, default=(1 << 40, "", ()))

    return *best(0, "", 0), counts


def shape_of(rng, n):
    texts = ["Yes.", "No!", "  ", "", "cut off", "Why?", "a.b"]
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "unknown", " "]), rng.choice(texts) + rng.choice(["", f"{i}."])) for i in range(n)]


def test_paths_equal_all_edits_tried():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, *[rng.randint(1, 7) for _ in range(150)]]:
        rows = shape_of(rng, n)
        cost, audit, turns, (blank, twice, cut) = brute(rows)
        seen, codes = set(), bytearray()
        for role, text in rows:
            bare = text.strip(R.WHITE)
            fate = R.GONE if not bare or (role, text) in seen else R.CUT if bare[-1] not in ".!?" else R.WHOLE
            seen.add((role, text))
            codes.append(R.INITIALS.get(role[:1], R.OTHER) + 4 * fate)
        assert R.solved(bytes(codes)) == (cost, audit), rows
        assert [x.decode() for x in R.repaired(audit, 0, rows)] == list(turns)


def test_buckets_equal_plain_relaxation():
    """Distances, and the way through a conversation that is cut anywhere."""
    rng = random.Random(2)
    for _ in range(60):
        codes = bytes(rng.randrange(12) for _ in range(rng.randint(1, 30)))
        n = len(codes)
        want = [R.FAR] * (4 * n) + list(R.END)
        for place in range(n - 1, -1, -1):
            for q in range(4):
                want[4 * place + q] = min(want[4 * place + 4 + to] + c for _, to, c in R.FORWARD[codes[place]][q])
            for _ in range(3):
                for q in range(4):
                    want[4 * place + q] = min(want[4 * place + q], want[4 * place + R.NEXT[q]] + R.INSERT)
        assert R.distances(codes) == want
        cut = rng.randint(0, n)
        cross = R.crossing(codes[:cut])
        assert [min(cross[4 * q + to] + want[4 * cut + to] for to in range(4)) for q in range(4)] == want[:4]
        left, state = R.walk(codes[:cut], R.distances(codes[:cut], tuple(want[4 * cut : 4 * cut + 4])), 0)
        right, state = R.walk(codes[cut:], R.distances(codes[cut:]), state)
        assert (want[0], left + right + R.closing(state)) == R.solved(codes)


@pytest.mark.parametrize("chunk_rows,chunk_bytes", [(2, 1 << 20), (7, 1 << 20), (2048, 40), (2048, 8 << 20)])
def test_repair(spark, chunk_rows, chunk_bytes):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in [*range(25), None]:
        made = shape_of(rng, 60 if conv == 7 else rng.randint(1, 9))
        numbers = sorted((None if rng.random() < 0.1 else rng.randint(0, 12) for _ in made), key=lambda t: (t is not None, t))
        turns = sorted(zip(numbers, made), key=lambda x: (x[0] is not None, x[0], x[1][0], sha256(x[1][1].encode()).digest()))
        rows += [(conv, t, None if role == " " else role, None if text == " " else text, "x", 0, 1) for t, (role, text) in turns]
        ordered = [x for _, x in turns]
        cost, audit, lines, counts = brute(ordered)
        known = [t for t, _ in turns if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(ordered, ordered[1:]))
        want[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).digest())
    rows.append((99, 1, "user", "gone", "x", 0, 1))
    want[99] = (0, 0, 0, 0, 0, 0, "", sha256(b"").digest())
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = R.repair(turns, there=~F.col("conv_id").eqNullSafe(F.lit(99)), chunk_rows=chunk_rows, chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(want)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, bytes(r.repaired)) for r in got} == want


def test_damage_and_edges(spark):
    none = R.repair(R.damaged(spark.createDataFrame([], SCHEMA)), there=F.col("_there"))
    assert none.count() == 0
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "Text of. It!" * (20_000 if t == 3 else 1) + str(t) + ".", "", 0, 0) for c in range(40) for t in range(6)]
    got = R.damaged(spark.createDataFrame(rows + [(None, None, None, None, None, None, None)], SCHEMA)).collect()
    import zlib

    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        mine = [r for r in got if r.conv_id == c and r.turn == t]
        assert len(mine) == (2 if kind == 3 else 1) and all(r["_there"] == (kind != 0) for r in mine)
        assert all(r.role == ("user" if kind == 4 else role) for r in mine)
        assert all(r.text == ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text) for r in mine)
    assert [(r.role, r.text) for r in got if r.conv_id is None and r["_there"]] in ([], [(" ", " ")], [(" ", " ")] * 2, [("user", " ")], [(" ", "")])
    one = R.repair(spark.createDataFrame([(1, None, "user", "Hi.", None, None, None)] * 50, SCHEMA), chunk_rows=3).collect()
    assert [(r.duplicate, r.gaps, r.audit) for r in one] == [(49, 0, "D" * 50)]
    hot = R.repair(spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"Hi {t}.", "", 0, 0) for t in range(600)] + [(2, 0, "user", "x", "", 0, 0)], SCHEMA).repartition(5), chunk_rows=16)
    assert sorted((r.conv_id, r.cost, r.audit) for r in hot.collect()) == [(1, 0, "K" * 600), (2, 2, "D")]
