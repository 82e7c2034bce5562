"""Conversation structure repair by shortest paths.

A conversation's turns have faults (blank, repeated, cut off) and roles that may not alternate.  The
cheapest edits that give the role initials ``(s?(ua)+)?`` are a shortest path in a small graph: a node is a
place between turns and a state (nothing yet, after the system's, the user's, the assistant's turn); arcs
keep, rerole or delete the next turn, or insert an empty one.  Costs are small integers, so Dial's
buckets serve as the queue: a wheel of lists, one for each distance that may still come, settles the nodes from the
end of the conversation backwards.  The recorded distances tell the tight arcs, those that lie on a
shortest path, and the audit takes the first of them by letter from the start on: D, I, K, R.

Turns are sorted by ranges and cut into chunks bounded by rows and by bytes.  Conversations that lie
within a chunk are repaired there.  A chunk's first and last conversation may go on beyond it; of a stretch
only these go on:

* the distances from each state before the stretch to each state after it (buckets again), from which a
  conversation's stretches get the distances behind each of them, right to left;
* the state in which the walk over the tight arcs leaves the stretch, for each state at its start, from
  which the stretches get their first state, left to right;
* then every stretch walks by itself, and its audit and its repaired turns are joined in order.

A task thus holds a chunk's turns, or 16 distances for each chunk of one conversation.  The digest of a conversation
that spans chunks is computed from its stretches as they stream by, one at a time.

Defined cases: null roles and texts count as one space, null turn numbers come first, turns of one
number in the order of role and the text's sha256; rows without a conversation form one; a repeated row is a duplicate;
roles count by their first character, so that "unknown" may stand for a user; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WHITE, bounded_batches, staged, widened

# Role classes and what may become of a turn; a turn's code is class + 4 * fate.
S, U, A, OTHER = range(4)
WHOLE, GONE, CUT = range(3)
INITIALS = {"s": S, "u": U, "a": A}
ROLES = {2: b"user", 3: b"assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: The state after an added or reroled turn, for each state; and after a kept one, by class (-1: not allowed).
NEXT = (2, 2, 3, 2)
KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: Costs of ending in each state.
END = (0, 2 * INSERT, INSERT, 0)
WHEEL = 16
FAR = 1 << 60


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of a turn's arcs, by letter."""
    kind, fate = code % 4, code // 4
    more = TRUNCATED if fate == CUT else 0
    out = [("D", q, q, DELETE) for q in range(4)]
    if fate != GONE:
        out += [("K", q, KEEP[kind][q], more) for q in range(4) if KEEP[kind][q] >= 0]
        out += [("R", q, NEXT[q], REROLE + more) for q in range(4)]
    return out


#: By code and state: arcs forwards (letter, state after, cost), and backwards (state before, cost).
FORWARD = [[[(a, to, c) for a, q, to, c in _arcs(code) if q == at] for at in range(4)] for code in range(12)]
BACKWARD = [[[(q, c) for _, q, to, c in _arcs(code) if to == at] for at in range(4)] for code in range(12)]
ADDED = [[q for q in range(4) if NEXT[q] == at] for at in range(4)]


def distances(codes: bytes, behind: tuple[int, ...] = END, start: int | None = None) -> list[int]:
    """Distances to the end from (place, state), at 4 * place + state; ``behind`` has those of the last place.

    With ``start``, what is farther than that state at the first place is left out (FAR).
    """
    n = len(codes)
    dist, wheel, open_ = [FAR] * (4 * n + 4), [[] for _ in range(WHEEL)], 0
    least = min(behind)
    for q, d in enumerate(behind):
        if d < FAR:
            dist[4 * n + q] = d
            wheel[d % WHEEL].append(4 * n + q)
            open_ += 1
    now = least
    while open_:
        bucket = wheel[now % WHEEL]
        while bucket:
            node = bucket.pop()
            open_ -= 1
            if dist[node] != now:
                continue  # it was settled from a nearer bucket
            place, q = node >> 2, node & 3
            if place < n:
                far = now + INSERT
                for before in ADDED[q]:
                    other = 4 * place + before
                    if far < dist[other]:
                        dist[other] = far
                        wheel[far % WHEEL].append(other)
                        open_ += 1
            if place:
                for before, cost in BACKWARD[codes[place - 1]][q]:
                    other, far = 4 * place - 4 + before, now + cost
                    if far < dist[other]:
                        dist[other] = far
                        wheel[far % WHEEL].append(other)
                        open_ += 1
        if start is not None and dist[start] <= now:
            break
        now += 1
    return dist


def walk(codes: bytes, dist: list[int], state: int) -> tuple[str, int]:
    """(letters, state at the end) along the first tight arcs."""
    out = []
    for place, code in enumerate(codes):
        while True:
            here = dist[4 * place + state]
            after = 4 * place + 4
            for letter, to, cost in FORWARD[code][state]:
                if letter != "D" and dist[4 * place + NEXT[state]] + INSERT == here:
                    out.append("I")
                    state = NEXT[state]
                    break
                if dist[after + to] + cost == here:
                    out.append(letter)
                    state = to
                    break
            else:  # a turn that must go has no arc after D
                out.append("I")
                state = NEXT[state]
            if out[-1] != "I":
                break
    return "".join(out), state


def closing(state: int) -> str:
    return "I" * (END[state] // INSERT)


@lru_cache(maxsize=50_000)
def solved(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    dist = distances(codes, END, 0)
    audit, state = walk(codes, dist, 0)
    return dist[0], audit + closing(state)


def crossing(codes: bytes) -> list[int]:
    """Distances from each state before the turns (rows) to each behind them, without turns added at the end."""
    out = [[0] * 4 for _ in range(4)]
    for to in range(4):
        dist = distances(codes, tuple(0 if q == to else FAR for q in range(4)))
        for q in range(4):
            out[q][to] = dist[q]
    return [x for row in out for x in row]


def repaired(audit: str, state: int, lines: list[tuple[str, str]]) -> list[bytes]:
    """The turns ``role:text`` that the audit makes of ``lines``."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
        elif letter == "K":
            role, text = lines[at]
            out.append(f"{role}:{text}".encode())
            state = KEEP[INITIALS.get(role[:1], OTHER)][state]
            at += 1
        else:
            state = NEXT[state]
            text = b""
            if letter == "R":
                text = lines[at][1].encode()
                at += 1
            out.append(ROLES[state] + b":" + text)
    return out


LEGAL = {(S, U), (U, A), (A, U)}


def illegal_pairs(codes: bytes) -> int:
    return sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:]))


# ---------------------------------------------------------------- turns in chunks


def turns_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None = None) -> DataFrame:
    """Rows with what a turn's fate needs; those that aren't ``there`` only stand for their conversation."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    bare = F.rtrim(text, F.lit(WHITE))
    kind = F.coalesce(*[F.when(F.substring(role, 1, 1) == c, F.lit(n)) for c, n in INITIALS.items()], F.lit(OTHER))
    fate = F.when(bare == "", GONE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(WHOLE)
    return turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")).alias("key"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), (kind + 4 * fate).cast("int").alias("code"),
        (F.lit(True) if there is None else F.coalesce(there, F.lit(True))).alias("there"), F.monotonically_increasing_id().alias("nth"),
    )


def _cut(rows: int, size: int):
    """Numbers a sorted partition's rows and cuts them into chunks of so many rows or bytes."""

    def run(batches):
        base, chunk, at, n, held = TaskContext.get().partitionId() << 33, 0, 0, 0, 0
        for batch in batches:
            lengths = batch.column("text").cast(pa.binary())
            chunks = np.empty(batch.num_rows, np.int64)
            for i, b in enumerate(pc.binary_length(lengths).to_pylist()):
                if n >= rows or held + b > size and n:
                    chunk, n, held = chunk + 1, 0, 0
                n, held = n + 1, held + b
                chunks[i] = base + chunk
            pos = base + at + np.arange(batch.num_rows, dtype=np.int64)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos), pa.array(chunks)], [*batch.schema.names, "pos", "chunk"])

    return run


STRETCH = (
    "key string, conv {conv}, chunk long, seq int, open boolean, low long, high long, numbers long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired binary, first int, last int, codes binary, cross array<long>, roles array<string>, texts array<string>"
)


def _stretches(schema: pa.Schema):
    """A chunk's conversations: repaired, or of the first and last one, which may go on, what the next passes need."""
    names = schema.names

    def run(key: tuple, table: pa.Table, firsts: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        seen = set(firsts.column("pos").to_pylist())
        keys, conv, turn, role, text, code, there, pos = (table.column(c).to_pylist() for c in ("key", "conv", "turn", "role", "text", "code", "there", "pos"))
        chunk = table.column("chunk")[0].as_py()
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        out = []
        for seq, (a, b) in enumerate(zip(starts, [*starts[1:], len(keys)])):
            rows = [i for i in range(a, b) if there[i]]
            codes, blank, twice, cut = bytearray(), 0, 0, 0
            for i in rows:
                kind, fate = code[i] % 4, code[i] // 4
                if fate == GONE:
                    blank += 1
                elif pos[i] not in seen:
                    fate, twice = GONE, twice + 1
                elif fate == CUT:
                    cut += 1
                codes.append(kind + 4 * fate)
            codes = bytes(codes)
            numbers = [turn[i] for i in rows if turn[i] is not None]
            made = {
                "key": keys[a], "conv": conv[a], "chunk": chunk, "seq": seq, "open": seq == 0 or b == len(keys), "low": min(numbers, default=None), "high": max(numbers, default=None),
                "numbers": len(set(numbers)), "blank": blank, "duplicate": twice, "truncated": cut, "illegal": illegal_pairs(codes),
            }
            if made["open"]:
                made |= {"first": codes[0] % 4 if codes else None, "last": codes[-1] % 4 if codes else None, "codes": codes, "cross": crossing(codes), "roles": [role[i] for i in rows], "texts": [text[i] for i in rows]}
            else:
                cost, audit = solved(codes) if len(codes) <= 64 else solved.__wrapped__(codes)
                made |= {"cost": cost, "audit": audit, "repaired": sha256(b"\n".join(repaired(audit, 0, [(role[i], text[i]) for i in rows]))).digest()}
            out.append(made)
        return pa.Table.from_pylist([{n: m.get(n) for n in names} for m in out], schema=schema)

    return run


# ---------------------------------------------------------------- conversations beyond a chunk


def _behind(table: pa.Table) -> pa.Table:
    """Distances behind each stretch of a conversation, from its last stretch on."""
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("seq").to_pylist(), table.column("cross").to_pylist()), reverse=True)
    dist, out = np.array(END, np.int64), []
    for chunk, seq, cross in rows:
        out.append((chunk, seq, dist.tolist()))
        dist = (np.array(cross, np.int64).reshape(4, 4) + dist).min(axis=1)
    chunks, seqs, dists = zip(*out)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "seq": pa.array(seqs, pa.int32()), "behind": pa.array(dists, pa.list_(pa.int64()))})


def _leaving(batches):
    """The state in which the walk leaves a stretch, for each state before it."""
    for batch in batches:
        out = []
        for codes, behind in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist()):
            dist = distances(codes, tuple(behind))
            out.append([walk(codes, dist, q)[1] for q in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), batch.column("seq"), pa.array(out, pa.list_(pa.int32()))], ["key", "chunk", "seq", "leaves"])


def _entering(table: pa.Table) -> pa.Table:
    """The state before each stretch of a conversation, and whether it is the last."""
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("seq").to_pylist(), table.column("leaves").to_pylist()))
    state, out = 0, []
    for i, (chunk, seq, leaves) in enumerate(rows):
        out.append((chunk, seq, state, i == len(rows) - 1))
        state = leaves[state]
    chunks, seqs, states, ends = zip(*out)
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "seq": pa.array(seqs, pa.int32()), "state": pa.array(states, pa.int32()), "ends": pa.array(ends, pa.bool_())})


def _walks(batches):
    for batch in batches:
        audits, pieces, costs = [], [], []
        for codes, behind, state, ends, roles, texts in zip(*[batch.column(c).to_pylist() for c in ("codes", "behind", "state", "ends", "roles", "texts")]):
            dist = distances(codes, tuple(behind))
            audit, after = walk(codes, dist, state)
            audit += closing(after) if ends else ""
            audits.append(audit)
            pieces.append(b"".join(b"\n" + x for x in repaired(audit, state, list(zip(roles, texts)))))
            costs.append(dist[state])
        kept = [c for c in batch.schema.names if c not in ("codes", "behind", "state", "ends", "roles", "texts", "cost", "audit", "repaired")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(pieces, pa.binary())], [*kept, "cost", "audit", "repaired"])


RESULT = ["key", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def _joined(schema: pa.Schema):
    """Conversations from their stretches in order, one stretch at a time."""

    def run(batches):
        held, hashed, audit = None, None, []

        def done():
            held["audit"], held["repaired"] = "".join(audit), hashed.digest()
            held["gaps"] = held["high"] - held["low"] + 1 - held["numbers"] if held["low"] is not None else 0
            return pa.RecordBatch.from_pylist([{c: held[c] for c in RESULT}], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held["key"] != r["key"]:
                    if held is not None:
                        yield done()
                    held, hashed, audit, piece = r, sha256(), [r["audit"]], r["repaired"][1:]
                    empty = not r["repaired"]
                else:
                    for c in ("blank", "duplicate", "truncated", "illegal"):
                        held[c] += r[c]
                    if held["last"] is not None and r["first"] is not None:
                        held["illegal"] += (held["last"], r["first"]) not in LEGAL
                    if r["last"] is not None:
                        held["last"] = r["last"]
                    if r["low"] is not None:
                        held["numbers"] += r["numbers"] - (held["high"] == r["low"])
                        held["low"], held["high"] = r["low"] if held["low"] is None else held["low"], r["high"]
                    audit.append(r["audit"])
                    piece = r["repaired"][1:] if empty else r["repaired"]
                    empty = empty and not r["repaired"]
                hashed.update(piece)
        if held is not None:
            yield done()

    return run


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there: Column | None = None,
    chunk_rows: int = 2048,
    chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: the sha256 of the repaired turns), a row for each conversation.

    Rows for which ``there`` is false are no turns; they only make their conversation appear.
    """
    bounded_batches(turns.sparkSession, 1000)
    rows = turns_of(turns, conv_col, turn_col, role_col, text_col, there)
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest", "nth"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
    rows = staged(rows.mapInArrow(_cut(chunk_rows, chunk_bytes), widened(rows.schema, pos="long", chunk="long")), "repair-turns")
    firsts = rows.where("there").groupBy("key", "role", "digest").agg(F.min(F.struct("pos", "chunk")).alias("x")).select("x.pos", "x.chunk")
    schema = STRETCH.format(conv=rows.schema["conv"].dataType.simpleString())
    arrow = to_arrow_schema(turns.sparkSession.createDataFrame([], schema).schema)
    made = rows.drop("digest").groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(_stretches(arrow), schema)
    made = staged(made, "repair-stretches")
    gaps = F.when(F.col("low").isNotNull(), F.col("high") - F.col("low") + 1 - F.col("numbers")).otherwise(0).cast("long")
    whole = made.where(~F.col("open")).withColumn("gaps", gaps).select(*RESULT)
    parts = made.where("open")
    behind = parts.select("key", "chunk", "seq", "cross").groupBy("key").applyInArrow(_behind, "chunk long, seq int, behind array<long>")
    behind = staged(behind, "repair-behind")
    leaves = parts.select("key", "chunk", "seq", "codes").join(behind, ["chunk", "seq"]).select("key", "chunk", "seq", "codes", "behind").mapInArrow(_leaving, "key string, chunk long, seq int, leaves array<int>")
    states = leaves.groupBy("key").applyInArrow(_entering, "chunk long, seq int, state int, ends boolean")
    given = parts.drop("cost", "audit", "repaired", "cross", "open").join(behind, ["chunk", "seq"]).join(staged(states, "repair-states"), ["chunk", "seq"])
    kept = [c for c in given.columns if c not in ("codes", "behind", "state", "ends", "roles", "texts")]
    walked = given.mapInArrow(_walks, widened(given.select(*kept).schema, cost="long", audit="string", repaired="binary"))
    walked = walked.repartition("key").sortWithinPartitions("key", "chunk", "seq")
    return whole.unionByName(walked.mapInArrow(_joined(to_arrow_schema(whole.schema)), whole.schema)).drop("key").withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` with faults by the crc32 of ``conversation:turn`` modulo 20, and ``_there``: false for those that are dropped.

    0 drops a turn, 1 empties its text, 2 removes its marks, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    out = turns.select(
        F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), F.when(kind == 4, F.lit("user")).otherwise(space(role_col)).alias(role_col), text.alias(text_col),
        (kind != 0).alias("_there"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return out.drop("_copy")
