"""The keyed streaming partitioner: its rule, replays, restarts and loads."""

import random

import numpy as np
import pytest

from spindle.streaming.keyed import KeyedState, admitted, clusters, filled, partition_stream
from spindle.streaming.partitioner import fold

SCHEMA = "edge_seq long, src long, dst long"


def one_by_one(load, most, n):
    load, give = load.copy(), np.zeros(len(load), int)
    for _ in range(n):
        room = np.where(load < most, load, 10**9)
        c = int(np.argmin(room if (load < most).any() else load))
        load[c] += 1
        give[c] += 1
    return give


def test_filling_equals_one_by_one():
    draw = random.Random(0)
    for _ in range(300):
        load = np.array([draw.randrange(12) for _ in range(draw.randrange(1, 6))])
        most, n = draw.randrange(1, 14), draw.randrange(40)
        assert filled(load, most, n).tolist() == one_by_one(load, most, n).tolist(), (load, most, n)


def test_single_edges_follow_the_fold(spark, tmp_path):
    edges = [(0, 1, 2), (1, 3, 1), (2, 2, 4), (3, 5, 5), (4, 6, 7), (5, 1, 8)]
    state = KeyedState(spark, str(tmp_path), 3, every=4)
    for b, edge in enumerate(edges):
        state.take(spark.createDataFrame([edge], SCHEMA), b, 8, 1.0)
    want = fold({}, np.array([e[1:] for e in edges]), 8, 3, 1.0)
    assert dict(map(tuple, state.before(len(edges)).collect())) == want
    assert state.load(len(edges)).tolist() == np.bincount(list(want.values()), minlength=3).tolist()


def test_chains_of_new_nodes_follow_their_head(spark):
    edges = [(k, k, k + 1) for k in range(40)] + [(100 + k, 1000, 2000 + k) for k in range(30)]
    new, load = admitted(None, np.zeros(2, int), spark.createDataFrame(edges, SCHEMA), 72)
    got = dict(map(tuple, new.collect()))
    assert len(got) == 72 and load.sum() == 72 and load.max() <= 40
    assert len({got[k] for k in range(36)}) == 1 and len({got[2000 + k] for k in range(20)}) == 1 and got[0] != got[1000]


def test_late_repeated_null_and_empty_rows_move_nobody(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path), 2)
    state.take(spark.createDataFrame([(10, 1, 2), (11, 3, 4)], SCHEMA), 0, 6)
    before = dict(map(tuple, state.before(1).collect()))
    state.take(spark.createDataFrame([(3, 4, 1), (10, 1, 2), (4, None, 9), (5, 9, None), (None, 1, 7)], SCHEMA), 1, 6)
    state.take(spark.createDataFrame([], SCHEMA), 2, 6)
    assert dict(map(tuple, state.before(3).collect())) == before and state.load(3).sum() == 4


@pytest.mark.parametrize("k", [4])
def test_replay_and_restart_give_the_same_state_within_the_limit(spark, tmp_path, k):
    draw = random.Random(1)
    edges = [(i, draw.randrange(300), 0 if i % 3 == 0 else draw.randrange(300)) for i in range(900)]
    n = len({x for e in edges for x in e[1:]})
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(edges[part * 300 : part * 300 + 300], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(path, parts=3):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        partition_stream(stream, path, n, k, every=2).awaitTermination()
        return dict(map(tuple, clusters(spark, path, k, parts, 2).collect()))

    whole = run(str(tmp_path / "a"))
    assert len(whole) == n and max(np.bincount(list(whole.values()))) <= -(-1.1 * n // k)
    state = KeyedState(spark, str(tmp_path / "a"), k, 2)
    rows = spark.createDataFrame([r for r in edges[600:]], SCHEMA)
    state.take(rows, 2, n)
    again, load = dict(map(tuple, state.before(3).collect())), state.load(3).tolist()
    state.take(rows.orderBy("dst"), 2, n)  # the batch once more, over what it wrote and in another order of rows
    assert dict(map(tuple, state.before(3).collect())) == again and state.load(3).tolist() == load
    assert len(again) == state.before(3).count() and load == np.bincount(list(again.values()), minlength=k).tolist() and max(load) <= -(-1.1 * n // k)
    spark.createDataFrame([(2000, 0, 299), (2001, 5, 6)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    more = run(str(tmp_path / "a"), 4)  # goes on from the checkpoint: only the new file
    assert {i: c for i, c in more.items() if i in again} == again
