"""Token-id shards with a minimal perfect hash index.

A store is a table of shards in ascending order of document id.  A shard is a row: its raw
token ids (little-endian, 32 bits), and an index that maps the shard's document keys to places
in them.  The index is a minimal perfect hash by hash and displace: a key's bucket names a seed,
the seed hashes the key to its own slot of n, and the slot holds a 64-bit fingerprint of the
key, the first id's place and the number of ids.  A lookup is two hashes and one comparison,
whatever the size; a key that isn't in the shard fails the fingerprint (but for 2**-64).

Shards hold about ``shard_bytes`` of text each, so that both writing and reading are bounded.
A shard also lists its keys in order, for readers that want all of its documents; such readers
look each key up like any other, where the shard lies, without a shuffle.

Where a shard's ids begin in the whole store is a running sum over shards, joined to what is
read; nothing is gathered on the driver.

Defined cases: a null or empty text has the end id only; a null id comes first (its key is told
apart from all whole numbers); rows with the same id are told apart by their place among them (the key is the pair of id and place), in the
order of their texts; an empty table gives an empty store; strings of special tokens in a text
are encoded as the tokenizer does by default.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, join_checked, partitions_for, shared_dir, staged
from .textkernel import mix

SHARD = "shard int, piece int, first_id long, last_id long, n_docs long, n_ids long, ids binary, seeds binary, slots binary, keys binary"
_SHARD = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("seeds", pa.binary()), ("slots", pa.binary()), ("keys", pa.binary())])
SLOT = np.dtype([("print", "<u8"), ("start", "<u8"), ("n", "<u4")])
PER_BUCKET = 4
#: Null ids are routed as the least number; as keys they are (0, -1 - place), which no other row has.
NULL_ID = -(1 << 63)
#: Fixed values of a tokenizer file: how texts must be normalised and parted for pieces between white space to be independent.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


# ------------------------------------------------- minimal perfect hash


def key_of(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1), 0) + nth.astype(np.uint64), 1)


def _slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by bucket, slot of each key): every key of the n distinct ones has a slot of its own in 0..n-1."""
    n = len(keys)
    buckets = max(1, -(-n // PER_BUCKET))
    bucket = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    seeds = np.zeros(buckets, "<u4")
    slots = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    by = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    sizes = np.diff(cut)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if not size:
            break
        own = by[cut[b] : cut[b + 1]]
        seed, step = 0, 64
        while True:  # try seeds in growing strides: the last keys find their slot among few free ones
            tries = np.arange(seed, seed + step)
            at = _slot(np.repeat(keys[own], step), np.tile(tries, size), n).reshape(size, step)
            ok = ~taken[at].any(axis=0)
            if size > 1:
                s = np.sort(at, axis=0)
                ok &= (s[1:] != s[:-1]).all(axis=0)
            if ok.any():
                i = int(np.argmax(ok))
                seeds[b], slots[own] = seed + i, at[:, i]
                taken[at[:, i]] = True
                break
            seed, step = seed + step, min(step * 2, 1 << 16)
    return seeds, slots


def lookup(keys: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slots of keys, -1 for a key whose fingerprint isn't there."""
    n = len(slots)
    if not n:
        return np.full(len(keys), -1, np.int64)
    at = _slot(keys, seeds[(mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)], n)
    return np.where(slots["print"][at] == mix(keys, 1), at, -1)


# ------------------------------------------------------------- encoding


def parts_at_white_space(made: dict) -> bool:
    """Whether a tokenizer (its file as a dict) lowers letters, parts at white space and drops it, marks words' ends, and has special tokens with "<|" only."""
    steps = (made.get("normalizer") or {}).get("normalizers") or []
    split = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [x.get("type") for x in steps] == PIECE_NORMALIZERS
        and steps[1].get("pattern") == {"Regex": r"\s+"}
        and steps[1].get("content") == " "
        and split.get("type") == "Split"
        and split.get("pattern") == {"Regex": PIECE_PATTERN}
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and made["model"].get("type") == "BPE"
        and made["model"].get("end_of_word_suffix") == "</w>"
        and not made.get("post_processor")
        and all("<|" in x["content"] for x in made.get("added_tokens") or [])
    )


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct piece.

    The tokenizer lower-cases and parts at white space, so A-Z are lowered and the text is cut at
    ASCII white space first; a comma or full stop that ends a piece after a letter is a piece of
    its own for the tokenizer too.  Pieces of letters only are encoded many at a time, and parted
    where a token ends a word; if that doesn't come out even, one by one.  Texts that might hold
    strings of special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.keep = Tokenizer.from_file(path), end_id, keep
        self.by_pieces = parts_at_white_space(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._begin()

    def _begin(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.n, self.used = np.zeros(1 << 20, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), np.zeros(1 << 16, np.int64), 0, 0

    def _store(self, pieces: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces with their ids, one behind the other."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(pieces) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.known.update(zip(pieces, range(self.n, self.n + len(pieces))))
        self.at[self.n + 1 : self.n + len(pieces) + 1] = self.used + np.cumsum(sizes)
        self.n += len(pieces)
        self.used += len(flat)

    def _encode_each(self, pieces: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        self._store(pieces, np.array([i for ids in got for i in ids], np.int64), np.array([len(ids) for ids in got], np.int64))

    def _learn(self, pieces: list[bytes]) -> None:
        letters, rest = [], []
        for p in pieces:
            (letters if p.decode().isalpha() else rest).append(p)
        for i in range(0, len(rest), 8192):
            self._encode_each(rest[i : i + 8192])
        for i in range(0, len(letters), 8192):
            part = letters[i : i + 8192]
            lines = [part[j : j + 128] for j in range(0, len(part), 128)]
            got = self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)
            for line, e in zip(lines, got):
                ids = np.array(e.ids, np.int64)
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(line) and cut[-1] == len(ids):
                    self._store(line, ids, np.diff(cut, prepend=0))
                else:
                    self._encode_each(line)

    def _pieces(self, text: bytes) -> list[bytes]:
        return text.lower().split()

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if not self.by_pieces:
            got = self.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)
            return [np.array([*e.ids, self.end_id], np.uint32) for e in got]
        if self.n > self.keep:
            self._begin()
        cut = [None if t and b"<|" in t else self._pieces(t) if t else [] for t in texts]
        told = [w for p in cut if p for w in p]
        number = np.fromiter(map(self.known.get, told, repeat(-1)), np.int64, len(told))
        missing = np.flatnonzero(number < 0)
        fresh = dict.fromkeys(told[i] for i in missing.tolist())
        stems, marked = {}, []
        for w in fresh:
            if w[-1:] in (b",", b".") and b"a" <= w[-2:-1] <= b"z":
                marked.append(w)
                if w[:-1] not in self.known:
                    stems[w[:-1]] = None
            else:
                stems[w] = None
        for mark in (b",", b"."):
            if mark not in self.known:
                stems[mark] = None
        self._learn(list(stems))
        if marked:  # a word and its mark: both are known now
            stem = np.fromiter((self.known[w[:-1]] for w in marked), np.int64, len(marked))
            mark = np.fromiter((self.known[w[-1:]] for w in marked), np.int64, len(marked))
            flat, sizes = self._gathered(np.stack([stem, mark], 1).ravel())
            self._store(marked, flat, sizes.reshape(-1, 2).sum(axis=1))
        number[missing] = [self.known[told[i]] for i in missing.tolist()]
        ids, sizes = self._gathered(number)
        edge = np.r_[0, np.cumsum(sizes)]
        out, at = [], 0
        for text, p in zip(texts, cut):
            if p is None:
                whole = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            else:
                whole = ids[edge[at] : edge[at + len(p)]]
                at += len(p)
            one = np.empty(len(whole) + 1, np.uint32)
            one[:-1], one[-1] = whole, self.end_id
            out.append(one)
        return out

    def _gathered(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.at[pieces], self.at[pieces + 1] - self.at[pieces]
        return self.ids[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)], size


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker: its pieces serve the worker's next tasks as well."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _write(path: str, end_id: int, piece_bytes: int):
    def run(batches):
        shard = None
        rows, size, piece = [], 0, 0
        last, nth = object(), 0

        def flush():
            pairs = np.array([(0, -1 - nth) if doc is None else (doc, nth) for doc, nth, _ in rows], "<i8")
            keys = key_of(pairs[:, 0], pairs[:, 1])
            first, last = (NULL_ID if r[0] is None else r[0] for r in (rows[0], rows[-1]))
            seeds, slots = build_index(keys)
            n = np.array([len(r[2]) for r in rows], np.int64)
            table = np.zeros(len(rows), SLOT)
            table["print"][slots], table["start"][slots], table["n"][slots] = mix(keys, 1), np.cumsum(n) - n, n
            blob = np.concatenate([r[2] for r in rows]).astype("<u4").tobytes()
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "piece": piece, "first_id": first, "last_id": last, "n_docs": len(rows), "n_ids": int(n.sum()), "ids": blob, "seeds": seeds.tobytes(), "slots": table.tobytes(), "keys": pairs.tobytes()}],
                schema=_SHARD,
            )

        for batch in batches:
            if shard is None and batch.num_rows:
                shard = batch.column("_shard")[0].as_py()
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, ids in zip(part.column("_id").to_pylist(), encoder(path, end_id).encode(part.column("_text").cast(pa.binary()).to_pylist())):
                    nth = nth + 1 if doc == last else 0
                    last = doc
                    rows.append((doc, nth, ids))
                    size += 4 * len(ids)
                    if size >= piece_bytes:
                        yield flush()
                        rows, size, piece = [], 0, piece + 1
        if rows:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 12 << 20) -> None:
    """Encode ``docs`` and write the store at ``path``. ``tokenizer`` is a file of the tokenizers library."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    n_bytes = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n = min(100_000, partitions_for(n_bytes, shard_bytes))  # a range may fill several pieces
    ranged = base.repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text")
    ranged = ranged.select("_id", "_text", F.spark_partition_id().alias("_shard"))
    ranged.mapInArrow(_write(tokenizer, end_id, shard_bytes), SHARD).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


_READ = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("_id", pa.int64()), ("nth", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ = "shard int, piece int, _id long, nth int, at long, n_tokens long, ids_crc32 long"


def _read(batches):
    """Every document of the shards, looked up by its key; ``at`` is its place in the shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in ("shard", "piece", "ids", "seeds", "slots", "keys")}
            keys = np.frombuffer(row["keys"].as_py(), "<i8").reshape(-1, 2)
            slots = np.frombuffer(row["slots"].as_py(), SLOT)
            at = lookup(key_of(keys[:, 0], keys[:, 1]), np.frombuffer(row["seeds"].as_py(), "<u4"), slots)
            if (at < 0).any():
                raise ValueError("a key of the shard is missing in its index")
            start, n = slots["start"][at].astype(np.int64), slots["n"][at].astype(np.int64)
            raw = memoryview(row["ids"].as_buffer())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(start.tolist(), n.tolist())]
            missing = keys[:, 1] < 0
            nth = np.where(missing, -1 - keys[:, 1], keys[:, 1]).astype(np.int32)
            where = [pa.array(np.full(len(n), row[c].as_py(), np.int32)) for c in ("shard", "piece")]
            yield pa.RecordBatch.from_arrays([*where, pa.array(keys[:, 0], mask=missing), pa.array(nth), pa.array(start), pa.array(n), pa.array(np.array(crc, np.int64))], schema=_READ)


def shard_starts(store: DataFrame, block: int = 1024) -> DataFrame:
    """(shard, piece, before): ids in front of each row of the store. Sums run over blocks of shards, then within each."""
    sizes = store.select("shard", "piece", "n_ids").withColumn("_block", F.floor(F.col("shard") / block).cast("int"))
    blocks = sizes.groupBy("_block").agg(F.sum("n_ids").alias("_all"))
    # One row for each block of shards: over 12 GB of text.
    blocks = blocks.select("_block", (F.sum("_all").over(Window.orderBy("_block")) - F.col("_all")).alias("_first"))
    inner = F.sum("n_ids").over(Window.partitionBy("_block").orderBy("shard", "piece")) - F.col("n_ids")
    return sizes.withColumn("_inner", inner).join(blocks, "_block").select("shard", "piece", (F.col("_first") + F.col("_inner")).alias("before"))


def _route(keys: pa.Table, ends: pa.Table) -> pa.Table:
    """Keys to the pieces whose range of ids holds them (more than one only where an id runs over a border)."""
    schema = pa.schema([("_id", pa.int64()), ("missing", pa.bool_()), ("nth", pa.int32()), ("shard", pa.int32()), ("piece", pa.int32())])
    if not keys.num_rows or not ends.num_rows:
        return schema.empty_table()
    ends = ends.sort_by([("shard", "ascending"), ("piece", "ascending")])
    doc = keys.column("_id").to_numpy()
    low = np.searchsorted(ends.column("last_id").to_numpy(), doc, "left")
    n = np.maximum(np.searchsorted(ends.column("first_id").to_numpy(), doc, "right") - low, 0)
    row = np.repeat(np.arange(len(doc)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    return pa.table([keys.column("_id").take(row), keys.column("missing").take(row), keys.column("nth").take(row), ends.column("shard").take(at), ends.column("piece").take(at)], schema=schema)


def _lookup_rows(with_ids: bool):
    schema = pa.schema([*_READ] + ([pa.field("ids", pa.binary())] if with_ids else []))

    def run(keys: pa.Table, shards: pa.Table) -> pa.Table:
        parts = []
        if keys.num_rows:
            missing = keys.column("missing").to_numpy()
            doc = np.where(missing, 0, keys.column("_id").to_numpy())
            nth = keys.column("nth").to_numpy()
            key = key_of(doc, np.where(missing, -1 - nth, nth))
            for row in shards.to_pylist():
                slots = np.frombuffer(row["slots"], SLOT)
                at = lookup(key, np.frombuffer(row["seeds"], "<u4"), slots)
                hit = np.flatnonzero(at >= 0)
                start, n = slots["start"][at[hit]].astype(np.int64), slots["n"][at[hit]].astype(np.int64)
                raw = [row["ids"][4 * a : 4 * (a + k)] for a, k in zip(start.tolist(), n.tolist())]
                where = [pa.array(np.full(len(hit), row[c], np.int32)) for c in ("shard", "piece")]
                columns = [*where, pa.array(doc[hit], mask=missing[hit]), pa.array(nth[hit]), pa.array(start), pa.array(n), pa.array(np.array([zlib.crc32(x) for x in raw], np.int64))]
                parts.append(pa.table(columns + ([pa.array(raw, pa.binary())] if with_ids else []), schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _placed(found: DataFrame, store: DataFrame, id_col: str, *more: str) -> DataFrame:
    """``found`` with ``start`` over the whole store."""
    starts = shard_starts(store)
    out = join_checked(found, starts, ["shard", "piece"], "inner", starts.count())
    return out.select(F.col("_id").alias(id_col), "nth", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *more)


def fetch(store: DataFrame, keys: DataFrame, with_ids: bool = False, id_col: str = "doc_id", ranges: int = 2048, salts: int = 8) -> DataFrame:
    """(id, nth, start, n_tokens, ids_crc32[, ids]) of ``keys`` (ids, with ``nth`` for repeated ids) found through the index.

    Keys are sent to the shards that may hold them: ids fall into at most ``ranges`` ranges, in
    each of which the shards' own ranges are searched; a range's keys are dealt to ``salts`` tasks.
    """
    nth = F.col("nth").cast("int") if "nth" in keys.columns else F.lit(0)
    missing = F.col(id_col).isNull()
    keys = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), missing.alias("missing"), nth.alias("nth"))
    ends = staged(store.select("shard", "piece", "first_id", "last_id"), "store-ends")
    cut = ends.agg(F.percentile_approx("first_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cut))]).cast("array<long>")
    range_of = lambda c: F.size(F.filter(cuts, lambda x: x <= c))
    dealt = keys.withColumn("range", range_of(F.col("_id"))).withColumn("salt", F.pmod(F.xxhash64("_id", "nth"), F.lit(salts)))
    spread = ends.withColumn("range", F.explode(F.sequence(range_of(F.col("first_id")), range_of(F.col("last_id"))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    routed = dealt.groupBy("range", "salt").cogroup(spread.groupBy("range", "salt")).applyInArrow(_route, "_id long, missing boolean, nth int, shard int, piece int")
    schema = READ + (", ids binary" if with_ids else "")
    found = routed.groupBy("shard", "piece").cogroup(store.groupBy("shard", "piece")).applyInArrow(_lookup_rows(with_ids), schema)
    return _placed(found, store, id_col, *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write ``docs``, then read every document by its key: (id, start, n_tokens, ids_crc32), ``start`` over the whole store."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-store")
    write_store(docs, path, tokenizer, end_id, id_col, text_col, **options)
    store = read_store(spark, path)
    return _placed(store.mapInArrow(_read, READ), store, id_col).drop("nth")
