"""Document fingerprints by one-permutation MinHash.

Each word shingle of a text is hashed once.  The hash's top bits choose one of ``bins`` bins and
a bin keeps its smallest hash, so one pass over the shingles gives all minima.  An empty bin
takes the value of a full one (optimal densification): every bin has its own fixed random order
of all bins, and the first full bin in that order is its donor.  Two texts thus choose the same donor
as often as their shingles agree, which makes the expected share of equal bins the Jaccard similarity.

Of each bin's value, hashed once more with the bin's number (else the copies that a donor gives
would agree or differ by chance all together), the lowest ``bits`` bits are stored, packed.  Bins of
different values agree by chance in one of 2**bits cases, so with a share m of equal bins the
similarity is estimated as (m - 2**-bits) / (1 - 2**-bits), but 0 at least.

Defined cases: a null text is empty; a text of fewer than ``k`` words is one shingle; a text without
words has the empty fingerprint, whose likeness is 1 to itself and 0 to all others; repeated
rows get a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .textkernel import mix, shingles


class Scheme:
    """Fingerprints of one shape: ``k`` words to a shingle, ``bins`` (a power of two) of ``bits`` bits (1, 2, 4 or 8)."""

    def __init__(self, k: int = 5, bins: int = 512, bits: int = 4, seed: int = 11):
        if bins & (bins - 1) or bins < 8 or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two of at least 8, bits 1, 2, 4 or 8")
        self.k, self.bins, self.bits, self.seed = k, bins, bits, seed
        self.shift = np.uint64(64 - (bins.bit_length() - 1))

    def __reduce__(self):
        return Scheme, (self.k, self.bins, self.bits, self.seed)

    @property
    def orders(self) -> np.ndarray:
        """[bin, bin]: the place of every bin in each bin's own order."""
        return _orders(self.bins, self.seed)

    def minima(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(full bins, their smallest hash) of sorted distinct shingle hashes."""
        at = (hashes >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        return at[first], hashes[first]

    def dense(self, full: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A value for every bin."""
        out = np.zeros(self.bins, np.uint64)
        out[full] = value
        if len(full) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), full, assume_unique=True)
            out[empty] = value[self.orders[np.ix_(empty, full)].argmin(axis=1)]
        return out

    def packed(self, dense: np.ndarray) -> bytes:
        low = (mix(dense + np.arange(self.bins, dtype=np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        parts = low.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * self.bits)
        return np.bitwise_or.reduce(parts, axis=1).astype(np.uint8).tobytes()

    def of(self, text: str | None) -> bytes:
        hashes = shingles(text.encode() if text else None, self.k)
        return self.packed(self.dense(*self.minima(hashes))) if len(hashes) else b""

    def likeness(self, a: bytes, b: bytes) -> float:
        if not a or not b:
            return float(a == b)
        apart = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        mask = (1 << self.bits) - 1
        same = sum(int(((apart >> s) & mask == 0).sum()) for s in range(0, 8, self.bits)) / self.bins
        chance = 2.0**-self.bits
        return max(0.0, (same - chance) / (1 - chance))


@lru_cache(maxsize=4)
def _orders(bins: int, seed: int) -> np.ndarray:
    keys = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(seed << 40), 1).reshape(bins, bins)
    return keys.argsort(axis=1).argsort(axis=1).astype(np.uint16)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """(id, fingerprint binary) for every row."""
    scheme = scheme or Scheme()
    bounded_batches(docs.sparkSession, 256)

    def run(batches):
        for batch in batches:
            made = [scheme.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "_id long, fingerprint binary").withColumnRenamed("_id", id_col)


def likeness(left: Column, right: Column, scheme: Scheme | None = None) -> Column:
    """The estimated similarity of two binary columns of fingerprints; null if either is."""
    scheme = scheme or Scheme()

    @F.pandas_udf("double")
    def each(a, b):  # noqa: ANN001
        import pandas as pd

        return pd.Series([None if x is None or y is None else scheme.likeness(bytes(x), bytes(y)) for x, y in zip(a, b)], dtype="float64")

    return each(left, right)


# ---------------------------------------------------------------- edited texts

_ROW = "kind int, part int, _id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
])
DONE, FIRST, LAST = 0, 1, 2


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many first ones of ``following`` (or all that it has)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _judged(scheme: Scheme, part: int, doc: int | None, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following)
    print_ = own if changed == text else scheme.of(changed)
    return DONE, part, doc, len(text), hashlib.sha256(changed.encode()).digest(), own, print_, scheme.likeness(own, print_), scheme.likeness(own, next_print), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _walk(scheme: Scheme):
    """Rows in order: each is judged as the next one comes; a partition's first and last row wait for its neighbours."""

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                own = scheme.of(text)
                if held is None:
                    out.append((FIRST, part, doc, None, None, own, None, None, None, text))
                else:
                    out.append(_judged(scheme, part, *held, text, own))
                held = (doc, text, own)
            if out:
                yield _batch(out)
        if held is not None:
            yield _batch([(LAST, part, held[0], None, None, held[2], None, None, None, held[1])])

    return run


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), fingerprints as binary.

    A document's edited text ends in the beginning of the next document's, in descending order of ids
    (rows of one id come by the hash of their texts, rows without id last; after the last row comes the first).
    Texts are sorted by ranges, which is the one shuffle that sees them; each task walks its
    range in order, and only the first and the last row of each range are joined afterwards.
    """
    spark, scheme = docs.sparkSession, scheme or Scheme()
    bounded_batches(spark, 256)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("_id").desc_nulls_last(), F.col("_hash"), F.col("_row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    made = staged(ranged.mapInArrow(_walk(scheme), _ROW), "fingerprints")
    lasts, firsts = made.where(F.col("kind") == LAST), made.where(F.col("kind") == FIRST)
    parts = sorted(r["part"] for r in firsts.select("part").collect())  # a number for each partition
    if not parts:
        return _named(made, id_col)
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, after int")
    edges = lasts.join(F.broadcast(after), "part").join(firsts.select(F.col("part").alias("after"), F.col("text").alias("next"), F.col("fingerprint").alias("next_print")), "after")

    def judge(batches):
        for batch in batches:
            got = [_judged(scheme, r["part"], r["_id"], r["text"], r["fingerprint"], r["next"], r["next_print"]) for r in batch.to_pylist()]
            if got:
                yield _batch(got)

    edges = edges.select("part", "_id", "text", "fingerprint", "next", "next_print").mapInArrow(judge, _ROW)
    return _named(made.where(F.col("kind") == DONE).unionByName(edges), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("_id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
