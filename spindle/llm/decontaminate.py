"""Benchmark decontamination by latent semantic retrieval.

The texts are read once, into codes of the benchmark's words (0 for all other words), a table in
the shared folder that all later passes read.  Texts are cut into passages of two units of
``unit`` words, one unit apart.  Passages are TF-IDF rows over ``FEATURES`` hashed terms of the
benchmark, whatever its size; words in more than ``stop_share`` of the units weigh nothing unless
they are among the ``least_terms`` rarest of an item: a passage that leaked into many documents
makes its own terms frequent, and an item may consist of common words only.  Such terms weigh
``FLOOR`` of the mean weight at least, so that the words around a copy don't outweigh it.

The rows' leading right singular vectors come from a distributed randomised SVD: one pass sums
A'A as sparse pairs, groups of its rows are multiplied by a random W in tasks, and the Nystrom
form of A'A gives the vectors.  The items' own rows join A with a weight, so that an item that
leaked once isn't lost among the directions of a large corpus.

A passage is a candidate for an item if its cosine with the item's latent vector (without its
negative parts, so that words around a copy can't lower it) reaches the item's own bound:
``tolerance`` times the cosine that the best passage of a verbatim copy has at least, however it
lies to the units and whatever words stand around it.  So no verbatim copy is ever missed, and
the bound follows from the length of the item.  A candidate is then checked on the words
themselves: the longest common subsequence of the item and the text around the passage must
hold at least ``lcs`` of the item's words, and the answer must be there: the words of the item's
``answer`` if the benchmark has that column, else its rarest terms, at least half of them.

There is one latent space for all items.  They are searched in blocks of ``block_items``, one after
the other, which bound what is sent to the tasks at once; each item's bound and vector are its own, so blocks of
any size give the same rows.  The driver holds the items' sparse rows and matrices of ``FEATURES`` rows at most.  The benchmark's distinct words go to all tasks (``most_words`` at
most, 2 million: about 150 MB; a larger benchmark is refused).

Defined cases: null or empty texts and items match nothing; words are compared without ASCII
punctuation, with A-Z lowered; items of fewer than ``least_words`` words are matched like all
others but all their words must be there; repeated rows are found each; ties between passages
go to the earlier one; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, rows_apart, staged
from .textkernel import narrow, pack, unpack

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FEATURES = 1 << 16
CHUNK_WORDS = 250_000
#: Least weight of a frequent term that an item needs, as a share of the other terms' mean weight.
FLOOR = 0.7


def plain_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split() if text else []


def lcs_length(item: list, masks: dict, text: list) -> int:
    """Bit-parallel: ``masks`` has the places of each word in ``item``."""
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if m := masks.get(w, 0):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def masks_of(item: list) -> dict:
    out: dict = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


# ---------------------------------------------------------------- passes over the texts

#: ``ids`` are pairs of a row's id and the hash of its text.
CODED = "ids array<struct<i: long, h: long>>, blob binary"
_PAIRS = pa.list_(pa.struct([("i", pa.int64()), ("h", pa.int64())]))
_CODED = pa.schema([("ids", _PAIRS), ("blob", pa.binary())])


def _code(held):
    """Texts as codes of their words: 1 + the number of a word of the benchmark, else 0; many texts to a row."""

    def run(batches):
        codes_of = held.value
        ids, sizes, codes, waiting = [], [], [], 0

        def row():
            made = narrow(np.concatenate(codes)) if codes else np.zeros(0, np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([ids], _PAIRS), pa.array([pack(made, np.array(sizes, np.int64))], pa.binary())], schema=_CODED)

        for batch in batches:
            for doc, h, text in zip(batch.column("_id").to_pylist(), batch.column("_h").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist()):
                w = plain_words(text)
                ids.append({"i": doc, "h": h})
                sizes.append(len(w))
                codes.append(np.fromiter(map(codes_of.get, w, repeat(0)), np.uint32, len(w)))
                waiting += len(w)
                if waiting >= CHUNK_WORDS:
                    yield row()
                    ids, sizes, codes, waiting = [], [], [], 0
        if ids:
            yield row()

    return run


class Units:
    """Features of benchmark words in the units of some coded texts."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, feature_of: np.ndarray, unit: int):
        self.codes, self.starts = codes, np.cumsum(sizes) - sizes
        per = -(-sizes // unit)
        first = np.cumsum(per) - per
        self.n = int(per.sum())
        self.doc = np.repeat(np.arange(len(sizes)), per)
        self.number = np.arange(self.n) - first[self.doc]  # within its text
        self.sizes = np.minimum(unit, sizes[self.doc] - self.number * unit)
        word = np.flatnonzero(codes)
        doc = np.searchsorted(self.starts, word, "right") - 1
        self.at = first[doc] + (word - self.starts[doc]) // unit
        self.feature = feature_of[codes[word].astype(np.int64) - 1]
        self.hits = np.bincount(self.at, minlength=self.n)

    def kept(self, keep: np.ndarray) -> Units:
        """Only hits of kept features."""
        ok = keep[self.feature]
        self.at, self.feature = self.at[ok], self.feature[ok]
        return self

    def norms(self, weight: np.ndarray, other: float) -> np.ndarray:
        """Squared lengths of the units' rows; words that aren't the benchmark's weigh ``other``."""
        own = np.bincount(self.at, weights=weight[self.feature] ** 2, minlength=self.n)
        return own + (self.sizes - self.hits) * other**2

    def sums_for(self, matrix: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each unit, sums of the matrix's rows over the hits of the needed units); row 0 is for all others."""
        units = np.flatnonzero(needed)
        place = np.zeros(self.n, np.int64)
        place[units] = np.arange(1, len(units) + 1)
        out = np.zeros((len(units) + 1, matrix.shape[1]), np.float32)
        hit = np.flatnonzero(needed[self.at])
        if len(hit):
            at = self.at[hit]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out[place[at[start]]] = np.add.reduceat(matrix[self.feature[hit]], start, axis=0)
        return place, out


def _chunks(batches):
    for batch in batches:
        for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("blob").to_pylist()):
            codes, sizes = unpack(blob)
            yield ids, codes, sizes


_SUM = pa.schema([("slice", pa.int32()), ("blob", pa.binary())])


def _edges(m: int) -> np.ndarray:
    """Borders of the row groups of a matrix over m features: 8 at least, and of 4 million entries of A'A at most each."""
    return np.linspace(0, m, min(m, max(8, -(-m * m // (1 << 22)))) + 1).astype(np.int64)


def _sum_rows(matrix: np.ndarray, m: int):
    edges = _edges(m)
    yield pa.RecordBatch.from_pydict({"slice": list(range(len(edges) - 1)), "blob": [pack(matrix[a:b].ravel()) for a, b in zip(edges, edges[1:])]}, schema=_SUM)


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a row group's parts, taken one after the other."""
    total = 0.0
    for batch in batches:
        for blob in batch.column("blob"):
            total = total + unpack(blob.as_py())[0].astype(np.float64)
    yield pa.RecordBatch.from_pydict({"slice": [key[0].as_py()], "blob": [pack(total)]}, schema=_SUM)


def _summed(rows: DataFrame, f, width: int, add=_add) -> np.ndarray:
    """A matrix of one row for each feature, from parts of its row groups that ``f`` makes and ``add`` sums."""
    parts = rows.mapInArrow(f, "slice int, blob binary").groupBy("slice").applyInArrow(add, "slice int, blob binary").collect()
    got = [unpack(bytes(r["blob"]))[0] for r in sorted(parts, key=lambda r: r["slice"])]
    return np.concatenate(got).reshape(-1, width) if got else np.zeros((0, width))


def _frequencies(held, unit: int):
    """Units that hold each feature, and the number of units in a last row."""

    def run(batches):
        feature_of, m = held.value["feature_of"], held.value["m"]
        df, n = np.zeros(m + 1), 0
        for _, codes, sizes in _chunks(batches):
            u = Units(codes, sizes, feature_of, unit)
            df[:-1] += np.bincount(np.unique(u.at * m + u.feature) % m, minlength=m)
            n += u.n
        df[-1] = n
        yield from _sum_rows(df[:, None], m + 1)

    return run


def _merged(key: list[np.ndarray], value: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(np.concatenate(key), return_inverse=True)
    return u, np.bincount(inverse, weights=np.concatenate(value), minlength=len(u))


HELD_PAIRS = 1_000_000


def _gram(held, unit: int):
    """A'A of a partition, as sparse pairs of features that meet in a unit: A's rows are short, so W can come last.

    Sums go on as soon as ``HELD_PAIRS`` pairs are held, so a task's memory doesn't grow with its partition.
    """

    def run(batches):
        h = held.value
        weight, m = h["weight"], h["m"]
        edges = _edges(m) * m
        keys, values, waiting = [], [], 0

        def part(k: np.ndarray, v: np.ndarray):
            # Both halves of the symmetric matrix; the diagonal has counted half.
            k = np.concatenate([k, k % m * m + k // m])
            order = np.argsort(k)
            k, v = k[order], np.concatenate([v, v])[order]
            cut = np.searchsorted(k, edges)
            blobs = [pack(narrow(np.diff(k[a:b], prepend=e)), v[a:b].astype(np.float32)) for a, b, e in zip(cut, cut[1:], edges)]
            return pa.RecordBatch.from_pydict({"slice": list(range(len(blobs))), "blob": blobs}, schema=_SUM)

        for _, codes, sizes in _chunks(batches):
            u = Units(codes, sizes, h["feature_of"], unit).kept(h["keep"])
            scale = 1 / np.maximum(u.norms(weight, h["other"]), 1e-9)
            for d in range(unit):
                n = len(u.at) - d
                same = np.flatnonzero(u.at[:n] == u.at[d:]) if n > 0 else np.zeros(0, np.int64)
                if not len(same):
                    break
                a, b = u.feature[same], u.feature[same + d]
                keys.append(a * m + b)
                values.append(weight[a] * weight[b] * scale[u.at[same]] * (0.5 if d == 0 else 1.0))
                waiting += len(same)
                if waiting > HELD_PAIRS // 2:
                    k, v = _merged(keys, values)
                    keys, values, waiting = [k], [v], 0
                    if len(k) > HELD_PAIRS:
                        yield part(k, v)
                        keys, values = [], []
        if keys:
            yield part(*_merged(keys, values))

    return run


def _times_omega(held):
    """A group of rows of A'A times W; the partitions' parts are added one by one."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value["omega"]
        m, s = len(w), key[0].as_py()
        first, end = _edges(m)[s : s + 2]
        rows = np.zeros((end - first) * m)
        for batch in batches:
            for blob in batch.column("blob"):
                gaps, v = unpack(blob.as_py())
                rows += np.bincount(np.cumsum(gaps.astype(np.int64)), weights=v, minlength=len(rows))
        g = rows.reshape(end - first, m) @ w
        yield pa.RecordBatch.from_pydict({"slice": [s], "blob": [pack(g.ravel())]}, schema=_SUM)

    return run


# ---------------------------------------------------------------- latent space and bounds


def kept_features(items: list[np.ndarray], df: np.ndarray, n: float, stop_share: float, least_terms: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(kept features, weights, weight of other words): features in at most a share of the units, and every item's rarest."""
    idf = np.log((n + 1) / (df + 1)) + 1
    keep = df <= stop_share * n
    other = float(idf[keep].mean()) if keep.any() else 1.0
    needed = np.zeros(len(df), bool)
    for item in items:
        own = np.unique(item)
        needed[own[np.lexsort((own, df[own]))[:least_terms]]] = True
    keep |= needed
    return keep, np.where(keep, np.where(needed, np.maximum(idf, FLOOR * other), idf), 0.0), other


class Rows:
    """The items' unit rows, sparse."""

    def __init__(self, features: list[np.ndarray], weight: np.ndarray):
        pairs = [np.unique(f, return_counts=True) for f in features]
        self.starts = np.cumsum([0, *[len(f) for f, _ in pairs]])
        self.feature = np.concatenate([f for f, _ in pairs])
        value = weight[self.feature] * np.concatenate([n for _, n in pairs])
        norm = np.sqrt(np.add.reduceat(value**2, self.starts[:-1]))
        self.value = value / np.repeat(np.maximum(norm, 1e-12), np.diff(self.starts))

    def blocks(self, size: int = 256):
        """(features, values, rows from 0, number of rows) of so many items after each other."""
        n = len(self.starts) - 1
        for a in range(0, n, size):
            b = min(a + size, n)
            part = slice(self.starts[a], self.starts[b])
            yield self.feature[part], self.value[part], np.repeat(np.arange(b - a), np.diff(self.starts[a : b + 1])), b - a

    def gram_times(self, w: np.ndarray) -> np.ndarray:
        """B'(B w) for the items' rows B."""
        out = np.zeros(w.shape)
        for f, v, r, n in self.blocks():
            product = np.zeros((n, w.shape[1]))
            np.add.at(product, r, v[:, None] * w[f])
            np.add.at(out, f, v[:, None] * product[r])
        return out

    def latent(self, basis: np.ndarray, size: int):
        """Blocks of items projected on the basis, as unit columns [feature, item] without their negative parts."""
        for f, v, r, n in self.blocks(size):
            low = np.zeros((n, basis.shape[1]))
            np.add.at(low, r, v[:, None] * basis[f])
            m = basis @ low.T
            yield np.maximum(m / np.maximum(np.linalg.norm(m, axis=0), 1e-12), 0)


def latent_basis(g: np.ndarray, omega: np.ndarray, items: Rows, weight: float, rank: int) -> np.ndarray:
    """The leading right singular vectors of the corpus rows and, with ``weight``, the items' rows; ``g`` is A'(A omega) of the corpus."""
    g = g + weight * items.gram_times(omega)
    core = omega.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    ok = values > max(values.max(), 1e-12) * 1e-10
    b = g @ (vectors[:, ok] / np.sqrt(values[ok]))
    v, _, _ = np.linalg.svd(b, full_matrices=False)
    return v[:, :rank]


def copy_score(gain: np.ndarray, square: np.ndarray, unit: int, around: float) -> float:
    """The least cosine that the best passage of a verbatim copy can have.

    ``gain`` and ``square`` are the item's words' parts of the product and of the squared length,
    ``around`` the largest squared weight of any word beside it.
    """
    n, least = len(gain), np.inf
    g, q = np.r_[0, np.cumsum(gain)], np.r_[0, np.cumsum(square)]
    for offset in range(unit):
        start = np.arange(-1, -(-(offset + n) // unit)) * unit - offset  # passages' first words, in words of the item
        a, b = np.clip(start, 0, n), np.clip(start + 2 * unit, 0, n)
        best = ((g[b] - g[a]) / np.sqrt(np.maximum(q[b] - q[a] + (2 * unit - (b - a)) * around, 1e-12))).max()
        least = min(least, best)
    return float(least)


_FOUND = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("item_id", pa.int64()), ("at_word", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])
FOUND = "_id long, _h long, item_id long, at_word long, cosine double, lcs_share double, answer_share double"


GROUP = 16  # items whose bounds are looked at together


def in_common(places: np.ndarray, counts: np.ndarray, near: np.ndarray) -> int:
    """Words that the item and a text share, repeated ones as often as both have them: no common subsequence is longer.

    ``places`` numbers the item's distinct words from 1, ``counts`` has how often each occurs.
    """
    return int(np.minimum(np.bincount(places[near], minlength=len(counts))[1:], counts[1:]).sum())


def _search(held, unit: int, lcs: float, least_words: int):
    def run(batches):
        h = held.value
        weight, items, bound = h["weight"], h["items"], h["bound"]
        reach = (h["latent"] * weight[:, None] / bound).astype(np.float32)  # a candidate sums up to its length
        groups = []
        for a in range(0, len(items), GROUP):
            part = np.ascontiguousarray(reach[:, a : a + GROUP])
            groups.append((a, part, part.max(axis=1, initial=0).astype(np.float64)))
        masks = [masks_of(words.tolist()) for _, words, _ in items]
        places, counts = np.zeros((len(items), h["n_codes"] + 1), np.uint16), []
        for i, (_, words, _) in enumerate(items):
            own, n = np.unique(words, return_counts=True)
            places[i, own] = np.arange(1, len(own) + 1)
            counts.append(np.r_[0, n])
        least = [int(np.ceil((lcs if len(words) >= least_words else 1.0) * len(words) - 1e-9)) for _, words, _ in items]
        for ids, codes, sizes in _chunks(batches):
            u = Units(codes, sizes, h["feature_of"], unit).kept(h["keep"])
            if not len(u.at):
                continue
            norm = u.norms(weight, h["other"])
            joined = np.r_[u.doc[1:] == u.doc[:-1], False]
            nxt = np.minimum(np.arange(u.n) + 1, u.n - 1)
            length = np.maximum(np.sqrt(norm + norm[nxt] * joined), 1e-9)
            found: dict[tuple[int, int], tuple] = {}
            for base, matrix, most in groups:
                # No item of the group gets more from a passage's words than the largest part of each: most passages can't reach any bound.
                top = np.bincount(u.at, weights=most[u.feature], minlength=u.n)
                able = np.flatnonzero(top + top[nxt] * joined >= length * (1 - 1e-5))
                if not len(able):
                    continue
                needed = np.zeros(u.n, bool)
                needed[able] = True
                needed[nxt[able]] |= joined[able]
                place, score = u.sums_for(matrix, needed)
                both = score[place[able]]
                both += score[place[nxt[able]]] * joined[able, None]
                both /= length[able, None].astype(np.float32)
                row, item = np.nonzero(both >= 1)
                for r, i in zip(row.tolist(), (item + base).tolist()):
                    a = int(able[r])
                    doc = int(u.doc[a])
                    if (doc, i) in found:
                        continue
                    item_id, words, answer = items[i]
                    word, start, n = int(u.number[a]) * unit, int(u.starts[doc]), len(words)
                    # An item of n words around the passage lies within n words of it.
                    near = codes[start + max(0, word - n) : start + min(int(sizes[doc]), word + 2 * unit + n)]
                    if in_common(places[i], counts[i], near) < least[i]:
                        continue
                    near = near.tolist()
                    common = lcs_length(words, masks[i], near)
                    if common >= least[i]:
                        seen = set(near)
                        right = sum(x in seen for x in answer) / max(len(answer), 1)
                        if right >= 0.5 or not len(answer):
                            found[doc, i] = (item_id, word, float(both[r, i - base] * bound[i]), common / n, right)
            if found:
                rows = [(ids[doc]["i"], ids[doc]["h"], *found[doc, i]) for doc, i in sorted(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    unit: int = 12,
    tolerance: float = 0.6,
    lcs: float = 0.6,
    least_words: int = 5,
    stop_share: float = 0.02,
    least_terms: int = 12,
    rank: int = 320,
    block_items: int = 256,
    most_words: int = 2_000_000,
    seed: int = 7,
    hashed: bool = False,
) -> DataFrame:
    """(id, item_id, at_word, cosine, lcs_share, answer_share): a row for every document and item found in it; with ``hashed`` also _h, the xxhash64 of the text."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def named(found: DataFrame) -> DataFrame:
        return (found if hashed else found.drop("_h")).withColumnRenamed("_id", id_col)

    share = spark.sparkContext.broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    source = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col("text").alias("t"), answer.alias("a")).where("i is not null and t is not null")
    got = sorted((r.i, plain_words(r.t.encode()), plain_words(r.a.encode()) if r.a else []) for r in source.collect())
    got = [x for x in got if x[1]]
    if not got:
        return named(spark.createDataFrame([], FOUND))
    told = sorted({w for _, words, answer in got for w in (*words, *answer)})
    if len(told) > most_words:
        raise ValueError(f"the benchmark has {len(told)} distinct words, over {most_words}: split it")
    codes_of = {w: i + 1 for i, w in enumerate(told)}
    sent = [share(codes_of)]
    coded = staged(rows.mapInArrow(_code(sent[0]), CODED), "benchmark-words")
    used, feature_of = np.unique(np.array([xxhash.xxh3_64_intdigest(w) % FEATURES for w in told], np.int64), return_inverse=True)
    m = len(used)
    items = [(i, np.array([codes_of[w] for w in words], np.int64), [codes_of[w] for w in answer]) for i, words, answer in got]
    features = [feature_of[words - 1] for _, words, _ in items]
    fixed = {"feature_of": feature_of, "m": m, "n_codes": len(told)}
    sent.append(share(fixed))
    df = _summed(coded, _frequencies(sent[-1], unit), 1)[:, 0]
    df, n = (df[:-1], df[-1]) if len(df) else (np.zeros(m), 0.0)
    keep, weight, other = kept_features(features, df, n, stop_share, least_terms)
    fixed |= {"keep": keep, "weight": weight, "other": other}
    width = min(m, rank + 16)
    omega = np.random.default_rng(seed).standard_normal((m, width))
    sent += [share(fixed), share({"omega": omega})]
    g = _summed(coded, _gram(sent[-2], unit), width, _times_omega(sent[-1]))
    for used_up in sent:
        used_up.destroy()  # all that needed them is written or summed
    if not len(g):
        g = np.zeros((m, width))

    strength = max(1.0, float(np.abs(np.diagonal(omega.T @ g)).max() / max(m, 1)))
    rows_ = Rows(features, weight)
    basis = latent_basis(g, omega, rows_, strength, min(rank, width))
    del g, omega
    # Rarest terms stand for the answer where none is given.
    for k, (i, words, answer) in enumerate(items):
        if not answer:
            own = np.unique(words)
            items[k] = (i, words, own[np.lexsort((own, df[feature_of[own - 1]]))[: max(1, min(4, len(words) // 4))]].tolist())
    around = max(float(weight.max()), other) ** 2
    parts = []
    for a, latent in zip(range(0, len(items), block_items), rows_.latent(basis, block_items)):
        block, own = items[a : a + block_items], features[a : a + block_items]
        least = [copy_score(latent[f, c] * weight[f], weight[f] ** 2, unit, around) for c, f in enumerate(own)]
        bound = np.maximum(tolerance * np.array(least) * (1 - 1e-4), 1e-6)
        held = share(fixed | {"items": block, "latent": latent.astype(np.float32), "bound": bound})
        # One block's vectors are alive at a time, however many items there are.
        parts.append(staged(coded.mapInArrow(_search(held, unit, lcs, least_words), FOUND), "benchmark-found"))
        held.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return named(out)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no item is found.

    What is dropped is a row of that id, or without id, and that text: a clean row stays, whatever id it has.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = contaminated(docs, benchmark, hashed=True, **options)
    return rows_apart(docs, found.select(F.col(id_col).alias("_id"), F.col("_h").alias("h")), "left_anti", id_col, text_col)
