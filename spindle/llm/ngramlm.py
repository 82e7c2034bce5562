"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The n-grams of the training texts, by order, are dealt by hash over shards.  A shard keeps its
n-grams in a trie of two levels: contexts (all words but the last, as fingerprints of 36 bits)
with pointers to their ranges of last words (fingerprints of 24 bits), and a 16-bit code of a
quantised probability for each last word.  All sequences are monotone and in Elias-Fano form:
a word is stored relative to its context, plus where the previous context's range ended.  A
shard's trie is one file, mapped into memory while it is queried, and never unpacked: an n-gram
is looked up by a successor search for its context, two pointers selected, and a successor
search for the context-relative word in the context's range, all on the high and low parts as
they lie in the file.  An n-gram that wasn't learned is taken for a learned one if both lie in
one shard and have equal fingerprints: with odds of (contexts of its last word in the shard) /
2**36 plus (words of its context in the shard) / 2**24, both bounded as shards are of bounded
size.  A shard is a range of the mixed fingerprints, so its number needn't be sent with each of
them.  Words themselves are 64-bit hashes.

No node ever needs the whole model: texts are packed into blocks of bounded size, each block
asks every shard once for its distinct n-grams (which also carry the block's training counts,
so one shuffle both builds and queries the model), and gets back a code for each.

The model interpolates orders; with c the training count, v the context without its first word:
    P1(w) = (c(w) + 1) / (N + V + 1)
    Pk(w | ctx) = (c(ctx w) + m * P(k-1)(w | v)) / (c(ctx) + m),  m = floor_k + slope_k * c(ctx)
so every order sums to one over the V known words and one unknown word.  A code stands for the
joint probability c / (N + V + 1) of an n-gram; as a context's words lie in many shards, the
division by the context's own code and the smoothing follow where the text is scored.  N, V and
the counts of order 1 are exact, higher ones are exact for counts to 2**14 and quantised in
steps of 0.08 % above.

Defined cases: a null or empty text is its end alone; a null id is scored, belongs to neither
part (held_out null) and isn't learned from; repeated rows are learned from and scored each;
without training rows every word has probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions_for
from .textkernel import Vocabulary, mix, narrow, pack, unmix, unpack, words

END, BOS = b"\n</s>", b"\n<s>"  # no word holds white space
EXACT = 1 << 14
STEP = np.log1p(1e-4)


# ------------------------------------------------- quantised probabilities


def quantise(counts: np.ndarray) -> np.ndarray:
    """Codes of 16 bits: counts to 2**14 themselves, larger ones on a geometric grid."""
    c = counts.astype(np.float64)
    big = EXACT + np.rint(np.log(np.maximum(c, EXACT) / EXACT) / STEP / 8)
    return np.where(counts <= EXACT, c, np.minimum(big, 65535)).astype(np.uint16)


def table_of_counts() -> np.ndarray:
    codes = np.arange(65536, dtype=np.float64)
    return np.where(codes <= EXACT, codes, EXACT * np.exp((codes - EXACT) * STEP * 8))


# ------------------------------------------------------------ Elias-Fano


def _select_table() -> np.ndarray:
    """[byte, r]: the place of the r-th one of a byte, lowest bit first."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    out = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        at = np.flatnonzero(bits[byte])
        out[byte, : len(at)] = at
    return out


SELECT = _select_table()


class EliasFano:
    """A monotone sequence of whole numbers: whole bytes of low bits, high bits in unary, and the ones before each 64 of these."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bytes = n, low_bytes
        self.low, self.high, self.ones = low.reshape(n, low_bytes), high.view("<u8"), ones.view("<u4")
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        wide = -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8)
        part = (values >> np.uint64(8 * wide)) if wide < 8 else np.zeros(n, np.uint64)
        size = (int(part[-1]) if n else 0) + n + 1
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[part.astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(high, bitorder="little")
        ones = np.cumsum(np.bitwise_count(high.view("<u8")), dtype=np.int64)
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :wide])
        return cls(n, wide, low.ravel(), high, np.r_[0, ones[:-1]].astype("<u4").view(np.uint8))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.low.ravel(), self.high.view(np.uint8), self.ones.view(np.uint8)

    @property
    def n_bytes(self) -> int:
        return sum(len(a) for a in self.arrays())

    def _nth(self, rank: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Places in the high part of the rank-th ones (zeros, if ``flip``)."""
        at = np.searchsorted(before, rank, "right") - 1
        word = self.high[at]
        octets = np.ascontiguousarray(~word if flip else word).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        rest = rank - before[at]
        octet = np.minimum((upto <= rest[:, None]).sum(axis=1), 7)
        row = np.arange(len(rank))
        rest = rest - np.where(octet > 0, upto[row, octet - 1], 0)
        return at * 64 + octet * 8 + SELECT[octets[row, octet], np.minimum(rest, 7)]

    def _lows(self, at: np.ndarray | slice) -> np.ndarray:
        low = self.low[at]
        out = np.zeros((len(low), 8), np.uint8)
        out[:, : self.low_bytes] = low
        return out.view("<u8").ravel()

    def select(self, at: np.ndarray) -> np.ndarray:
        """Values at the places ``at``."""
        high = (self._nth(at, self.ones, False) - at).astype(np.uint64)
        return self._lows(at) if self.low_bytes == 8 else self._lows(at) | (high << np.uint64(8 * self.low_bytes))

    def window(self, a: int, b: int) -> np.ndarray:
        """The values at places a to b (excluded)."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = self._nth(np.array([a, b - 1]), self.ones, False).tolist()
        bits = np.unpackbits(np.ascontiguousarray(self.high[first >> 6 : (last >> 6) + 1]).view(np.uint8), bitorder="little")
        at = np.flatnonzero(bits[first & 63 : last - (first >> 6 << 6) + 1]) + first
        low = self._lows(slice(a, b))
        return low if self.low_bytes == 8 else low | ((at - np.arange(a, b)).astype(np.uint64) << np.uint64(8 * self.low_bytes))

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of the first value in places first to last (excluded) that is at least x; ``last`` if there is none."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(8 * self.low_bytes)) if self.low_bytes < 8 else np.zeros(len(x), np.uint64)
        low = (x & np.uint64((1 << (8 * self.low_bytes)) - 1)) if self.low_bytes < 8 else x
        n_zeros = len(self.high) * 64 - self.n
        beyond = high >= n_zeros  # above all values
        high = np.minimum(high, np.uint64(n_zeros - 1)).astype(np.int64)
        # Values with these high bits lie between two zeros.
        begin = np.where(high > 0, self._nth(np.maximum(high - 1, 0), self.zeros, True) - (high - 1), 0)
        end = self._nth(high, self.zeros, True) - high
        begin, end = np.clip(begin, first, last), np.clip(end, first, last)
        begin = np.where(beyond, last, begin)
        live = np.flatnonzero(begin < end)
        a, b = begin[live], end[live]
        while len(live):
            middle = (a + b) >> 1
            less = self._lows(middle) < low[live]
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            begin[live] = a
            more = a < b
            live, a, b = live[more], a[more], b[more]
        return begin


class Trie:
    """Contexts, their pointers and context-relative words, and a 16-bit code for each word."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words_: EliasFano, codes: np.ndarray):
        self.parts, self.codes = (contexts, pointers, words_), codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Trie:
        """From n-grams sorted by (context, word), distinct."""
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
        pointers = np.r_[at, len(context)]
        ends = np.zeros(len(at), np.uint64)
        if len(at) > 1:
            ends = word[pointers[1:] - 1] + np.uint64(1)
        base = np.r_[np.uint64(0), np.cumsum(ends)[:-1]].astype(np.uint64) if len(at) else ends
        return cls(EliasFano.of(context[at]), EliasFano.of(pointers), EliasFano.of(word + np.repeat(base, np.diff(pointers))), codes.astype("<u2"))

    # One file: a header, then every array behind the other, each from a multiple of 8 bytes on.
    def save(self, path: str) -> None:
        arrays = [self.codes.view(np.uint8), *(a for p in self.parts for a in p.arrays())]
        head = [x for p in self.parts for x in (p.n, p.low_bytes)] + [len(a) for a in arrays]
        with open(path, "wb") as f:
            f.write(np.array(head, "<i8").tobytes())
            for a in arrays:
                f.write(a.tobytes() + bytes(-len(a) % 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        data = np.memmap(path, np.uint8, "r")
        head = data[: 16 * 8].view("<i8").tolist()
        at, arrays = 16 * 8, []
        for size in head[6:]:
            arrays.append(data[at : at + size])
            at += size + -size % 8
        parts = [EliasFano(*head[2 * i : 2 * i + 2], *arrays[3 * i + 1 : 3 * i + 4]) for i in range(3)]
        return cls(*parts, arrays[0].view("<u2"))

    def find(self, context: np.ndarray, word: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Codes of n-grams, sorted by context; 0 for those that the trie lacks.

        Each ``step`` of them lies in one stretch of the contexts: its ends are found by successor
        search.  If the stretch is about as long as the list of n-grams it is read through once,
        else each n-gram is searched by itself.
        """
        out = np.zeros(len(word), np.uint16)
        known, pointers, _ = self.parts
        for i in range(0, len(word) if known.n else 0, step):
            c, w = context[i : i + step], word[i : i + step]
            a = int(known.successor(c[:1], np.array([0]), np.array([known.n]))[0])
            b = int(known.successor(c[-1:] + np.uint64(1), np.array([a]), np.array([known.n]))[0])
            first, last = pointers.select(np.array([a, b])).tolist() if a < b else (0, 0)
            if a < b:
                out[i : i + step] = self._find_each(c, w) if last - first > 8 * len(w) + 64 else self._find_in(a, b, int(first), int(last), c, w)
        return out

    def _find_in(self, a: int, b: int, first: int, last: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """N-grams whose contexts can only be those of places a to b."""
        known, pointers, words_ = self.parts
        own, pointer = known.window(a, b), pointers.window(a, b + 1).astype(np.int64)
        begin = max(first - 1, 0)
        values = words_.window(begin, last)
        node = np.minimum(np.searchsorted(own, context), len(own) - 1)
        low, high = pointer[node], pointer[node + 1]
        target = np.where(low > 0, values[np.maximum(low - 1 - begin, 0)] + np.uint64(1), np.uint64(0)) + word
        at = np.searchsorted(values, target) + begin
        ok = (own[node] == context) & (at >= low) & (at < high)
        at = np.minimum(at, last - 1)
        ok &= values[at - begin] == target
        return np.where(ok, self.codes[at], 0).astype(np.uint16)

    def _find_each(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        known, pointers, words_ = self.parts
        none = np.zeros(len(word), np.int64)
        node = known.successor(context, none, none + known.n)
        ok = node < known.n
        node = np.minimum(node, known.n - 1)
        ok &= known.select(node) == context
        first, last = pointers.select(node).astype(np.int64), pointers.select(node + 1).astype(np.int64)
        # A range's words start where the last range ended.
        target = np.where(first > 0, words_.select(np.maximum(first, 1) - 1) + np.uint64(1), np.uint64(0)) + word
        at = words_.successor(target, first, last)
        ok &= at < last
        at = np.minimum(at, words_.n - 1)
        ok &= words_.select(at) == target
        return np.where(ok, self.codes[at], 0).astype(np.uint16)

    @property
    def n_bytes(self) -> int:
        return self.codes.nbytes + sum(p.n_bytes for p in self.parts)


# ---------------------------------------------------------------- blocks

CONTEXT_BITS, WORD_BITS = 36, 24
BITS = CONTEXT_BITS + WORD_BITS


def shard_width(shards: int) -> int:
    """Mixed fingerprints in a shard."""
    return -(-(1 << BITS) // shards)


def sent_key(mixed: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(place within the shard, shard) of mixed fingerprints."""
    if shards == 1:
        return mixed, np.zeros(len(mixed), np.int64)
    width = np.uint64(shard_width(shards))
    shard = mixed // width
    return mixed - shard * width, shard.astype(np.int64)


def fingerprints(key: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Contexts and words of the keys sent to a shard."""
    return unmix(key + np.uint64(shard * shard_width(shards) if shards > 1 else 0), 1, BITS)


def shard_of_word(key: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(key, 1) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


class Block:
    """The texts of a block as word hashes. n-grams are numbered by hash, so row order doesn't matter."""

    def __init__(self, texts: Iterable[bytes | None], learn: list[bool]):
        """``learn`` may be filled while ``texts`` are read."""
        seen = Vocabulary()
        bos, end = seen[BOS], seen[END]
        parts = []
        for text in texts:
            w = words(text)
            ids = np.empty(len(w) + 3, np.int32)
            ids[:2], ids[-1] = bos, end
            ids[2:-1] = np.fromiter(map(seen.__getitem__, w), np.int32, len(w))
            parts.append(ids)
        self.sizes = np.array([len(p) - 2 for p in parts], np.int64)
        starts = np.cumsum(self.sizes + 2) - self.sizes - 2
        self.hashes = seen.hashes()
        self.seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first = np.zeros(len(self.seq), bool)
        if len(starts):
            first[starts] = first[starts + 1] = True
        self.at = np.flatnonzero(~first)
        self.learn = np.repeat(np.array(learn, bool), self.sizes)

    def grams(self, order: int, shards: int):
        """(key, shard, inverse): the distinct n-grams by shard and key, and for each token the number of its own."""
        word = self.hashes[self.seq[self.at]]
        if order == 1:
            key, inverse = np.unique(word, return_inverse=True)
            shard = shard_of_word(key, shards)
            by = np.lexsort((key, shard))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            return key[by], shard[by], place[inverse]
        context = np.full(len(word), np.uint64(order))
        for i in range(order - 1, 0, -1):
            context = mix(context + self.hashes[self.seq[self.at - i]], i)
        both = ((context >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(WORD_BITS)) | (mix(word, 2) >> np.uint64(64 - WORD_BITS))
        del word, context
        u, inverse = np.unique(mix(both, 1, BITS), return_inverse=True)
        return *sent_key(u, shards), inverse


def planes(sorted_keys: np.ndarray) -> np.ndarray:
    """Gaps of sorted keys, byte by byte: the high bytes of gaps are nearly all 0."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).ravel()


def from_planes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _requests(block: int, held: Block, orders, shards: dict[int, int]):
    for order in orders:
        key, shard, inverse = held.grams(order, shards[order])
        counts = np.bincount(inverse[held.learn], minlength=len(key))
        del inverse
        cut = np.searchsorted(shard, np.arange(shards[order] + 1))
        for s, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                yield order, s, block, pack(planes(key[a:b]), narrow(counts[a:b]))


_REQUEST = pa.schema([("order", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
REQUEST = "order int, shard int, block int, blob binary"


def _rows(rows) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REQUEST)], schema=_REQUEST)


_DEALT = pa.schema([("block", pa.int32()), ("blob", pa.binary())])


def _deal(blocks: int, buffer: int = 8 << 20):
    """Texts packed by block. The block follows from the row, the partition and, for rows that repeat in it, their number."""

    def run(batches):
        task = TaskContext.get()
        here = np.uint64(mix(np.array([task.partitionId() if task else 0], np.uint64), 0)[0])
        times: dict[int, int] = {}
        held, size = [], 0

        def rows():
            out: tuple[list, list] = ([], [])
            for b, at in sorted(by.items()):
                part = [held[i] for i in at]
                texts = [r[2] or b"" for r in part]
                out[0].append(b)
                out[1].append(pack(
                    np.array([r[1] or 0 for r in part], np.int64), np.array([r[1] is None for r in part], np.uint8), np.array([bool(r[3]) for r in part], np.uint8),
                    np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8),
                ))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], schema=_DEALT)

        by: dict[int, list[int]] = {}
        for batch in batches:
            key = batch.column("_h").to_numpy().view(np.uint64)
            nth = np.zeros(len(key), np.uint64)
            for i, k in enumerate(key.tolist()):
                nth[i] = times[k] = times.get(k, -1) + 1
            own = (mix(key + here + nth * np.uint64(0x9E3779B97F4A7C15), 1) % np.uint64(blocks)).astype(np.int64).tolist()
            for b, doc, text, learn in zip(own, batch.column("_id").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_learn").to_pylist()):
                by.setdefault(b, []).append(len(held))
                held.append((b, doc, text, learn))
                size += len(text or b"")
                if size >= buffer:
                    yield rows()
                    held, by, size = [], {}, 0
        if held:
            yield rows()

    return run


def _read_block(table: pa.Table) -> tuple[Block, pa.Array]:
    """(the texts, their ids) of all rows of a block."""
    learn: list[bool] = []
    ids: list[pa.Array] = []

    def texts():
        for blob in table.column("blob"):
            doc, missing, flags, sizes, data = unpack(blob.as_py())
            learn.extend(flags.astype(bool).tolist())
            ids.append(pa.array(doc, pa.int64(), mask=missing.astype(bool)))
            end = np.cumsum(sizes).tolist()
            data = data.tobytes()
            yield from (data[a:b] for a, b in zip([0, *end], end))

    return Block(texts(), learn), pa.concat_arrays(ids)


def _ask(orders, shards):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        return _rows(_requests(block, _read_block(table)[0], orders, shards))

    return run


def _asked(table: pa.Table):
    """(blocks, sizes, keys, counts) of all requests to a shard."""
    got = [unpack(x) for x in table.column("blob").to_pylist()]
    keys = [from_planes(g[0]) for g in got]
    return table.column("block").to_pylist(), [len(k) for k in keys], np.concatenate(keys), np.concatenate([g[1].astype(np.int64) for g in got])


def _answer(shards: dict[int, int]):
    """Build the shard's trie from the counts of all blocks and answer each block from it."""

    def run(table: pa.Table) -> pa.Table:
        order, shard = table.column("order")[0].as_py(), table.column("shard")[0].as_py()
        blocks, sizes, keys, counts = _asked(table)
        if order > 1:
            keys = fingerprints(keys, shard, shards[order])
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, counts)
        low = np.uint64((1 << WORD_BITS) - 1)
        split = (lambda k: (np.zeros(len(k), np.uint64), k)) if order == 1 else (lambda k: (k >> np.uint64(WORD_BITS), k & low))
        fd, path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        try:
            Trie.build(*split(distinct[total > 0]), quantise(total[total > 0])).save(path)
            codes = Trie.open(path).find(*split(distinct))
        finally:
            os.unlink(path)
        if order == 1:  # exact: the counts come along
            codes = total * (codes > 0)
        codes = codes[inverse]
        cut = np.cumsum([0, *sizes])
        return _rows((order, shard, block, pack(narrow(codes[a:b]))) for block, a, b in zip(blocks, cut, cut[1:]))

    return run


def _count_words(shards: int, most: int = 1 << 20):
    """Counts of distinct words, sent on when there are ``most`` of them."""

    def rows(seen: Vocabulary, counts: np.ndarray):
        key = seen.hashes()
        shard = shard_of_word(key, shards)
        by = np.lexsort((key, shard))
        key, counts = key[by], counts[by]
        cut = np.searchsorted(shard[by], np.arange(shards + 1))
        yield from _rows((1, s, 0, pack(planes(key[a:b]), narrow(counts[a:b]))) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a).to_batches()

    def run(batches):
        seen, counts, ends = Vocabulary(), np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                w = words(text)
                ids = np.fromiter(map(seen.__getitem__, w), np.int32, len(w))
                ends += 1
                while len(seen) + 1 > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                np.add.at(counts, ids, 1)
            if len(seen) >= most:
                yield from rows(seen, counts[: len(seen)])
                seen, counts = Vocabulary(), np.zeros(1 << 16, np.int64)
        if ends:
            counts[seen[END]] += ends
        if seen:
            yield from rows(seen, counts[: len(seen)])

    return run


def _tally(table: pa.Table) -> pa.Table:
    _, _, keys, counts = _asked(table)
    return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([len(np.unique(keys))], pa.int64())})


SCORES = "_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, model_order int"


def _score(order: int, shards: dict[int, int], n: int, v: int, n_docs: int, floors, slopes):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "model_order": pa.array([], pa.int32())})
        held, ids = _read_block(left)
        answers = {(o, s): unpack(b)[0] for o, s, b in zip(right.column("order").to_pylist(), right.column("shard").to_pylist(), right.column("blob").to_pylist())}
        doc = np.repeat(np.arange(len(held.sizes)), held.sizes)
        first = np.r_[True, doc[1:] != doc[:-1]]
        counts_of = table_of_counts()
        p = context = None
        for k in range(1, order + 1):
            key, shard, inverse = held.grams(k, shards[k])
            codes = np.concatenate([answers[k, s] for s in np.unique(shard)]).astype(np.int64) if len(key) else np.zeros(0, np.int64)
            c = (codes if k == 1 else counts_of[codes])[inverse].astype(np.float64)
            if k == 1:
                known, count = c > 0, c
                p = (c + 1) / (n + v + 1)
            else:
                m = floors[k] + slopes[k] * context
                p = (c + m * p) / (context + m)
            # A token's context of the next order is the n-gram of this order that ends before it.
            context = np.where(first, float(n_docs), np.r_[0.0, c[:-1]])
        total = lambda x: np.bincount(doc, weights=x, minlength=len(held.sizes))
        return pa.table({
            "_id": ids, "n_tokens": pa.array(held.sizes), "n_known": pa.array(total(known).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(held.sizes), n, np.int64)), "base_score": pa.array(total(np.log10((count + 1) / (n + v + 1)))),
            "score": pa.array(total(np.log10(p))), "model_order": pa.array(np.full(len(held.sizes), order, np.int32)),
        })

    return run


def score_documents(
    docs: DataFrame,
    learn,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    block_bytes: int = 12 << 20,
    floors: dict[int, float] | None = None,
    slopes: dict[int, float] | None = None,
) -> DataFrame:
    """Score every row of ``docs`` by a model of the rows for which the column ``learn`` is true."""
    spark = docs.sparkSession
    bounded_batches(spark)
    floors, slopes = floors or {2: 2.0, 3: 1.0}, slopes or {2: 1.0, 3: 0.25}
    base = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn")
    )
    n_bytes, n_docs = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count_if("_learn")).first()
    blocks = partitions_for(n_bytes, block_bytes)
    shards = {k: max(1, blocks // 4) if k == 1 else blocks for k in range(1, order + 1)}
    tally = base.where("_learn").mapInArrow(_count_words(shards[1]), REQUEST).groupBy("shard").applyInArrow(_tally, "n long, v long")
    n, v = tally.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    keyed = base.withColumn("_h", F.xxhash64("_id", "_text"))
    dealt = keyed.mapInArrow(_deal(blocks), "block int, blob binary").repartition(min(blocks, 50_000), "block")  # a task may hold several blocks
    orders = list(range(1, order + 1))
    asked = dealt.groupBy("block").applyInArrow(_ask(orders, shards), REQUEST)
    answers = asked.groupBy("order", "shard").applyInArrow(_answer(shards), REQUEST)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, shards, n, v, n_docs, floors, slopes), SCORES)
