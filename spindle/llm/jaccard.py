"""Exact n-gram Jaccard join by T-occurrence search.

Two sets link when ``den * |A & B| >= num * |A | B|``.  Of a set of n shingles a partner must
hold at least T = ceil(num * n / den).  As in DivideSkip, a set's inverted lists are divided:
its T - 2 longest lists are left aside, the n - T + 2 short ones are merged by a heap, and sets
met at least twice among the short lists are candidates (by pigeonhole no partner is missed);
the long lists are then probed for each candidate by binary search, in the candidate's sorted
shingles, until the required overlap is reached or out of reach.

Lists are ordered by the smallest corpus count of a shingle's words, an upper bound on the
list's length.  The counts come from a table of fixed size (2**SKETCH_BITS counters, at most
16 MB); a collision only changes the order, never the result.

The lists are dealt by shingle first: there a list drops, for each of its sets as the query, the
members that can't link (by length, by 512 parity bits, or as joined already).  What is left of
the query's lists goes to the query's task, which merges them.

Size is kept in hand like this:
* equal sets are one class, found by a 128-bit fingerprint, so exact copies never form pairs;
* classes sharing a min-hash are first compared with one of them only, in ``LEADERS`` rounds,
  which joins most near copies; a list whose sets are all joined already needs no further pairs;
* a list of over ``BLOCK`` sets is cut by set size, so that only sizes that can link meet, and
  then dealt by pairs of blocks over many tasks; a query's candidates are dealt by ``SPAN``.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing
and is its own component; a row without id has a null component; repeated rows are copies of
each other; rows that share an id but not their text are different sets; an empty table gives
an empty result.  ``num / den`` must be over 1/2.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected, fresh, join_counted, rows_apart, staged
from .textkernel import Vocabulary, fold, mix, narrow, pack, shingles, unpack, words

SKETCH_BITS = 22
SLICES = 16
BLOCK = 512
SPAN = 100_000  # classes that the candidates of one merge lie among, on average
KEYS = 4
LEADERS = 1  # rounds of first comparisons
SHORT = 2  # occurrences asked of the short lists
CHUNK_BYTES = 8 << 20
SIGNATURE = 512


# ---------------------------------------------------------------- kernels


def required(n: int, m: int, num: int, den: int) -> int:
    """Least overlap of linked sets of n and m shingles: o/(n+m-o) >= num/den."""
    return -(-num * (n + m) // (num + den))


def merge_short(lists: list[list[int]], least: int) -> list[int]:
    """Members of at least ``least`` of the sorted lists, by a heap of the lists' heads."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while heap:
        top, n = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, i, at = heap[0]
            n += 1
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        if n >= least:
            out.append(top)
    return out


def probe_long(query: np.ndarray, candidate: np.ndarray, need: int, step: int = 256) -> bool:
    """Whether the candidate lies in at least ``need`` of the query's lists: each is probed in the candidate's sorted shingles."""
    if len(candidate) < len(query):
        query, candidate = candidate, query
    n, found = len(query), 0
    for i in range(0, n, step):
        if found + n - i < need:
            return False
        part = query[i : i + step]
        at = np.searchsorted(candidate, part)
        at[at == len(candidate)] = 0
        found += int((candidate[at] == part).sum())
        if found >= need:
            return True
    return found >= need > 0


def parity(s: np.ndarray) -> list[int]:
    """512 bits, each the parity of the shingles that fall on it: sets differ in at least as many shingles as bits."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def may_link(n, m, a, b, num: int, den: int):
    """The same test on columns: lengths and parities of two sets."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x.cast("int"))
    need = F.ceil((n + m) * num / (num + den))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (differ <= n + m - 2 * need)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _word_counts(batches):
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for text in _texts(batch.column("_text")):
            if w := words(text):
                seen = Vocabulary()
                ids = np.fromiter(map(seen.__getitem__, w), np.int64, len(w))
                at = (seen.hashes() & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
                np.add.at(total, at, np.bincount(ids))
    width = len(total) // SLICES
    yield pa.RecordBatch.from_pydict({"slice": list(range(SLICES)), "blob": [pack(narrow(total[i * width : (i + 1) * width])) for i in range(SLICES)]}, schema=pa.schema([("slice", pa.int32()), ("blob", pa.binary())]))


def _add_slices(table: pa.Table) -> pa.Table:
    total = sum(unpack(b.as_py())[0].astype(np.int64) for b in table.column("blob"))
    return pa.table({"slice": table.column("slice")[:1], "blob": pa.array([pack(narrow(total))], pa.binary())})


def word_counts(docs: DataFrame) -> np.ndarray:
    """Corpus counts of words in 2**SKETCH_BITS counters (a fixed size, whatever the corpus)."""
    parts = docs.select("_text").mapInArrow(_word_counts, "slice int, blob binary").groupBy("slice").applyInArrow(_add_slices, "slice int, blob binary")
    got = {r["slice"]: unpack(bytes(r["blob"]))[0].astype(np.int64) for r in parts.collect()}
    width = (1 << SKETCH_BITS) // SLICES
    return np.concatenate([np.minimum(got.get(i, np.zeros(width, np.int64)), (1 << 31) - 1).astype(np.int32) for i in range(SLICES)])


SETS = "_id long, h long, n long, f1 long, f2 long, mins array<long>, lists array<long>, signature array<long>"


def _set_rows(counts, k: int, num: int, den: int):
    def run(batches):
        table = counts.value
        for batch in batches:
            cols = {c: [] for c in ("_id", "h", "n", "f1", "f2", "mins", "lists", "signature")}
            for doc, h64, text in zip(batch.column("_id").to_pylist(), batch.column("h").to_pylist(), _texts(batch.column("_text"))):
                w = words(text)
                cols["_id"].append(doc)
                cols["h"].append(h64)
                if not w:
                    for c, v in (("n", 0), ("f1", 0), ("f2", 0), ("mins", []), ("lists", []), ("signature", [])):
                        cols[c].append(v)
                    continue
                seen = Vocabulary()
                ids = np.fromiter(map(seen.__getitem__, w), np.int64, len(w))
                h = seen.hashes()
                rare = table[(h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)][ids]
                s, first = np.unique(fold(h[ids], k), return_index=True)
                bound = rare[first]
                for i in range(1, min(k, len(w))):
                    bound = np.minimum(bound, rare[first + i])
                n = len(s)
                cols["n"].append(n)
                with np.errstate(over="ignore"):
                    cols["f1"].append(int(mix(s, 1).sum().view(np.int64)))
                    cols["f2"].append(int(mix(s + np.uint64(77), 2).sum().view(np.int64)))
                cols["mins"].append([int(mix(s ^ np.uint64(0x1234567 * (i + 1)), i).min().view(np.int64)) for i in range(KEYS)])
                take = min(n, n - -(-num * n // den) + SHORT)
                order = np.lexsort((s, bound))[:take]
                cols["lists"].append(s[order].view(np.int64).tolist())
                cols["signature"].append(parity(s))
            yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([("_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("mins", pa.list_(pa.int64())), ("lists", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))]))

    return run


def _verify(k: int, num: int, den: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"u": [], "v": []}
        if left.num_rows and right.num_rows:
            u = left.column("a")[0].as_py()
            base = shingles(_texts(left.column("base").combine_chunks())[0], k)
            for v, text in zip(right.column("v").to_pylist(), _texts(right.column("_text").combine_chunks())):
                s = shingles(text, k)
                if len(s) and probe_long(base, s, required(len(base), len(s), num, den)):
                    out["u"].append(u)
                    out["v"].append(v)
        return pa.table(out, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def _groups(batches, columns: list[str], rows: int = 20_000):
    """Tables of whole groups of equal ``columns`` from sorted batches."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table.column(c).to_numpy() for c in columns])
            same = (key == key[:, -1:]).all(axis=0)  # the last group may go on in the next batch
            n = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if n:
                yield table.slice(0, n)
            held, size = table.slice(n).to_batches(), table.num_rows - n
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    key = np.stack([table.column(c).to_numpy() for c in columns])
    return np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])


_SHORT = pa.schema([("u", pa.int64()), ("span", pa.int32()), ("list", pa.list_(pa.int64()))])


def _lists_for(num: int, den: int, spans: int):
    """Each list cut to what can link with each of its sets; rows are sorted by list."""
    keys = ["token", "g", "bi", "bj"]

    def run(batches):
        for table in _groups(batches, keys):
            ids, sizes, label, role = (table.column(c).to_numpy() for c in ("cls", "n", "label", "role"))
            bits = table.column("signature").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), SIGNATURE // 64)
            start = _starts(table, keys)
            group = np.repeat(np.arange(len(start)), np.diff(start, append=len(ids)))
            out_u, out_v, out_g = [], [], []
            live, d = np.arange(len(ids)), 1
            while True:
                live = live[live + d < len(ids)]
                live = live[group[live] == group[live + d]]
                if not len(live):
                    break
                i, j = live, live + d
                small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
                ok = (label[i] != label[j]) & (den * small >= num * large) & (role[i] + role[j] < 2)
                i, j = i[ok], j[ok]
                if len(i):
                    both = sizes[i] + sizes[j]
                    near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= both - 2 * (-(-num * both // (num + den)))
                    i, j = i[near], j[near]
                    out_u.append(np.minimum(ids[i], ids[j]))
                    out_v.append(np.maximum(ids[i], ids[j]))
                    out_g.append(group[i])
                d += 1
            if not out_u or not sum(map(len, out_u)):
                continue
            u, v, g = np.concatenate(out_u), np.concatenate(out_v), np.concatenate(out_g)
            span = ((v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % spans
            order = np.lexsort((v, span, u, g))
            u, v, g, span = u[order], v[order], g[order], span[order]
            first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (g[1:] != g[:-1]) | (span[1:] != span[:-1])])
            cut = pa.ListArray.from_arrays(pa.array(np.r_[first, len(v)].astype(np.int32)), pa.array(v))
            yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(span[first].astype(np.int32)), cut], schema=_SHORT)

    return run


def _merge(batches):
    """Merge each query's short lists: its candidates. Rows are sorted by query."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for table in _groups(batches, ["u", "span"]):
        start = _starts(table, ["u", "span"])
        query, lists = table.column("u").to_numpy(), table.column("list").to_pylist()
        out_u, out_v = [], []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(lists)]):
            if b - a >= SHORT and (found := merge_short(lists[a:b], SHORT)):
                out_u += [int(query[a])] * len(found)
                out_v += found
        if out_u:
            yield pa.RecordBatch.from_pydict({"u": out_u, "v": out_v}, schema=schema)


# ---------------------------------------------------------------- operator


def _verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, name: str, k: int, num: int, den: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of classes that link. A u with many partners is compared in chunks of about 256."""
    pairs = staged(pairs, f"{name}-pairs")
    per = pairs.groupBy("u").agg(F.count("*").alias("c"))
    n = pairs.count()
    dealt = join_counted(pairs, per.select("u", F.ceil(F.col("c") / 256).cast("int").alias("chunks"), "c"), ["u"], "c", n)
    dealt = staged(dealt.select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk")), f"{name}-dealt")
    wanted = dealt.select(F.col("u").alias("cls")).unionAll(dealt.select(F.col("v").alias("cls"))).distinct()
    needed = staged(reps.select("cls", "_id", "h").join(wanted, "cls", "left_semi"), f"{name}-needed")
    n_needed = needed.count()
    held = staged(texts.join(F.broadcast(needed) if n_needed <= 1_000_000 else needed, ["_id", "h"]).select("cls", "_text"), f"{name}-texts")  # at most 24 MB of ids
    if held.count() > n_needed:  # repeated rows
        held = staged(held.dropDuplicates(["cls"]), f"{name}-texts")
    left = dealt.select("u", "chunk").distinct().join(held.withColumnRenamed("cls", "u"), "u").select(F.col("u").alias("a"), F.col("chunk").alias("part"), F.col("_text").alias("base"))
    right = dealt.join(held.withColumnRenamed("cls", "v"), "v").select("u", "chunk", "v", "_text")
    return left.groupBy("a", "part").cogroup(right.groupBy("u", "chunk")).applyInArrow(_verify(k, num, den), "u long, v long")


def _candidates(joined: DataFrame, n_reps: int, num: int, den: int) -> DataFrame:
    """(u, v): classes of different labels that meet at least twice in their short lists."""
    lists = joined.select(F.explode("lists").alias("token"), "cls", "label", "n")
    open_ = staged(lists.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c")).where("a <> b").select("token", "c", F.col("c").alias("held")), "jaccard-open")
    n_entries = joined.agg(F.sum(F.size("lists"))).first()[0] or 0
    entries = join_counted(lists.select("token", "cls", "n"), open_, ["token"], "c", n_entries)
    # Sets that link differ in size by one step at most; only long lists are worth the cut.
    width = float(np.log(den / num)) * (1 + 1e-9) if num < den else 1e-9
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")
    small = entries.where(F.col("held") <= BLOCK).select("token", "cls", F.lit(-2).cast("long").alias("g"), F.lit(0).alias("role"), F.lit(1).alias("blocks"))
    large = entries.where(F.col("held") > BLOCK).select("token", "cls", F.explode(F.array(F.struct(step.alias("g"), F.lit(0).alias("role")), F.struct((step - 1).alias("g"), F.lit(1).alias("role")))).alias("x"))
    large = staged(large.select("token", "cls", "x.g", "x.role"), "jaccard-long-lists")
    counted = large.groupBy("token", "g").agg(F.count("*").alias("c"), F.max(F.col("role") == 0).alias("own")).where("own").select("token", "g", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"), "c")
    large = join_counted(large, counted, ["token", "g"], "c", large.count()).select(*small.columns)
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = small.unionByName(large).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", "g", "role", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "cls")
    dealt = dealt.join(joined.select("cls", "n", "label", "signature"), "cls")
    keys = ["token", "g", "bi", "bj"]
    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys, "cls").select(*keys, "cls", "role", "n", "label", "signature")
    spans = max(1, -(-n_reps // SPAN))
    short = sorted_.mapInArrow(_lists_for(num, den, spans), "u long, span int, list array<long>")
    return short.repartition("u", "span").sortWithinPartitions("u", "span").mapInArrow(_merge, "u long, v long")


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(_id, h, n, keeper, n_copies): ``h`` hashes the text, ``keeper`` is the smallest (id, h) of the component."""
    if not 0 < num <= den < 2 * num:
        raise ValueError("the similarity must be over 1/2 and at most 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("_text"))
    counts = spark.sparkContext.broadcast(word_counts(base))
    sets = staged(base.mapInArrow(_set_rows(counts, k, num, den), SETS), "jaccard-sets")
    full = sets.where("n > 0 and _id is not null")
    total = full.count()
    # Equal sets are one class; its smallest row stands for it.
    classes = full.groupBy("f1", "f2").agg(F.min(F.struct("_id", "h")).alias("rep"), F.count("*").alias("copies"))
    classes = staged(classes.select("f1", "f2", "rep._id", "rep.h", "copies", F.monotonically_increasing_id().alias("cls")), "jaccard-classes")
    same = ["_id", "h", "f1", "f2"]
    reps = full.join(classes.select(*same, "cls"), same).dropDuplicates(same)
    reps = staged(reps.select("cls", "_id", "h", "n", "mins", "lists", "signature"), "jaccard-reps")
    texts = base.where("_id is not null")
    n_reps = reps.count()
    # First comparisons: with one set of each min-hash, the smallest row (originals tend to come
    # before their copies); in further rounds with another, for those that are still apart from it.
    keyed = reps.select("cls", "n", "signature", F.struct("_id", "h").alias("first"), F.posexplode("mins").alias("at", "key"))
    early, labels = None, None
    for turn in range(LEADERS):
        rank = F.col("first") if turn == 0 else F.xxhash64("cls", F.lit(turn))
        known = keyed.withColumn("label", F.col("cls")) if labels is None else keyed.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        leaders = known.groupBy("at", "key").agg(
            F.min_by(F.struct("cls", "n", "signature", "label"), F.struct(rank, "cls")).alias("lead"), F.count("*").alias("c"), F.min("label").alias("a"), F.max("label").alias("b")
        ).where("a <> b").drop("a", "b")
        asked = join_counted(known, leaders, ["at", "key"], "c", KEYS * n_reps).where(F.col("lead.label") != F.col("label"))
        asked = asked.where(may_link(F.col("n"), F.col("lead.n"), F.col("signature"), F.col("lead.signature"), num, den))
        asked = asked.select(F.least("lead.cls", "cls").alias("u"), F.greatest("lead.cls", "cls").alias("v")).distinct()
        found = staged(_verified(asked, texts, reps, "jaccard-first", k, num, den), "jaccard-early")
        early = found if early is None else early.unionAll(found)
        labels = staged(connected(early, "jaccard-a"), "jaccard-labels")
    joined = staged(
        reps.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "lists", "signature", F.coalesce("label", "cls").alias("label")),
        "jaccard-joined",
    )
    # Then the short lists that still hold sets of different components.
    pairs = _candidates(joined, n_reps, num, den)
    late = staged(_verified(pairs, texts, reps, "jaccard-late", k, num, den), "jaccard-late")
    labels = staged(connected(early.unionAll(late), "jaccard-b").join(classes.select(F.col("cls").alias("node"), "_id", "h"), "node"), "jaccard-linked")
    keepers = labels.groupBy("label").agg(F.min(F.struct("_id", "h")).alias("keeper"), F.count("*").alias("c"))
    linked = join_counted(labels.select("node", "label"), keepers, ["label"], "c", labels.count()).select(F.col("node").alias("cls"), "keeper")
    named = classes.join(linked, "cls", "left").select("f1", "f2", "copies", F.coalesce("keeper", F.struct("_id", "h")).alias("keeper"), F.col("copies").alias("n_copies"))
    found = join_counted(full.select("_id", "h", "n", "f1", "f2"), staged(named, "jaccard-named"), ["f1", "f2"], "copies", total)
    alone = sets.where("n = 0 or _id is null").select("_id", "h", "n", F.struct("_id", "h").alias("keeper"), F.lit(1).cast("long").alias("n_copies"))
    return found.select("_id", "h", "n", "keeper", "n_copies").unionByName(alone)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, n_copies) for every row of ``docs``."""
    found = _components(docs, id_col, text_col, k, num, den)
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("keeper._id").alias("component_id"), "n_copies")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that of the smallest id (and, of one id, the smallest hash of the text).

    Documents without words or id link with nothing and stay; of repeated rows one stays.
    """
    found = staged(_components(docs, id_col, text_col, k, num, den).select("_id", "h", "n", "keeper"), "jaccard-found")
    kept = rows_apart(docs, found.where(F.col("keeper") != F.struct("_id", "h")), "left_anti", id_col, text_col)
    repeated = found.where(F.col("_id").isNotNull()).groupBy("_id", "h").agg(F.count("*").alias("c")).where("c > 1")
    if repeated.isEmpty():
        return kept
    again = staged(repeated, "jaccard-repeated")
    [hashed] = fresh(docs, "h")
    one = rows_apart(kept, again, "left_semi", id_col, text_col).withColumn(hashed, F.xxhash64(text_col)).dropDuplicates([id_col, hashed]).drop(hashed)
    return rows_apart(kept, again, "left_anti", id_col, text_col).unionByName(one)
