"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

A source's target says how many of its words the mix takes.  Each document first gets the
whole copies that are certain, then a source's fractional rest is drawn as an order sample:
documents are ranked by their random odds u/(1-u) divided by their inclusion odds p/(1-p),
and the ranking's head is taken, as long as its words don't exceed the words that the source
still lacks.  So that the sample's size in words is fixed, one more document closes the gap: of
those left over, the one whose size comes nearest to it, if that is nearer than none.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last;
repeated rows are drawn as so many documents; ties in rank go to the smaller id, then the
smaller size; an empty table gives an empty result; extra columns stay, and columns whose
names clash with results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, join_checked, same_row, staged, unit_hash

#: Ranks are looked up through this many equal bins of the logistic scale; only the bin that holds a source's cut is ranked row by row.
BINS = 4096


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``target`` for rows (key, source, source_size): water filling under the cap ``most * source_size``.

    One row per source goes through one global ranking.  Sums are integers, so reruns agree.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    wheel = F.array(*[F.lit(w) for w in weights])
    ranked = staged(
        sources.withColumn("weight", F.element_at(wheel, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))),
        "mix-sources",
    )
    total = ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0
    level, capped_before = 0.0, -1
    cap = F.col("source_size") * F.lit(most)
    while True:
        above = (F.col("weight") * F.lit(level) >= cap) if capped_before >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum(F.when(above, F.col("source_size").cast("decimal(38,0)"))).alias("held"),
            F.sum(F.when(~above, F.col("weight").cast("long"))).alias("free"),
            F.count_if(above).alias("n"),
        ).first()
        if row.n == capped_before or not row.free:
            break
        level = max(level, (float(total) * share - float(row.held or 0) * most) / row.free)
        capped_before = row.n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def pareto_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies).

    Expected copies of a document are target/source_size on average.  In the fractional part f,
    inclusion probabilities lie between f*f and f*(2-f), lower for longer documents, and are
    centred so that the expected words are exactly the source's rest.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    base = docs.drop(*[c for c in made if c in docs.columns])
    slim = staged(
        base.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(text_col)).alias("_text"),
        ),
        "mix-sizes",
    )
    sources = source_targets(
        slim.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
        weights, share, most,
    )
    n_sources = sources.count()
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.select(
        "_key", "source_size", "target", mean.alias("_mean"),
        F.floor(ratio + F.lit(1e-9)).alias("_whole"),
        F.greatest(F.lit(0.0), F.col("target") - F.floor(ratio + F.lit(1e-9)) * F.col("source_size")).alias("_rest"),
    ).withColumn("_part", F.when(F.col("source_size") > 0, F.col("_rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    rows = join_checked(slim, sources, ["_key"], "inner", n_sources)
    length = F.floor(F.col("size") / (F.col("size") + F.col("_mean")) * 1_000_000)
    rows = rows.withColumn("_length", length)
    centre = rows.groupBy("_key").agg(F.sum((F.col("_length") * F.col("size")).cast("decimal(38,0)")).alias("_sum"), F.sum("size").alias("_all")).select(
        "_key", F.when(F.col("_all") > 0, F.col("_sum").cast("double") / F.col("_all")).otherwise(F.lit(0.0)).alias("_centre")
    )
    rows = join_checked(rows, centre, ["_key"], "inner", n_sources)
    f = F.col("_part")
    p = f + f * (1 - f) * (F.col("_centre") - F.col("_length")) / 1_000_000
    # Rows without id are told apart by their texts.
    u = F.when(F.col("_id").isNull(), unit_hash(F.col("_text"), F.lit(seed))).otherwise(unit_hash(F.col("_id"), F.lit(seed)))
    rank = F.log(u / (1 - u)) - F.log(p / (1 - p))
    drawn = (F.col("_rest") >= 0.5) & (p > 0) & (p < 1) & (F.col("size") > 0)
    rows = staged(
        rows.withColumn("_rank", F.when(drawn, rank)).withColumn("_bin", F.floor(F.lit(BINS) / (1 + F.exp(-F.col("_rank")))).cast("int"))
        .select("_key", "_id", "_text", "size", "source_size", "target", "_whole", "_rest", "_rank", "_bin"),
        "mix-ranks",
    )
    bins = rows.where(F.col("_rank").isNotNull()).groupBy("_key", "_bin").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    upto = F.sum("_words").over(Window.partitionBy("_key").orderBy("_bin"))
    cuts = (
        bins.withColumn("_before", upto - F.col("_words"))
        .where((F.col("_before") <= F.col("_rest")))
        .groupBy("_key").agg(F.max("_bin").alias("_cut"), F.max("_before").alias("_before"))
    )
    rows = join_checked(rows, cuts, ["_key"], "left", n_sources)
    inside = F.col("_rank").isNotNull() & (F.col("_bin") == F.col("_cut"))
    edge = rows.where(inside)
    head = F.sum("size").over(Window.partitionBy("_key", "_bin").orderBy("_rank", "_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("_pick", F.col("_before") + F.coalesce(head, F.lit(0)) + F.col("size") <= F.col("_rest"))
    rest = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("_pick", F.coalesce(F.col("_rank").isNotNull() & (F.col("_bin") < F.col("_cut")), F.lit(False)))
    chosen = staged(edge.unionByName(rest), "mix-chosen")
    # The closing document: sizes are compared by source, so each task passes on one row for each source.
    gaps = chosen.where(F.col("_rank").isNotNull()).groupBy("_key").agg(F.first("_rest").alias("_rest"), F.sum(F.when(F.col("_pick"), F.col("size")).otherwise(0)).alias("_got"))
    gaps = gaps.select("_key", (F.col("_rest") - F.col("_got")).alias("_gap"))
    left = join_checked(chosen.where(F.col("_rank").isNotNull() & ~F.col("_pick")), gaps, ["_key"], "inner", n_sources)
    miss = F.abs(F.col("_gap") - F.col("size"))
    closing = left.where(miss < F.col("_gap")).groupBy("_key").agg(F.min(F.struct(miss.alias("miss"), "_rank", "_id", "_text")).alias("_close")).select("_key", F.struct("_close._rank", "_close._id", "_close._text").alias("_close"))
    chosen = join_checked(chosen, closing, ["_key"], "left", n_sources)
    closes = ~F.col("_pick") & F.coalesce(F.struct("_rank", "_id", "_text") == F.col("_close"), F.lit(False))
    # Of rows that repeat wholly only one may close.
    first = F.row_number().over(Window.partitionBy("_key", "_id", "_text").orderBy("_rank")) == 1
    once = chosen.where(closes).withColumn("_one", first).withColumn("_pick", F.col("_one")).drop("_one")
    chosen = once.unionByName(chosen.where(~closes)).withColumn("copies", F.col("_whole") + F.col("_pick").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return chosen.select("_id", "_text", *made)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    times, over, nth, copy = fresh(docs, "times", "over", "nth", "copy")
    plan = pareto_mix(docs, **options).groupBy("_id", F.col("_text").alias("h")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n"))
    # Rows that repeat wholly share their copies: the first of them get the rest of the division.
    plan = staged(plan.where("_copies > 0").select("_id", "h", F.floor(F.col("_copies") / F.col("_n")).cast("int").alias(times), F.pmod("_copies", "_n").alias(over)), "mix-plan")
    if plan.count() <= 500_000:  # 14 MB
        plan = F.broadcast(plan)
    out = docs.join(plan, same_row(docs, plan, id_col, text_col), "inner").drop(plan["_id"], plan["h"])
    # Only rows that share a rest are told apart, which takes a window; all others stay where they are.
    ranked = out.where(F.col(over) > 0).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(over)))
    even = out.where(F.col(over) == 0).unionByName(ranked.withColumn(times, F.col(times) + (F.col(nth) <= F.col(over)).cast("int")).drop(nth))
    return even.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, over, copy)
