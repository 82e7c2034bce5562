"""Language identification by Bayesian evidence fusion.

Each row's evidence is fused in log space into a posterior over the languages and "zxx" (no
language: all trigrams alike):
* text: a naive Bayes likelihood of byte trigrams, in 2**16 hashed cells, of the whole text;
  trigrams overlap and repeat, so the likelihood is tempered to ``text_weight`` nats a trigram's
  nat and at most ``text_most`` nats in all between two languages;
* the language declared in the markup, and the address suffix: likelihoods of what is declared
  given the language, smoothed counts over all rows;
* the host: a prior smoothed up a hierarchy, host to domain to suffix to all rows, each level
  adding ``kappa`` rows' worth of the level above.
The counts are grouped aggregations in which each row counts for the language its text alone
speaks for; a row's own verdict is taken out of the counts that it meets again.  Documents
have no markup: their ``lang`` column labels the rows that the text model is fitted on and is no
evidence.  The text model is fitted on at most ``train_rows`` labelled rows for each language
(those of smallest hash); everything else covers all rows.

A row is rejected if "zxx" wins, if no language reaches ``least``, or if the row has no trigram
and nothing else speaks for a language.

Defined cases: a null or empty text has likelihood 1 for all languages, so the other evidence
decides; null or unknown declarations, suffixes and hosts speak for nothing; repeated rows are
judged each; ties go to the language first in code point order; with no labelled rows all rows
are rejected; an empty table gives an empty result; columns that clash with results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_counted, rows_apart, staged

CELLS = 1 << 16
NONE = "zxx"


def trigram_cells(text: bytes | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def _counts(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS, np.int64)
    for text in table.column("_text").cast(pa.binary()).to_pylist():
        total += np.bincount(trigram_cells(text), minlength=CELLS)
    return pa.table({"_lang": table.column("_lang")[:1], "_part": table.column("_part")[:1], "cells": [total.astype("<i8").tobytes()]})


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(cells, "<i8") for cells in table.column("cells").to_pylist())
    return pa.table({"_lang": table.column("_lang")[:1], "cells": [total.astype("<i8").tobytes()]})


def fit_text_model(docs: DataFrame, text_col: str = "text", label_col: str = "lang", train_rows: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [cell, language]) from at most ``train_rows`` rows a language.

    A row takes part if its hash falls into the first ``train_rows`` of its language's rows on average.
    """
    base = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["_lang"]: r["n"] for r in base.groupBy(F.col(label_col).alias("_lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((CELLS, 0))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, train_rows / n)))])
    u = F.pmod(F.xxhash64(F.col(text_col), F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    taken = base.where(u < F.element_at(share, F.col(label_col))).select(F.col(label_col).alias("_lang"), F.pmod(F.xxhash64(text_col), F.lit(8)).cast("int").alias("_part"), F.col(text_col).alias("_text"))
    # Summed again by language before they leave the executors: the driver gets one table of cells a language.
    parts = taken.groupBy("_lang", "_part").applyInArrow(_counts, "_lang string, _part int, cells binary")
    parts = parts.groupBy("_lang").applyInArrow(_summed, "_lang string, cells binary").collect()
    langs = sorted(sizes)
    total = np.zeros((CELLS, len(langs)))
    for r in parts:
        total[:, langs.index(r["_lang"])] += np.frombuffer(bytes(r["cells"]), "<i8")
    smooth = 0.5
    return langs, np.log((total + smooth) / (total.sum(axis=0) + smooth * CELLS))


def _likelihoods(model, noise: float):
    def run(batches):
        table = model.value
        for batch in batches:
            out = []
            for text in batch.column("_text").cast(pa.binary()).to_pylist():
                cells = trigram_cells(text)
                ll = np.zeros(table.shape[1])
                for i in range(0, len(cells), 1 << 16):
                    ll += table[cells[i : i + (1 << 16)]].sum(axis=0)
                out.append([*ll.tolist(), noise * len(cells)])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "_ll"])

    return run


def _smoothed(counts: Column, prior: Column, kappa: float) -> Column:
    """Posterior mean of shares: counts plus ``kappa`` rows of the prior."""
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + kappa * p) / (n + kappa))


def identify(
    rows: DataFrame,
    model: tuple[list[str], np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = None,
    suffix_col: str | None = None,
    host_col: str | None = None,
    domain_col: str | None = None,
    text_weight: float = 0.25,
    text_most: float = 40.0,
    noise: float = -float(np.log(CELLS)),
    noise_prior: float = 0.01,
    kappa: float = 20.0,
    least: float = 0.5,
) -> DataFrame:
    """(id, host, domain, language, posterior, text_language, declared, accepted, _h) for every row; ``_h`` hashes the text."""
    spark = rows.sparkSession
    bounded_batches(spark)
    langs, table = model
    names = [*langs, NONE]
    k = len(names)
    column = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    declared = F.lower(F.substring_index(F.substring_index(column(declared_col), "-", 1), "_", 1))
    slim = rows.select(
        F.col(id_col).cast("long").alias("_id"), declared.alias("_declared"), F.lower(column(suffix_col)).alias("_suffix"),
        F.lower(column(host_col)).alias("_host"), F.lower(column(domain_col)).alias("_domain"), F.xxhash64(text_col).alias("_h"), F.col(text_col).cast("string").alias("_text"),
    )
    held = spark.sparkContext.broadcast(table.astype(np.float32))
    schema = "_id long, _declared string, _suffix string, _host string, _domain string, _h long, _ll array<double>"
    scored = slim.mapInArrow(_likelihoods(held, noise), schema)
    # Tempered: differences to the best language, scaled and bounded.
    best = F.array_max("_ll")
    scored = scored.withColumn("_text_ll", F.transform("_ll", lambda x: F.greatest(F.lit(-text_most), (x - best) * text_weight)))
    top = F.when(F.array_max("_ll") < 0, F.array_position("_ll", F.array_max("_ll")).cast("int"))
    scored = staged(scored.withColumn("_top", top).drop("_ll"), "lang-text")
    held.destroy()  # the likelihoods are written
    one_hot = [F.sum(F.when(F.col("_top") == i + 1, 1.0).otherwise(0.0)) for i in range(k)]

    def counted(key: str, above: str | None = None) -> DataFrame:
        """(key, n, c[, above]): rows and verdicts for each value of ``key``."""
        more = [F.min(above).alias(above)] if above else []
        return scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array(*one_hot).alias("c"), *more)

    total, *by_lang = scored.agg(F.count("*"), *one_hot).first()
    by_lang = [float(x or 0) for x in by_lang]
    flat = [(1 - noise_prior) / max(k - 1, 1)] * (k - 1) + [noise_prior]
    overall = [(c + kappa * p) / (sum(by_lang) + kappa) for c, p in zip(by_lang, flat)] if total else [1.0 / k] * k

    def likelihood(key: str, name: str) -> DataFrame:
        """P(key | language): columns of the same counts, smoothed by the value's share of all rows."""
        return staged(counted(key).select(key, "n", F.col("c").alias(name), (F.col("n") / F.lit(float(max(total, 1)))).alias(f"{name}_share")), f"lang{key}")

    # What rows don't have at all needs no tables: levels and likelihoods of columns that aren't given stay null.
    null = F.lit(None).cast("array<double>")
    above = counted("_domain", "_suffix").withColumn("_c3", null)
    if suffix_col:
        above = above.drop("_c3").join(counted("_suffix").select("_suffix", F.col("c").alias("_c3")), "_suffix", "left")
    sides = []
    if host_col:
        hosts = counted("_host", "_domain").join(above.select("_domain", F.col("c").alias("_c2"), "_c3"), "_domain", "left")
        sides.append(("_host", staged(hosts.select("_host", "n", F.col("c").alias("_c1"), "_c2", "_c3"), "lang-hosts")))
    for given, key, name in ((declared_col, "_declared", "_from_declared"), (suffix_col, "_suffix", "_from_suffix")):
        if given:
            sides.append((key, likelihood(key, name)))
    out = scored
    for key, side in sides:
        # Few values (20,000 rows of counts are some MB) go to every task; else hot ones part from the rest.
        out = out.join(F.broadcast(side.drop("n")), key, "left") if side.count() <= 20_000 else join_counted(out, side, [key], "n", max(total, 1), "left")
    for name in ("_c1", "_c2", "_c3", "_from_declared", "_from_suffix"):
        if name not in out.columns:
            out = out.withColumn(name, null)
    for name in ("_from_declared_share", "_from_suffix_share"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    zeros = F.array(*[F.lit(0.0)] * k)
    own = F.array(*[F.when(F.col("_top") == i + 1, 1.0).otherwise(0.0) for i in range(k)])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    others = lambda c: F.zip_with(c, own, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    # One column a level: an expression that holds the level above twice would double with every level.
    out = out.withColumn("_shares", F.array(*[F.lit(float(x)) for x in overall]))
    for level in ("_c3", "_c2", "_c1"):
        out = out.withColumn("_met", others(F.col(level))).withColumn("_shares", F.when(F.col(level).isNotNull(), _smoothed(F.col("_met"), F.col("_shares"), kappa)).otherwise(F.col("_shares")))
    prior = F.transform("_shares", lambda p: F.log(F.greatest(p, F.lit(1e-9))))
    sizes = F.zip_with(F.array(*[F.lit(x) for x in by_lang]), own, lambda s, y: F.greatest(s - y, F.lit(0.0)))

    def spoken(name: str) -> Column:
        """What no language declares can't speak for "zxx": it is judged by its text alone there."""
        said = F.zip_with(others(F.col(name)), sizes, lambda c, s: F.log((c + kappa * F.col(f"{name}_share")) / (s + kappa)))
        return F.coalesce(F.transform(said, lambda x, i: F.when(i == k - 1, F.lit(0.0)).otherwise(x)), zeros)

    fused = add(add(F.col("_text_ll"), prior), add(spoken("_from_declared"), spoken("_from_suffix")))
    peak = F.array_max("_fused")
    mass = F.aggregate("_fused", F.lit(0.0), lambda a, x: a + F.exp(x - peak))
    labels = F.array(*[F.lit(x) for x in names])
    out = out.withColumn("_fused", fused).withColumn("_best", F.array_position("_fused", peak).cast("int")).withColumn("posterior", F.lit(1.0) / mass)
    language = F.element_at(labels, F.col("_best"))
    silent = F.col("_top").isNull() & F.col("_c1").isNull() & F.col("_from_declared").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_domain").alias("domain"), language.alias("language"), "posterior",
        F.when(F.col("_top").isNotNull(), F.element_at(labels, F.coalesce("_top", F.lit(1)))).alias("text_language"), F.col("_declared").alias("declared"),
        ((language != NONE) & (F.col("posterior") >= least) & ~silent & F.lit(bool(langs))).alias("accepted"), "_h",
    )


# ------------------------------------------------------------ web pages


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text, declared, host, domain (its last three labels) and suffix taken from address and markup."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]{1,8};", " ")
    host = F.nullif(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))
    return pages.withColumns({
        "text": bare, "declared": F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z_-]+)", 1), F.lit("")),
        "host": host, "domain": F.substring_index(host, ".", -3), "suffix": F.substring_index(host, ".", -1),
    })


def document_evidence(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """``docs`` with a host (the source) and a domain (the source without its number)."""
    return docs.withColumns({"_hosted": F.col(source_col), "_domain_of": F.regexp_replace(F.col(source_col), "[0-9]+$", "")})


def identify_documents(docs: DataFrame, model, **options) -> DataFrame:
    return identify(document_evidence(docs), model, host_col="_hosted", domain_col="_domain_of", **options)


def accepted_documents(docs: DataFrame, model=None, **options) -> DataFrame:
    """Rows of ``docs`` whose language is identified."""
    judged = identify_documents(docs, model or fit_text_model(docs), **options)
    return rows_apart(docs, judged.where(~F.col("accepted")).select(F.col("doc_id").alias("_id"), F.col("_h").alias("h")))
