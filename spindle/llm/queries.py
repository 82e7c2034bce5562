"""The queries of this subpackage, by name, and the SQL that expresses some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramlm import score_documents

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    scored = score_documents(table(spark, sf_dir, "documents"), learn=~held_out, order=3).withColumnRenamed("_id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "model_order")


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    out = perspectives(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "perspective", "part", "sub", "n_turns", "n_masked", "mask", F.size("spans").cast("long").alias("n_spans"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pareto_mix

    return pareto_mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), share=1.0, most=3.0).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source as host) and web pages (markup, address). A page's doc_id is -1 - page_id."""
    from .langid import fit_text_model, identify, identify_documents, page_evidence

    docs = table(spark, sf_dir, "documents")
    model = fit_text_model(docs)
    found = identify_documents(docs, model)
    pages = page_evidence(table(spark, sf_dir, "pages")).withColumn("doc_id", -1 - F.col("page_id"))
    pages = identify(pages, model, declared_col="declared", suffix_col="suffix", host_col="host", domain_col="domain")
    kept = ["doc_id", "host", "language", "posterior", "text_language", "declared", "accepted"]
    return found.select(*kept, F.lit("document").alias("kind")).unionAll(pages.select(*kept, F.lit("page").alias("kind")))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenstore import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "at", F.length("word").cast("long").alias("n_chars"), F.sha2("word", 256).alias("word_sha256"), "score")


def op7_vp_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), queries=F.pmod(F.col("vec_id"), F.lit(100)) == 0, k=10, factor=1.0)


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edit_likeness

    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return edit_likeness(table(spark, sf_dir, "documents")).withColumns(hexed)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import audited

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = audited(docs, docs.columns, [*[F.col(c) for c in docs.columns[:-1]], text])
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, repair

    out = repair(damaged(table(spark, sf_dir, "conversations")), there=F.col("_there"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lower(F.hex("repaired")).alias("repaired_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
freq AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT keyed.doc_id, pos, line, freq.k IS NOT NULL AS dropped
  FROM keyed LEFT JOIN freq ON keyed.k = freq.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who,
         replace(replace(coalesce(text, ''), '<|', '\<|'), '|>', '\|>') AS t
  FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM turns WHERE who <> 'system'),
seen AS (
  SELECT p.conv_id, p.perspective, t.turn, t.who, t.t,
         CASE WHEN t.who = 'system' THEN '<|system|> ' WHEN t.who = p.perspective THEN '<|assistant|> '
              ELSE '<|user|> ' || t.who || ': ' END || t.t || '<|end|>' AS line,
         CASE WHEN t.who = p.perspective THEN 1 ELSE 0 END AS mine,
         CAST(floor(coalesce(t.turn, -1) / 256.0) AS BIGINT) AS part
  FROM people p JOIN turns t ON p.conv_id = t.conv_id)
SELECT conv_id, perspective, part, CAST(0 AS INTEGER) AS sub, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(mine) AS BIGINT) AS n_masked,
       string_agg(CAST(mine AS VARCHAR), '' ORDER BY turn, who, t) AS mask,
       CAST(sum(mine) AS BIGINT) AS n_spans,
       sha256(string_agg(line, chr(10) ORDER BY turn, who, t)) AS rendered_sha256
FROM seen GROUP BY conv_id, perspective, part
"""

def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII string."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    byte = "list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: xor(c // 2, 3988292384 * (c % 2)))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda crc, b: {byte}))"


def _field_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


OP12_SQL = rf"""
WITH RECURSIVE shown AS (
  SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents),
hashed AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k, sha256({" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         sha256({" || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "told"))}) AS given FROM shown),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM hashed),
tree AS (
  SELECT k, CAST(0 AS BIGINT) AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT k, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY k, lvl, idx // 3, n),
subs AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
tops AS (
  SELECT CAST(0 AS BIGINT) AS lvl, idx, n, h FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 3, n),
sides AS (
  SELECT k, lvl, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY k, lvl, idx // 3 ORDER BY idx)),
top_sides AS (
  SELECT lvl, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
folds AS (
  SELECT k, idx AS leaf_idx, CAST(0 AS BIGINT) AS lvl, idx, n, given AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.k, f.leaf_idx, f.lvl + 1, f.idx // 3, (f.n + 2) // 3, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM folds f JOIN sides s ON f.k = s.k AND f.lvl = s.lvl AND f.idx = s.idx WHERE f.n > 1),
top_folds AS (
  SELECT f.k, f.leaf_idx, CAST(0 AS BIGINT) AS lvl, s.idx, s.n, f.h, f.proof FROM folds f JOIN subs s ON f.k = s.k WHERE f.n = 1
  UNION ALL
  SELECT f.k, f.leaf_idx, f.lvl + 1, f.idx // 3, (f.n + 2) // 3, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
  FROM top_folds f JOIN top_sides s ON f.lvl = s.lvl AND f.idx = s.idx WHERE f.n > 1)
SELECT leaves.doc_id, leaf, subs.h AS subroot, root.h AS root, sha256(top_folds.proof) AS proof_sha256, top_folds.h AS folded_root, top_folds.h = root.h AS verified
FROM leaves JOIN subs ON leaves.k = subs.k JOIN top_folds ON leaves.k = top_folds.k AND leaves.idx = top_folds.leaf_idx AND top_folds.n = 1
CROSS JOIN (SELECT h FROM tops WHERE n = 1) AS root
"""

_GONE, _CUT = "fate = 'gone'", "CASE WHEN fate = 'cut' THEN 5 ELSE 0 END"


def _edit_sql(letter: str, after: str, cost: str, line: str | None = None, when: str = "true") -> str:
    """A struct of cost, audit and repaired turns: an edit and what follows it; null where it isn't allowed."""
    lines = f"list_prepend({line}, {after}.t)" if line else f"{after}.t"
    return f"CASE WHEN {when} THEN {{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {lines}}} END"


def _least_sql(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _turn_sql(q: int, keeps: list[tuple[str, int]]) -> str:
    """The best edits from state ``q`` on that begin with the turn itself."""
    to, role = (3, "assistant") if q == 2 else (2, "user")
    kept = [_edit_sql("K", f"q{s}", _CUT, "role || ':' || text", f"NOT {_GONE} AND left(role, 1) = '{i}'") for i, s in keeps]
    return _least_sql(_edit_sql("D", f"q{q}", "2"), *kept, _edit_sql("R", f"q{to}", f"1 + {_CUT}", f"'{role}:' || text", f"NOT {_GONE}"))


OP13_SQL = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM rows_),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before_
  FROM placed),
turns AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' WHEN fault = 'truncated' THEN 'cut' ELSE '' END AS fate FROM faults),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pos > 1 AND before_ || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
steps AS (
  SELECT conv_id, n + 1 AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS q0, {{'c': CAST(10 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']}} AS q1,
         {{'c': CAST(5 AS BIGINT), 'a': 'I', 't': ['assistant:']}} AS q2, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS q3
  FROM counts
  UNION ALL
  SELECT conv_id, pos, {_least_sql("b0", _edit_sql("I", "i2", "5", "'user:'"))}, {_least_sql("b1", _edit_sql("I", "i2", "5", "'user:'"))}, i2, {_least_sql("b3", _edit_sql("I", "b2", "5", "'user:'"))}
  FROM (
    SELECT *, {_least_sql("b2", _edit_sql("I", "b3", "5", "'assistant:'"))} AS i2
    FROM (
      SELECT s.conv_id, t.pos, {_turn_sql(0, [("s", 1), ("u", 2)])} AS b0, {_turn_sql(1, [("u", 2)])} AS b1, {_turn_sql(2, [("a", 3)])} AS b2, {_turn_sql(3, [("u", 2)])} AS b3
      FROM steps s JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = s.pos - 1))),
found AS (SELECT s.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, s.q0 FROM steps s JOIN counts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.pos = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(q0.c, 0) AS BIGINT) AS cost,
       coalesce(q0.a, '') AS audit, sha256(coalesce(array_to_string(q0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN found f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
"""

QUERIES = {
    "op1_ngram_score": op1_ngram_score,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_token_store": op5_token_store,
    "op6_secret_scan": op6_secret_scan,
    "op7_vp_neighbours": op7_vp_neighbours,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_source_mix": op10_source_mix,
    "op11_fingerprint": op11_fingerprint,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL = {"op2_chat_perspectives": OP2_SQL, "op3_line_dedup": OP3_SQL, "op12_merkle_manifest": OP12_SQL, "op13_conversation_repair": OP13_SQL}
