"""The registered queries of the training-data operators: thin digests of what the operators return.

Each gives rows for all rows of its table, null ids and repeated rows too; of an empty table it gives none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import overlaps
from .exact_dedup import exact_duplicates
from .license_scan import scan_licenses
from .mixing import mix_sources
from .packing import pack
from .quality import THRESHOLD, fold, score_quality, train_quality
from .secret_scan import digest, scan_secrets
from .simhash import simhash_components
from .spelling import spelling_variants
from .token_counts import cleaning_edits, count_tokens
from .token_shards import write_shards
from .url_filter import filter_urls
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' overlaps with benchmark items."""
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's SimHash fingerprint and the smallest doc_id that links of 3 bits reach. Null text: fingerprint zero."""
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and hash of the base spans, and all spans. Null text: no spans."""
    return digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after the edits that mask personal data."""
    found = count_tokens(_table(spark, sf_dir, "documents"), cleaning_edits, added=True)
    return found.drop("leaf_chars", "leaf_tokens")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of the documents' ids and its place in a sequence. Null text: the end id alone."""
    return pack(_table(spark, sf_dir, "documents"), added=True)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict. Null or malformed URLs: empty, allowed unless a rule says otherwise."""
    return filter_urls(_table(spark, sf_dir, "pages")).drop("globs")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fold and quality score, by a model of the labelled rows outside fold 0. Null text: scored as empty."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays of its group of equal texts. Null text: empty."""
    found = exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's places of the base phrases, its labels and score. Null text: empty, no labels."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence of the documents' ids with its slot, shard and place; the shards are written to the shared folder."""
    return write_shards(_table(spark, sf_dir, "documents"), added=True)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words and how many of them the mix takes. Null text: size 0; null source: a source of its own, the last."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fitting vector's whitened entries by component. Null and odd vectors: left out; a deviation beyond a long: null."""
    found = whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's form and root with their counts. Null text: no words."""
    return spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_simhash, op3_secrets, op4_token_counts, op5_pack, op6_url_filter, op7_quality, op8_exact_dedup, op9_licenses, op10_token_shards, op11_mixing, op12_whitening, op13_spelling]
    return {f.__name__: f for f in own}


_OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""


def _glob_pattern(glob: str) -> str:
    out = ""
    for part in glob.replace("**", "\0").replace("*", "\1"):
        out += {"\0": ".*", "\1": "[^/]*"}.get(part, "[" + part + "]" if part in ".?+()" else part)
    return f"(?s)^{out}$"


def _op6_sql() -> str:
    from .url_filter import BLOCK_GLOBS, HOST_RULES

    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ranked = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ranked)
    bad = " OR ".join(f"regexp_full_match(host || path, '{_glob_pattern(g)}')" for g in BLOCK_GLOBS)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM s
"""


def _op9_sql() -> str:
    from .license_scan import CONTAINMENT, needed, stride
    from .license_texts import NOTICES, PHRASES

    phrases = ", ".join(f"('{t.label}', {t.words})" for t in PHRASES)
    notices = ", ".join(f"('{t.label}', {sorted(set(t.words))}, {needed(t, CONTAINMENT)}, {stride(t)}, {list(t.must)}::VARCHAR[], {list(t.never)}::VARCHAR[])" for t in NOTICES)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p(label, phrase) AS (VALUES {phrases}), t(label, tokens, least, size, must, never) AS (VALUES {notices}),
b AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w) - len(phrase) + 1), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, p
), base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1
), near AS (
  SELECT doc_id, w, t.* FROM d, t WHERE len(list_intersect(tokens, w)) >= least
), windows AS (
  SELECT *, w[s + 1 : s + 2 * size] AS block FROM (SELECT *, unnest(range(0, greatest(len(w), 1), size)) AS s FROM near)
), met AS (
  SELECT doc_id, label, len(list_intersect(tokens, block)) / len(tokens) AS share FROM windows
  WHERE len(list_intersect(tokens, block)) >= least AND list_has_all(block, must) AND NOT list_has_any(block, never)
  UNION ALL SELECT doc_id, label, 1.0 FROM b
), best AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM met GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


_OP13 = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc, run, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
  ) GROUP BY 1, 2
), bytes AS (
  SELECT doc, run, k, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS b FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab
), vocabulary AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
  ) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2
), without AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS near FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM without WHERE rest IN (SELECT word FROM vocabulary)
  UNION SELECT rest, word FROM without WHERE rest IN (SELECT word FROM vocabulary)
), best AS (
  SELECT near.word, count(*) AS n_near, max(v.n) AS top, arg_min(near.near, struct_pack(a := -v.n, b := near.near)) AS best FROM near JOIN vocabulary v ON v.word = near.near GROUP BY 1
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM vocabulary LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS now, 0 AS k FROM forms
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.now WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(now, k) AS root FROM steps GROUP BY 1) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose whole result it can express."""
    return {"op6_url_filter": _op6_sql(), "op8_exact_dedup": _OP8, "op9_licenses": _op9_sql(), "op13_spelling": _OP13}
