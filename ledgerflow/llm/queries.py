"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, language_id, line_dedup, media_columns, ngram_join, packing, periodic_runs, quality_rules, sentencepieces, substring_dedup, suffix_dedup, token_index, url_filter


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents as indexed binary shards, read back."""
    manifest = token_index.write_token_shards(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_index.read_token_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and numbers of links of documents that share 90 % of their 3-word shingles."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over documents."""
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows of earlier documents."""
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL rules, then the n-gram model, over pages."""
    return url_filter.url_filter(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings of earlier documents."""
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), keep_bytes=False)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as AVI motion-JPEG and back."""
    out = media_columns.decode_media(media_columns.encode_media(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned on two thirds of them."""
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    fitted = language_id.fit_languages(docs.where(~held), "text", "lang")
    out = language_id.identify_languages(docs, fitted)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_languages")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sentence pieces and back."""
    return sentencepieces.encode_decode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of documents, a tenth of which get a repeat first."""
    docs = periodic_runs.with_planted_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.periodic_runs(docs, details=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from documents in each of their 120 orders, by language."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of earlier documents."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_index, op2_ngram_join, op3_quality_rules, op4_packing, op5_substring_dedup, op6_url_filter, op7_suffix_dedup, op8_media_columns, op9_language_id, op10_sentencepiece, op11_periodic_runs, op12_filter_audit, op13_line_dedup]
    return {f.__name__: f for f in found}


_LINE_SQL = """
  SELECT doc_id, length(line) AS size, line,
    length(line) - length(translate(line, '#*$%&|<>', '')) AS symbols,
    length(line) - length(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper_chars,
    length(line) - length(replace(line, '!!', '')) AS shout_chars,
    length(line) - length(translate(line, '|»›•', '')) AS separators,
    right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last_char, lower(line) AS low
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
lines AS ({_LINE_SQL}),
judged AS (SELECT *, (last_char NOT IN ('.', '!', '?', '…', ':', ';', '"', '”', '»', ')', '''', '。')
  OR symbols * 100 >= size * 5 OR shout_chars / 2 >= 3 OR (upper_chars * 100 > size * 50 AND size >= 20) OR separators >= 3
  OR (size <= 200 AND (contains(low, 'cookie') OR contains(low, 'javascript') OR contains(low, 'all rights reserved') OR contains(low, 'terms of use')
    OR contains(low, 'privacy policy') OR contains(low, 'lorem ipsum') OR contains(low, 'subscribe to our') OR contains(low, 'sign in to')))) AS bad FROM lines),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(size) AS total, coalesce(sum(size) FILTER (bad), 0) AS lost FROM judged GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost * 100 <= total * 30 AS kept FROM b
"""


_WORDS = "list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {0}) {0}"

#: Each order is gone through filter by filter, for each kind of document.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
  100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > least] AS fails FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM {', '.join(_LETTERS.format(x) for x in 'abcde')} WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT g.*, filter_order, list_position(list_transform(range(1, 6), lambda i: fails[instr('ABCDE', filter_order[i])]), true) AS gone FROM g, o),
x AS (SELECT *, step, instr('ABCDE', filter_order[step]) AS k FROM s, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT part, filter_order, step, k, sum(n) FILTER (gone IS NULL OR gone > step) AS kept, sum(n) FILTER (gone = step) AS removed, sum(n) FILTER (fails[k] AND gone < step) AS redundant,
  sum(n) FILTER (fails[k] AND len(list_filter(fails, lambda z: z)) = 1) AS unique_fails, sum(n) FILTER (gone = step AND good = 1) AS good_lost, sum(n) FILTER (gone = step AND toxic = 1) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley FROM y
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY 1),
x AS (SELECT doc_id, line, i, coalesce(doc_id > least, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op12_filter_audit": OP12_SQL, "op13_line_dedup": OP13_SQL}
