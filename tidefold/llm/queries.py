"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import bpe, decontam, license, pii, quality, secrets, simhash, substring, toxicity, warc
from tidefold.llm.common import joined, table
from tidefold.sources.ship import ensure_on_workers


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_on_workers(spark)
    return table(spark, sf_dir, "documents")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_docs(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(_docs(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_on_workers(spark)
    return warc.unpack(warc.archive(table(spark, sf_dir, "pages"), min_payload=0))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.tokens(_docs(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_docs(spark, sf_dir))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(_docs(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii(_docs(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_secrets, op2_simhash, op3_warc, op4_bpe, op5_toxicity, op6_substring, op7_license, op8_pii, op9_decontaminate, op10_quality, pipeline)
    return {f.__name__: f for f in ops}


_WORDS = r"'[^\x20\x09-\x0D]+'"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORDS}) AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT win.doc_id, i, unnest(range(8)) AS k FROM win JOIN rep USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words >= 20 AND word_chars / n_words BETWEEN 2.0 AND 15.0
  AND n_symbols / n_words <= 0.2 AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM f
"""

_DECONTAM = r"""
WITH iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iwin AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (
  SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT m FROM iwin),
dwin AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (
  SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, lengths WHERE len(ws) >= m)),
hit AS (SELECT doc_id, i, dwin.m, item_id FROM dwin JOIN iwin ON iwin.g = dwin.g AND iwin.m = dwin.m),
cov AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS w FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""


def _lines_sql(text: str) -> str:
    """The list of a text's canonical lines."""
    out = f"replace(lower({text}), chr(169), '(c)')"
    out = f"regexp_replace({out}, '{license.COPYRIGHT_LINE}', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for literal, replacement in license.SPELLINGS:
        out = f"replace({out}, '{literal}', '{replacement}')"
    out = rf"regexp_replace({out}, '{license.VERSION}', '{license.VERSION_NUMBER}\1', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in license.variants())
    long = ", ".join(f"({quoted(i)}, {quoted(h)}, {n}, {quoted(d)})" for i, h, n, d in license.DIGESTS)
    head = lambda x: f"array_to_string(string_split({x}, ' ')[1:2], ' ')"
    return f"""
WITH texts AS (SELECT license, array_to_string({_lines_sql('body')}, ' ') AS t FROM (VALUES {texts}) v(license, body)),
known AS (SELECT digest, min(license) AS license, any_value(head) AS head, any_value(n) AS n FROM (
  SELECT license, {head('t')} AS head, len(string_split(t, ' ')) AS n, sha256(t) AS digest FROM texts WHERE t <> ''
  UNION ALL SELECT * FROM (VALUES {long}) v(license, head, n, digest)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {_lines_sql("coalesce(text, '')")} AS ls FROM documents),
line AS (SELECT r, ls, i, {head("concat_ws(' ', ls[i], ls[i + 1])")} AS two, len(string_split(ls[i], ' ')) AS n FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
place AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM line),
begins AS (SELECT *, two AS head FROM place UNION SELECT *, ls[i] AS head FROM place WHERE n = 1),
taken AS (SELECT DISTINCT a.r, a.i, sha256(array_to_string(a.ls[a.i:b.i], ' ')) AS digest
  FROM begins a JOIN (SELECT DISTINCT head, n FROM known) k USING (head) JOIN place b ON b.r = a.r AND b.upto = a.upto - a.n + k.n AND b.i >= a.i),
hits AS (SELECT r, count(DISTINCT i) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM taken JOIN known USING (digest) GROUP BY r),
whole AS (SELECT r, doc_id, CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END AS digest FROM d)
SELECT doc_id, whole.digest AS text_sha256, license AS license_id, coalesce(hits.n, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON known.digest = whole.digest LEFT JOIN hits ON hits.r = whole.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_license": _license_sql(), "op9_decontaminate": _DECONTAM, "op10_quality": _QUALITY}
