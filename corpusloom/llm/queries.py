"""The numbered operators as queries over the generated tables, with SQL where SQL can say the same."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, fill_middle, filter_audit, html_text, near_dup, packing, pii, quality, substring_dedup, suffix_dedup, warc
from .tables import read_table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"), keep="max")


OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        "bpe.n_tokens",
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(spans_text("pii.base"), 256).alias("base_sha256"),
        spans_text("pii.spans").alias("spans"),
        F.size("pii.spans").cast("long").alias("n_spans"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.ngram_join(read_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("repeats.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("repeats.spans").cast("long").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


# `pages` as web captures, in SQL that Spark and DuckDB read alike: every page is a full response and, an hour
# later under another spelling of its URL, a not-modified revisit. Validators agree, differ or are missing by id.
CAPTURES = """
SELECT 2 * page_id AS record_id, url, 60 * page_id AS ts, 'response' AS kind, 200 AS http_status,
       CASE WHEN page_id % 7 <> 3 THEN concat('"', substr(md5(html), 1, 16), '"') END AS etag,
       CASE WHEN page_id % 5 <> 4 THEN concat('day ', cast(page_id % 11 AS string)) END AS last_modified,
       'text/html' AS content_type, cast(length(html) AS string) AS content_length,
       cast(NULL AS string) AS cache_control
FROM pages
UNION ALL
SELECT 2 * page_id + 1, concat(replace(url, '.example.', '.EXAMPLE.'), '#seen'), 60 * page_id + 3600, 'revisit', 304,
       CASE WHEN page_id % 4 = 1 THEN concat('W/"', substr(md5(html), 1, 16), '"')
            WHEN page_id % 4 = 2 THEN '"changed"' END,
       CASE WHEN page_id % 3 <> 2 THEN concat('day ', cast(page_id % 11 AS string)) END,
       'text/plain', '0', concat('max-age=', cast(page_id % 600 AS string))
FROM pages
"""
HEADERS = ("etag", "last_modified", "content_type", "content_length", "cache_control")


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=read_table(spark, sf_dir, "pages"))
    named = F.map_from_arrays(F.array(*(F.lit(h.replace("_", "-")) for h in HEADERS)), F.array(*HEADERS))
    records = captures.withColumn("headers", F.map_filter(named, lambda _, value: value.isNotNull()))
    line = lambda e: F.concat_ws(": ", e["key"], e["value"])
    found = warc.resolve_revisits(records)
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), line), "\n")
    return found.select("record_id", "url", "refers_to", "status", lines.alias("headers"))


OP6_SQL = f"""
WITH captures AS ({CAPTURES.replace("AS string", "AS varchar")}),
plain AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS p FROM captures),
rows_ AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(p, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*', ''),
       '([?&])(?:utm_[A-Za-z]*=[^&]*&?)+', '\\1', 'g'), '[?&]$', ''), '/$', '') AS canon
  FROM plain),
asof_ AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {{'id': record_id, 'etag': etag, 'lm': last_modified,
      'ct': content_type, 'cl': content_length}} END IGNORE NULLS)
    OVER (PARTITION BY canon ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM rows_),
checked AS (
  SELECT *, CASE WHEN r IS NULL THEN 'orphan' ELSE
      CASE coalesce(regexp_replace(etag, '^W/', '') = r.etag, last_modified = r.lm)
        WHEN true THEN 'resolved' WHEN false THEN 'mismatch' ELSE 'unchecked' END END AS status
  FROM asof_ WHERE kind = 'revisit'),
merged AS (
  SELECT *, status = 'resolved' AS m FROM checked)
SELECT record_id, canon AS url, r.id AS refers_to, status,
  concat_ws(chr(10), 'cache-control: ' || cache_control,
    'content-length: ' || CASE WHEN m THEN r.cl ELSE content_length END,
    'content-type: ' || CASE WHEN m THEN r.ct ELSE content_type END,
    'etag: ' || CASE WHEN m THEN coalesce(etag, r.etag) ELSE etag END,
    'last-modified: ' || CASE WHEN m THEN coalesce(last_modified, r.lm) ELSE last_modified END) AS headers
FROM merged
"""


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "page.title", "page.text", F.length("page.text").alias("n_chars"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("repeats.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return substring_dedup.remove_repeats(docs).select(
        "doc_id",
        "repeats.n_words",
        removed.alias("n_removed"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units
  FROM documents),
numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
    CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM drawn),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, a), '') AS prefix,
    array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM words LEFT JOIN marks USING (doc_id)),
alike AS (SELECT part, good, toxic, f, count(*) AS n FROM failed GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE NOT contains(o, x)),
steps AS (SELECT o, step, o[step] AS letter, ascii(o[step]) - 64 AS i FROM orders, range(1, 6) AS r(step) WHERE length(o) = 5),
fates AS (
  SELECT part, o AS filter_order, step, letter, n, good, toxic, f[i] AS fails,
    len(list_filter(f, lambda x: x)) = 1 AND f[i] AS only_,
    max(f[i]::INT) OVER (PARTITION BY part, good, toxic, f, o ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 AS gone
  FROM alike, steps),
counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(gone, false)), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false)), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (only_), 0) AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false) AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (fails AND NOT coalesce(gone, false) AND toxic), 0) AS toxic_lost
  FROM fates GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op4_exact_dedup": op4_exact_dedup,
        "op8_bpe": op8_bpe,
        "op3_packing": op3_packing,
        "op2_quality": op2_quality,
        "op1_pii": op1_pii,
        "op5_ngram_join": op5_ngram_join,
        "op10_nearest": op10_nearest,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op6_revisits": op6_revisits,
        "op9_html": op9_html,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_fill_middle": op12_fill_middle,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": OP4_SQL,
        "op6_revisits": OP6_SQL,
        "op12_fill_middle": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
