"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup, html, jaccard, langid, licenses, packing, pii, quality, wavelet
from .common import id_remainder, table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, memo=1_200_000)


def op7_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


QUERIES = {
    "op4_exact_dedup": op4_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_wavelet": op7_token_wavelet,
}
SQL = {"op4_exact_dedup": OP4_SQL}


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP10_SQL = f"""
WITH items AS (SELECT item_id, {WORDS_SQL} AS words FROM benchmark),
cut AS (SELECT item_id, least(len(words), 10) AS n, words, unnest(range(greatest(len(words) - 10, 0) + 1)) AS s FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, n, list_slice(words, s + 1, s + n) AS w FROM cut),
docs AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, words, unnest(range(greatest(len(words) - n + 1, 0))) AS s FROM docs, sizes),
hits AS (SELECT p.doc_id, p.s, p.n, i.item_id FROM places p JOIN windows i ON i.n = p.n AND i.w = list_slice(p.words, p.s + 1, p.s + p.n)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
QUERIES["op10_benchmark_decontamination"] = op10_benchmark_decontamination
SQL["op10_benchmark_decontamination"] = OP10_SQL


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


QUERIES["op3_ngram_jaccard_join"] = op3_ngram_jaccard_join


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans_of(table(spark, sf_dir, "documents")))


QUERIES["op2_pii"] = op2_pii


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), id_remainder("doc_id", 3)
    scores = quality.scored(docs, table(spark, sf_dir, "labels"), fold != 1)
    return scores.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = id_remainder("doc_id", 4)
    found = langid.predict(table(spark, sf_dir, "documents"), fold != 2)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("lines", F.array_join("lines", ","))


def _normalised_sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{00A0}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}]+"
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"' ' || regexp_replace(regexp_replace({low}, {quoted(licenses.NOTICE)}, chr(10), 'g'), {quoted(marks)}, ' ', 'g') || ' '"
    for old, new in licenses.SPELLINGS:
        words = f"replace({words}, {quoted(f' {old} ')}, {quoted(f' {new} ')})"
    return f"sha256(trim({words}))"


def _license_sql() -> str:
    rows = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in licenses.KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT {_normalised_sql("body")} AS digest, license FROM (VALUES {rows}) k(license, body)),
docs AS (SELECT doc_id, {_normalised_sql("text")} AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents),
named AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS names FROM (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, {_normalised_sql("line")} AS digest FROM lines) JOIN known USING (digest)) GROUP BY 1)
SELECT doc_id, digest, license, license IS NOT NULL AS licensed, coalesce(names, '') AS lines FROM docs LEFT JOIN known USING (digest) LEFT JOIN named USING (doc_id)
"""


QUERIES |= {
    "op1_html_extraction": op1_html_extraction,
    "op5_language_id": op5_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_quality_classifier": op9_quality_classifier,
}
SQL["op8_license_scan"] = _license_sql()


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences within longer texts too; op8_license_scan is held to texts that are one licence as a whole by its SQL."""
    return licenses.notices(table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))


#: Queries beside the numbered ones.
MORE = {"license_notices": license_notices}
