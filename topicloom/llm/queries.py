"""The queries of this folder, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import (
    byte_bpe,
    decontaminate,
    fim,
    jaccard,
    katz,
    licenses,
    line_dedup,
    packing,
    quality,
    rans,
    token_counts,
    url_filter,
    whitening,
)
from topicloom.session import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Texts that Spark hands to a Python worker at a time, and so holds in memory twice.
TEXTS_PER_BATCH = "1000"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    rans.write_tokens(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return rans.read_tokens(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_counts.token_counts(docs, vocabulary("word_bpe_49k.json"))


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return katz.katz_scores(documents(spark, sf_dir), train)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    found = decontaminate.overlaps(docs, items)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "row.doc_id",
        "found.n_words",
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "found.spans",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select(
        "row.doc_id",
        F.col("cleaned.n_lines").alias("n_removed_lines"),
        F.col("cleaned.n_words").alias("n_removed_words"),
        F.col("cleaned.text").alias("text"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_files": op2_token_files,
    "op3_token_counts": op3_token_counts,
    "op4_katz_scores": op4_katz_scores,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op13_fill_in_middle": r"""WITH base AS (
    SELECT doc_id, coalesce(text, '') AS t,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents),
cut AS (
    SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        CAST(('0x' || substr(d, 1, 8)) AS UBIGINT) AS h1, CAST(('0x' || substr(d, 9, 8)) AS UBIGINT) AS h2,
        CAST(('0x' || substr(d, 17, 8)) AS UBIGINT) AS h3, CAST(('0x' || substr(d, 25, 8)) AS UBIGINT) AS h4
    FROM base),
bounds AS (
    SELECT *, len(units) AS n,
        least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b
    FROM cut),
parts AS (
    SELECT doc_id, t, n, h3, h4,
        array_to_string(units[1:a], '') AS prefix,
        array_to_string(units[a + 1:b], '') AS middle,
        array_to_string(units[b + 1:n], '') AS suffix
    FROM bounds),
formed AS (
    SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t
                     WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                     ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM formed""",
}
