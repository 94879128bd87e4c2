"""The queries of the training-data operators, each over its whole table, and of the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcensus.llm import (
    ann,
    bpe,
    collocations,
    conversations,
    decontamination,
    id_files,
    jaccard,
    kneser_ney,
    langid,
    packing,
    sharding,
    toxicity,
    url_filter,
)
from linkcensus.llm.common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = toxicity.train(docs.filter(~held_out), _table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures, each with a day that follows from its id."""
    return pages.select(
        F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 7 % 730).cast("int")).alias("fetched_on")
    )


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries from the pages' own URLs: hosts, their parents, and hosts with a first path segment."""
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    segment = F.split_part(path, F.lit("/"), F.lit(1))
    pattern = (
        F.when(F.col("page_id") % 3 == 0, host)
        .when(F.col("page_id") % 3 == 1, F.regexp_replace(host, r"^[^.]*\.", ""))
        .otherwise(F.concat(host, F.lit("/"), segment))
    )
    return pages.select(
        F.when(F.col("page_id") % 5 == 0, "allow").otherwise("block").alias("list"),
        pattern.alias("pattern"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 13 % 730).cast("int")).alias("day"),
        F.col("page_id").alias("seq"),
        (F.col("page_id") % 7 < 4).alias("added"),
    )


def op4_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(captures_of(pages), url_filter.validity_intervals(entries_of(pages)))


OP4_SQL = r"""
WITH named AS (
    SELECT page_id, url,
           regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '') AS host,
           regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '^/|/$', '', 'g') AS path
    FROM pages
), entries AS (
    SELECT CASE WHEN page_id % 5 = 0 THEN 'allow' ELSE 'block' END AS list,
           CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN regexp_replace(host, '^[^.]*\.', '')
                ELSE host || '/' || split_part(path, '/', 1) END AS pattern,
           DATE '2023-01-01' + (page_id * 13 % 730)::INT AS day, page_id AS seq, page_id % 7 < 4 AS added
    FROM named
), daily AS (
    SELECT list, pattern, day, arg_max(added, seq) AS added FROM entries WHERE pattern <> '' GROUP BY ALL
), changes AS (
    SELECT *, lag(added, 1, false) OVER (PARTITION BY list, pattern ORDER BY day) AS was FROM daily
), spans AS (
    SELECT list, pattern, day AS valid_from, added, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to
    FROM changes WHERE added <> was
), captures AS (
    SELECT page_id AS capture_id, host, path, DATE '2023-01-01' + (page_id * 7 % 730)::INT AS fetched_on FROM named
), active AS (
    SELECT c.capture_id, s.list, s.pattern
    FROM captures c JOIN spans s
      ON (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)
          OR (c.path <> '' AND starts_with(c.host || '/' || c.path || '/', s.pattern || '/') AND contains(s.pattern, '/')))
     AND s.added AND c.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to)
    WHERE c.host <> ''
), decided AS (
    SELECT capture_id, count(*) AS n_active, first(pattern ORDER BY length(pattern) DESC, pattern, list) AS decided_by,
           first(list ORDER BY length(pattern) DESC, pattern, list) AS list
    FROM active GROUP BY capture_id
)
SELECT capture_id, fetched_on, coalesce(n_active, 0) AS n_active, decided_by, coalesce(list = 'block', false) AS blocked
FROM captures LEFT JOIN decided USING (capture_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2
    model = kneser_ney.train(docs.filter(~held_out), order=3)
    return kneser_ney.scored(docs, model).withColumn("held_out", held_out)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.with_tokens(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True))


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op9_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"))


def op10_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, listing = id_files.write_id_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    read = id_files.read_id_files(folder, listing, id_files.documents_in, id_files.DOCUMENTS_IN)
    return read.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that follow from crc32 of `conv_id:turn`, nulls being one space: dropped, emptied, unfinished, repeated or misnamed rows."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    fault = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    hit = fault.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )
    return hit.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def op11_parallel_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    repair = conversations.repaired(damaged(rows))
    found = rows.select("conv_id").distinct()
    for part in (repair.summary, conversations.digests(repair.rows)):
        part = part.withColumnRenamed("conv_id", "_conv")
        found = found.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = "gaps blank duplicate truncated illegal cost".split()
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def op12_phrase_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), ones AS (
    SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(words) AS phrase FROM worded) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang
), twos AS (
    SELECT lang, w1, w2, count(*) AS f FROM (
        SELECT lang, unnest(words[:-2]) AS w1, unnest(words[2:]) AS w2 FROM worded WHERE len(words) >= 2)
    GROUP BY ALL HAVING count(*) >= 10
), threes AS (
    SELECT lang, w1, w2, w3, count(*) AS f FROM (
        SELECT lang, unnest(words[:-3]) AS w1, unnest(words[2:-2]) AS w2, unnest(words[3:]) AS w3 FROM worded WHERE len(words) >= 3)
    GROUP BY ALL HAVING count(*) >= 10
), kept AS (
    SELECT t.* FROM twos t WHERE NOT EXISTS (
        SELECT 1 FROM threes s WHERE s.lang = t.lang AND 100 * s.f >= 50 * t.f
           AND ((s.w1 = t.w1 AND s.w2 = t.w2) OR (s.w2 = t.w1 AND s.w3 = t.w2)))
), cuts AS (
    SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM kept t JOIN ones x ON x.lang = t.lang AND x.phrase = t.w1 JOIN ones y ON y.lang = t.lang AND y.phrase = t.w2
    UNION ALL
    SELECT s.lang, s.w1 || ' ' || s.w2 || ' ' || s.w3, s.f, 1, x.f, y.f
    FROM threes s JOIN ones x ON x.lang = s.lang AND x.phrase = s.w1 JOIN twos y ON y.lang = s.lang AND y.w1 = s.w2 AND y.w2 = s.w3
    UNION ALL
    SELECT s.lang, s.w1 || ' ' || s.w2 || ' ' || s.w3, s.f, 2, x.f, y.f
    FROM threes s JOIN twos x ON x.lang = s.lang AND x.w1 = s.w1 AND x.w2 = s.w2 JOIN ones y ON y.lang = s.lang AND y.phrase = s.w3
), scored AS (
    SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def op13_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_multi_index, op3_decontamination, op4_temporal_lists, op5_language_id, op6_kneser_ney, op7_byte_bpe,
    op8_sampled_splitters, op9_partenum_join, op10_repair_files, op11_parallel_viterbi, op12_phrase_tiles,
    op13_bounded_packing,
)}
ORACLES = {"op4_temporal_lists": OP4_SQL, "op12_phrase_tiles": OP12_SQL}
