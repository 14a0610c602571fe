"""The registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.llm import (
    chat_format,
    conversation_repair,
    decontamination,
    language_id,
    metric_tree,
    page_text,
    piece_codec,
    simhash,
    token_alignment,
    token_counts,
    token_shards,
    toxicity,
    warc,
)
from flowtriage.llm.common import table
from flowtriage.sources.workspace import new_folder

#: Order of the toxicity chain; the last category decides.
CATEGORIES = ("quality", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score_chain(docs, fitted).withColumnRenamed("rejected", "toxic")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "shards")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    made = token_shards.write_shards(docs, folder, path, public_tokenizers.PATTERN, key="epoch-0")
    return token_shards.read_slots(spark, folder, made).select(
        "slot", "sequence", "shard", F.sha2("ids", 256).alias("ids_sha256")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder, contents=False)
    number = F.when(F.col("record_id") != "null", F.col("record_id")).cast("long")
    return found.where(warc.sound(found)).select(
        number.alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    chats = chat_format.canonical_turns(chat_format.lay_out(turns.unionByName(probe)))
    found = chat_format.read_formatted(chat_format.format_turns(chats))
    joined = F.array_join(
        F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return found.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("trained_text").cast("long").alias("loss_chars"),
        F.sha2("trained_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_text.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.search(table(spark, sf_dir, "embeddings"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), path, contents=False)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.identify(docs, model, keep=("doc_id",))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = token_alignment.align_corpus(table(spark, sf_dir, "documents"), a, b, keep=("doc_id",), a_ranks=ranks)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_shards": op2_token_shards,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_page_text": op7_page_text,
    "op8_simhash": op8_simhash,
    "op9_metric_tree": op9_metric_tree,
    "op10_piece_codec": op10_piece_codec,
    "op11_language_id": op11_language_id,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": r"""
        WITH lowered AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents),
        d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
        i AS (
          SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
        windows AS (
          SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS gram
          FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM sized)),
        grams AS (
          SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS gram
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
                FROM d, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)),
        found AS (SELECT doc_id, p, g.m, item_id FROM grams g JOIN windows USING (m, gram)),
        hit AS (
          SELECT doc_id, count(DISTINCT q) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM found)) GROUP BY 1),
        named AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op4_warc": """
        WITH p AS (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                 sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op9_metric_tree": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                 vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10
    """,
    "op6_chat_format": """
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
          SELECT *, regexp_replace(text, '(<|\\[)(\\\\*)(\\|[A-Za-z_]{1,32}\\|>|/?s>|/?INST\\]|/?SYS>)',
                                   '\\1\\\\\\2\\3', 'g') AS body FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                 AS loss_sha256,
               CAST(sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)
                 AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
