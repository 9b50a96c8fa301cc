"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimstar.llm import bpe, chat, exact_dedup, infill, line_dedup, mixing, ngram_join, packing, quality, repair, secrets, spotsigs, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary of the installed collection of public tokenizers (the same on the driver and the executors)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, per_hundred=90)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_vocabulary())


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_vocabulary())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` with the damage that the query repairs, by a checksum of id and turn; nulls count as one space."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.repair_report(damaged(conversations)).withColumnRenamed("conv_id", "own")
    whole = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    return whole.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), empty.alias("repaired_sha256"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = infill.fill_in_middle(docs)
    sha = lambda c: F.sha2(c, 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_exact_dedup, op3_ngram_jaccard_join, op4_document_fingerprints, op5_warc, op6_line_dedup,
        op7_secret_scans, op8_bpe, op9_best_fit_packing, op10_chat_formatting, op11_conversation_repair, op12_source_mixing, op13_fill_in_middle,
    )
}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS i
            FROM documents
        ), common AS (
            SELECT line FROM lines WHERE trim(line) <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 5
        )
        SELECT doc_id,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line NOT IN (SELECT line FROM common)), '') AS text,
               count(*) AS n_lines,
               count(*) FILTER (WHERE line IN (SELECT line FROM common)) AS n_removed
        FROM lines
        GROUP BY doc_id
    """,
    "op10_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
        ), whole AS (
            SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY i) AS turns FROM turns GROUP BY conv_id
        ), one AS (
            SELECT min(conv_id) AS conv_id, n, turns FROM whole GROUP BY n, turns
        ), kept AS (
            SELECT conv_id FROM one a
            WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n > a.n AND b.turns[1] = a.turns[1] AND b.turns[1:a.n] = a.turns)
        )
        SELECT conv_id, count(*) AS n_turns,
               string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10),
                          '' ORDER BY i) AS text
        FROM turns JOIN kept USING (conv_id)
        GROUP BY conv_id
    """,
    "op12_source_mixing": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce('0' || source, '1') AS of, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
                   coalesce(text, '') AS text, ('0x' || substr(sha256('1:' || doc_id), 1, 12))::UBIGINT::DOUBLE AS u
            FROM documents
        ), rated AS (
            SELECT doc_id, of, coalesce(words, 0) AS size, u, length(text) AS n, length(regexp_replace(text, '[^\\p{L}\\x20]', '', 'g'))::DOUBLE / greatest(length(text), 1) AS share
            FROM docs
        ), keyed AS (
            SELECT doc_id, of, size, -ln((u + 0.5) / 281474976710656.0::DOUBLE) / (0.05::DOUBLE + 0.95::DOUBLE * share * share) AS key FROM rated
        ), sources AS (
            SELECT of, sum(size) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY of) - 1) % 3] AS weight FROM keyed GROUP BY of
        ), rounds(nth, rest, live) AS (
            SELECT 0, sum(source_size)::BIGINT, sum(weight)::BIGINT FROM sources
            UNION ALL
            SELECT nth + 1, (SELECT sum(source_size) FROM sources)::BIGINT - coalesce(sum(3 * source_size) FILTER (weight * rest > 3 * source_size * live), 0)::BIGINT,
                   coalesce(sum(weight) FILTER (weight * rest <= 3 * source_size * live), 0)::BIGINT
            FROM rounds, sources WHERE live > 0 AND nth < 100 GROUP BY nth, rest, live
        ), level AS (
            SELECT rest, live FROM rounds WHERE live > 0 ORDER BY nth DESC LIMIT 1
        ), targets AS (
            SELECT of, source_size::BIGINT AS source_size,
                   CASE WHEN weight * rest > 3 * source_size * live THEN (3 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / live::DOUBLE END AS target
            FROM sources, level
        ), epochs AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
        ), placed AS (
            SELECT *, round(target - epochs * source_size)::BIGINT
                      - coalesce(sum(size) OVER (PARTITION BY of ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
            FROM keyed JOIN epochs USING (of)
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken, epochs FROM placed
    """,
    "op13_fill_in_middle": """
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), drawn AS (
            SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::UBIGINT % (length(text) + 1) AS c1, ('0x' || substr(h, 9, 8))::UBIGINT % (length(text) + 1) AS c2,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM docs
        ), pieces AS (
            SELECT doc_id, text, n, form, least(c1, c2)::BIGINT AS p, greatest(c1, c2)::BIGINT AS q,
                   substr(text, 1, least(c1, c2)::BIGINT) AS prefix, substr(text, 1 + least(c1, c2)::BIGINT, greatest(c1, c2)::BIGINT - least(c1, c2)::BIGINT) AS middle,
                   substr(text, 1 + greatest(c1, c2)::BIGINT) AS suffix
            FROM drawn
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM pieces
    """,
}
