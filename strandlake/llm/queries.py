"""The queries of the operators, as the driver calls them: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.sstable import read_sstables, write_sstables

    manifest = write_sstables(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return read_sstables(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.warc import read_archives, resolve_revisits, write_archives

    records = resolve_revisits(read_archives(write_archives(_read(spark, sf_dir, "pages"), min_bytes=1000)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.decontaminate import build_index, contaminated, find_contamination

    found = find_contamination(build_index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.outliers import quality_verdicts

    verdicts = quality_verdicts(_read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.lengths import context_answers, length_histogram

    return context_answers(length_histogram(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op6_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.trie_lm import held_out, score, train

    docs = _read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out("doc_id")), order=3)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.forest import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), threshold=0.8, ngram=5).select("doc_id", "class_id", "n_links")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.packing import pack_documents

    pieces = pack_documents(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.toxicity import held_out, learn_lexicon, score_toxicity

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    lexicon = learn_lexicon(docs, labels.filter(~held_out("doc_id")))
    scores = score_toxicity(docs, lexicon)
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.linededup import find_first_lines

    return find_first_lines(_read(spark, sf_dir, "documents"), min_chars=20, equal_chars=1).drop("text_hash")


QUERIES = {
    "op1_sstable": op1_sstable,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_robust_outliers": op4_robust_outliers,
    "op5_length_histogram": op5_length_histogram,
    "op6_trie_lm": op6_trie_lm,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
        ), g AS (
            SELECT *, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM g
    """,
    "op3_decontamination": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT item_id, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0
        ), win AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bw
        ), size AS (
            SELECT DISTINCT k FROM win
        ), dw AS (
            SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN size ON len(w) >= k
        ), hit AS (
            SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.g = array_to_string(dw.w[dw.i : dw.i + dw.k - 1], ' ')
        ), pos AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id
        ), its AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op10_line_dedup": """
        WITH s AS (
            SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL
        ), l AS (
            SELECT doc_id, n - 1 AS line_no, line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM s) WHERE regexp_matches(line, '[^\\x09-\\x0D\\x20]')
        ), f AS (
            SELECT line, min({'d': doc_id, 'n': line_no}) AS first FROM l GROUP BY line
        ), c AS (
            SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM f WHERE length(line) >= 20
        ), v AS (
            SELECT DISTINCT line, first, hash(substring(line, 1, i - 1) || substring(line, i + 1)) AS v FROM c UNION ALL SELECT line, first, hash(line) FROM f WHERE length(line) >= 20
        ), near AS (
            SELECT a.line, min(b.first) AS first FROM v AS a JOIN v AS b ON a.v = b.v AND b.first < a.first WHERE levenshtein(a.line, b.line) = 1 GROUP BY a.line
        ), best AS (
            SELECT f.line, CASE WHEN near.first < f.first THEN near.first ELSE f.first END AS first, coalesce(near.first < f.first, false) AS is_near FROM f LEFT JOIN near USING (line)
        )
        SELECT doc_id, line_no::INTEGER AS line_no, first.d AS first_doc_id, first.n::INTEGER AS first_line_no, CASE WHEN is_near THEN 1 ELSE 0 END AS edits
        FROM l JOIN best USING (line) WHERE first < {'d': doc_id, 'n': line_no}
    """,
}
