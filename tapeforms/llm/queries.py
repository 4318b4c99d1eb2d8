"""One query for each numbered operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.llm import bpe, chat, embed_dedup, exact_search, fill_middle, html_extract, line_dedup, mixing, quality, shared, simhash, spelling, token_store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written to a new folder below the shared one, and read back from there."""
    folder = f"{shared.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(_table(spark, sf_dir, "pages"), folder)
    return warc.archived_pages(spark, folder)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is written to a new folder below the shared one, and read back from there."""
    folder = f"{shared.shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write(_table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_store.read_documents(spark, folder)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations
), hashed AS (
  SELECT conv_id, k, role, text, string_agg(md5(role) || md5(text), '' ORDER BY k) OVER (PARTITION BY conv_id ORDER BY k) AS p,
         count(*) OVER (PARTITION BY conv_id) AS n FROM placed
), whole AS (
  SELECT conv_id, n, p FROM hashed WHERE k = n
), own AS (
  SELECT p, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole
  WHERE p NOT IN (SELECT p FROM hashed WHERE k < n) GROUP BY p
)
SELECT o.conv_id, max(h.n)::BIGINT AS n_turns, max(o.n_copies)::BIGINT AS n_copies,
       string_agg('<|im_start|>' || replace(h.role, '<|im_', '< |im_') || chr(10) || replace(h.text, '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY h.k) AS text
FROM own o JOIN hashed h USING (conv_id) GROUP BY o.conv_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its text after dedup of lines of any length, and how many of its lines went."""
    return line_dedup.with_lines_dropped(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.FIGURES, "base_failed", "kept")


def _op8_sql() -> str:
    stops = ", ".join("'" + v + mark + "'" for w in quality.STOP_WORDS for v in sorted({w, w.capitalize()}) for mark in ("", ",", "."))
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS x FROM split, unnest(generate_series(1, greatest(len(w) - 7, 0))) AS u(i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows
), covered AS (
  SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100)) AS n FROM twice WHERE c > 1
), repeats AS (
  SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM covered GROUP BY doc_id
), base AS (
  SELECT s.doc_id, w, l, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id
), ratios AS (
  SELECT *, greatest(n_words, 1) AS nw, greatest(len(l), 1) AS nl, greatest(word_chars, 1) AS nc FROM base
), verdict AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    word_chars / nw < 2 OR word_chars / nw > 14 OR n_symbols / nw > 0.1
    OR len(list_filter(w, lambda x: x IN ({stops}))) / nw < 0.06
    OR len(regexp_extract_all(t, '\p{{Lu}}')) / nc > 0.4
    OR n_dup_lines / nl > 0.5 OR n_repeat_words / nw > 0.3
    OR len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) / nw > 0.2
    OR len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•·]'))) / nl > 0.9
    OR len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) / nl > 0.3 AS bad
  FROM ratios
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM verdict
"""


OP8_SQL = _op8_sql()


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS s FROM documents
), drawn AS (
  SELECT *, len(l) AS n, ('0x' || s[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(l) + 1) AS y, ('0x' || s[25:32])::BIGINT AS h4 FROM cut
), parts AS (
  SELECT *, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, array_to_string(l[1:least(x, y)], '') AS p,
         array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(l[greatest(x, y) + 1:n], '') AS s3 FROM drawn
), formed AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM parts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s3 || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s3 || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM formed
"""


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored) WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_html_main_text": op2_html_main_text,
        "op3_warc": op3_warc,
        "op4_token_store": op4_token_store,
        "op5_source_mix": op5_source_mix,
        "op6_chat_format": op6_chat_format,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_exact_top_k": op13_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": OP6_SQL, "op8_quality_rules": OP8_SQL, "op12_fill_in_middle": OP12_SQL, "op13_exact_top_k": OP13_SQL}
