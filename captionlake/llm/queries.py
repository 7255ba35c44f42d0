"""The thin queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from captionlake.llm import conversation_repair, jaccard_join, line_frequency, packing, quality_machine, sentence_pieces, sharding, source_divergence, substring_dedup, token_count, toxicity, transport_stream, url_filter
from captionlake.llm.common import small_batches
from captionlake.llm.oracles import CONVERSATION_REPAIR, SOURCE_DIVERGENCE

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir), 35)


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_digest(documents(spark, sf_dir))


def op3_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 8)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), 2048)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(documents(spark, sf_dir))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.digest(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), 2048)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op11_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, metadata = documents(spark, sf_dir), ("n_chars",)
    return quality_machine.score(docs, quality_machine.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata), metadata)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.digest(conversation_repair.damage(turns), turns)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_transport_stream, op3_jump_hash, op4_best_fit_packing, op5_jaccard_join, op6_line_frequency, op7_url_filter, op8_toxicity, op9_token_count, op10_sentence_pieces, op11_quality_machine, op12_source_divergence, op13_conversation_repair)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
 twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
 gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM twice)), range(35) r(k)),
 spans AS (SELECT doc_id, count(*) FILTER (fresh) AS n_spans, count(*) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM i - 1 AS fresh FROM gone) GROUP BY doc_id),
 kept AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(s.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256, coalesce(s.n_spans, 0) AS n_spans
 FROM d LEFT JOIN spans s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
 sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
 reach AS (SELECT x, y FROM sym UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON d.doc_id = m.x"""

_OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g), range(3) x(k) WHERE c > 1 GROUP BY doc_id),
 lines AS (SELECT doc_id, host, t, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS x, len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')) AS n FROM (SELECT doc_id, host, t, unnest(l) AS x FROM d)),
 heavy AS (SELECT host, x FROM lines WHERE x <> '' GROUP BY host, x HAVING count(DISTINCT t) > 10),
 lost AS (SELECT doc_id, sum(n) AS n FROM lines SEMI JOIN heavy USING (host, x) GROUP BY doc_id),
 o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id)
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM o"""

#: The others hash, score, tokenise or pack in ways that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op5_jaccard_join": _OP5, "op6_line_frequency": _OP6, "op12_source_divergence": SOURCE_DIVERGENCE, "op13_conversation_repair": CONVERSATION_REPAIR}
