"""Registered queries of this package, over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.chat import rotate_perspectives
from tessella.llm.fingerprints import fingerprint_pairs
from tessella.llm.graph_search import nearest_neighbours
from tessella.llm.html_text import extract_pages
from tessella.llm.language_id import identify_languages
from tessella.llm.mixing import mix_documents
from tessella.llm.near_duplicates import near_duplicates
from tessella.llm.piece_sampling import decode, encode_samples
from tessella.llm.prefix_trie import prefix_trie, with_shared_heads
from tessella.llm.quality import assess_quality
from tessella.llm.token_count import count_tokens
from tessella.llm.toxicity import score_toxicity
from tessella.llm.word_runs import find_runs, run_digests, with_planted_periods


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; a parameter of the operators that need one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(_read(spark, folder, "documents"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_read(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Two sampled segmentations of each text, decoded again: digests of pieces and text."""
    path = tokenizer_file("piece_bpe_32k.model")
    documents = _read(spark, folder, "documents")
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    sampled = encode_samples(documents.withColumn("text_hash", F.xxhash64(plain)), path, keep=("text_hash",))
    return decode(sampled, path).select(
        "doc_id",
        "sample",
        F.size("ids").cast("long").alias("n_pieces"),
        F.hex(F.xxhash64("ids")).alias("pieces_hash"),
        "log_prob",
        "log_inclusion",
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"))


def op6_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """All renderings; masks as text, start-end pairs with commas between."""
    span = F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return rotate_perspectives(_read(spark, folder, "conversations")).withColumn("masks", F.array_join(span, ","))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_pairs(_read(spark, folder, "documents"))


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(_read(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_documents(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return assess_quality(_read(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_read(spark, folder, "conversations"), rebuild=with_shared_heads)


def op12_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(_read(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op13_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the runs of words, after a tenth of the documents got a periodic tail."""
    return run_digests(find_runs(with_planted_periods(_read(spark, folder, "documents"))))


REGISTRY = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_piece_sampling,
        op4_toxicity,
        op5_near_duplicates,
        op6_chat_perspectives,
        op7_fingerprints,
        op8_html_text,
        op9_mixing,
        op10_quality,
        op11_prefix_trie,
        op12_graph_search,
        op13_word_runs,
    )
}

# The others have no SQL: classifiers, tokenisers, samples, parsers and iterated estimates.
# The tests hold them against brute force.
ORACLES = {
    "op5_near_duplicates": r"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM sh),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b
    WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached AS (SELECT doc_id AS root, doc_id AS node FROM sh
    UNION SELECT r.root, w.b FROM reached r JOIN ways w ON r.node = w.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM sh JOIN (SELECT node, min(root) AS component_id FROM reached GROUP BY node) c ON c.node = doc_id""",
    "op6_chat_perspectives": """WITH
t AS (SELECT conv_id, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
    FROM conversations),
s AS (SELECT DISTINCT conv_id, who AS me FROM t WHERE who <> 'system'),
p AS (SELECT t.conv_id, me, pos // 256 AS part, pos, who = me AS mine, said || '<|im_end|>' || chr(10) AS body,
    '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = me THEN 'assistant'
      ELSE 'user name=' || who END || chr(10) AS head
    FROM t JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
q AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, me, part ORDER BY pos) AS stop FROM p)
SELECT conv_id, me AS perspective, part::INTEGER AS part, count(*)::INTEGER AS n_turns,
  string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg(CASE WHEN mine THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY pos), '') AS masks,
  sum(CASE WHEN mine THEN length(body) ELSE 0 END)::INTEGER AS n_trained
FROM q GROUP BY conv_id, me, part""",
    "op11_prefix_trie": """WITH
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS said, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, max(pos) AS n, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda r, b: list_reduce(
      list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
    FROM t GROUP BY c),
k AS (SELECT v.c, v.n, v.h, v.base, least(v.h, coalesce(b.n, 0)) AS k FROM v LEFT JOIN v b ON b.c = v.base),
r AS (SELECT k.c, t.pos AS i, t.role, t.said FROM k JOIN t ON t.c = k.base AND t.pos <= k.k
    UNION ALL SELECT k.c, k.k + t.pos - k.h, t.role, t.said FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
p AS (SELECT c, i, strlen(said) AS bytes, string_agg(md5(role) || md5(said), '') OVER (PARTITION BY c ORDER BY i) AS name FROM r
    UNION ALL SELECT c, 0, 0, '' FROM k),
q AS (SELECT *, i = max(i) OVER (PARTITION BY c) AS last FROM p),
nodes AS (SELECT i, name, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM q GROUP BY i, name),
kids AS (SELECT i - 1 AS i, left(name, -64) AS name, count(*) AS n FROM nodes WHERE i > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (i, name)),
sums AS (SELECT p.i, p.name, count(*) FILTER (WHERE own.n_children = 0) AS n_leaves, sum((own.n_convs - 1) * own.bytes) AS saved
    FROM own JOIN p ON p.c = own.conv_id AND p.i <= own.i GROUP BY p.i, p.name)
SELECT own.conv_id, own.i::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, sums.n_leaves,
  sums.saved::BIGINT AS saved_tokens, own.ends_sha256
FROM own JOIN sums USING (i, name) LEFT JOIN nodes up ON up.i = own.i - 1 AND up.name = left(own.name, -64)""",
}
