"""The operators of this package as queries over the given tables, with their SQL counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postsift.llm import (
    bpe, chat, decontaminate, html_template, order_minhash, packing, prefix_trie, quality_rules, resampling, sharding, toxicity,
    url_rules, whitening,
)
from postsift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# Words as in the contract; each window length of the benchmark is matched against the documents' runs of that length.
OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
runs AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT r.rid, r.i, r.n, w.item FROM runs r JOIN win w ON r.n = w.n AND r.g = w.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
  FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark, sf):
    found = decontaminate.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query("op2_importance_resampling")
def op2(spark, sf):
    """Target: documents labelled good.  As many are drawn as the labels have good ones, in proportion."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    drawn = resampling.resample(docs, resampling.target_sample(docs, labels), share=share)
    return drawn.withColumn("kept", F.lit(True))


# The template: <|turn|>role<|say|>text<|end|>; an example's whole text ends with its reply's <|end|>.
OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, 8 + 7 + 7 + length(role)
    + length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) AS c
  FROM t),
g AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples, CAST(sum(c) AS BIGINT) AS stored_chars
FROM g GROUP BY conv_id
"""


@query("op3_chat_format", OP3_SQL)
def op3(spark, sf):
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_examples(chat.whole_examples(turns))


OP4_SHARDS = [f"shard-{n:03d}" for n in range(64)]


@query("op4_shard_placement")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("text_chars"))
    return sharding.place(docs, OP4_SHARDS).select("doc_id", "slot", "shard", "text_chars")


def tokenizer() -> tuple[str, str]:
    """The rank file's path and the pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_byte_bpe")
def op5(spark, sf):
    path, pattern = tokenizer()
    return bpe.round_trip(table(spark, sf, "documents"), path, pattern)


OP6_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
OP6_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT page_id, row_number() OVER () AS rid,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT rid, max_by(h || p, length(h) * 100000 + length(p)) AS rule, max_by(v, length(h) * 100000 + length(p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (rid)
"""


@query("op6_url_filter", OP6_SQL)
def op6(spark, sf):
    rules = spark.createDataFrame(OP6_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf, "pages"), rules)


@query("op7_toxicity")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query("op8_html_extract")
def op8(spark, sf):
    return html_template.extract(table(spark, sf, "pages"))


@query("op9_order_minhash")
def op9(spark, sf):
    return order_minhash.near_duplicates(table(spark, sf, "documents"))


@query("op10_quality_rules")
def op10(spark, sf):
    judged = quality_rules.judge(table(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@query("op11_whiten_embeddings")
def op11(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query("op12_best_fit_packing")
def op12(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


# crc32 bit by bit over the digits of an id; prefixes are texts whose parts say their lengths, so no two are confused.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, max(pos) AS n,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT k.conv_id, t.pos AS depth, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.taken
  UNION ALL SELECT k.conv_id, t.pos - k.h + k.taken, t.role, t.text FROM k JOIN t USING (conv_id) WHERE t.pos > k.h),
p AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS pre
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS (SELECT *, sha256(pre) AS node, max(depth) OVER (PARTITION BY conv_id) = depth AS is_end FROM p),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM q GROUP BY node, depth),
l AS (
  SELECT n.*, pn.node AS p_node, pn.conv_id AS parent_conv_id FROM n
  LEFT JOIN q pq ON pq.conv_id = n.conv_id AND pq.depth = n.depth - 1 LEFT JOIN n pn ON pn.node = pq.node AND pn.depth = pq.depth),
m AS (SELECT l.*, coalesce(x.k, 0) AS n_children FROM l LEFT JOIN (SELECT p_node, count(*) AS k FROM l GROUP BY p_node) x ON x.p_node = l.node),
s AS (
  SELECT a.node, CAST(count(*) FILTER (m.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((m.n_convs - 1) * m.bytes) AS BIGINT) AS saved_tokens
  FROM m JOIN q a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM m JOIN s USING (node)
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))
