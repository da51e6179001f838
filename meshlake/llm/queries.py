"""Registered queries of this subpackage: ``opN_<name>(spark, sf_dir)``, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.toxicity import toxicity

    return toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.pii import find

    return find(spark, _table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"), entropy=0.97, max_repeats=4.0, budget_share=1.0)
    return out.withColumn("weight", F.round("weight", 9))


_MASS = "list_sum(list_transform(p, lambda x: pow(x, {a})))"
_ENOUGH = f"ln({_MASS}) - {{a}} * list_sum(list_transform(p, lambda x: pow(x, {{a}}) * ln(x))) / {_MASS} >= CAST(0.97 AS DOUBLE) * ln(n)"
_TOO_OFTEN = f"list_max(list_transform(p, lambda x: pow(x, {{a}}) / x)) / {_MASS} > CAST(4 AS DOUBLE)"
OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(CASE WHEN sq = '' THEN 0 ELSE length(sq) - length(replace(sq, ' ', '')) + 1 END AS BIGINT) AS tokens
  FROM (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS sq FROM documents)
), s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
o AS (
  SELECT total, n, list_transform(ts, lambda x: x / total) AS p FROM (
    SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) FILTER (tokens > 0) AS n, list(tokens ORDER BY tokens, source) FILTER (tokens > 0) AS ts FROM s)
), b AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS lo2, CAST(1 AS DOUBLE) AS hi2
  UNION ALL
  SELECT k + 1, if(e, m, lo), if(e, hi, m), if(t, m2, lo2), if(t, hi2, m2) FROM (
    SELECT b.*, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2, {_ENOUGH.format(a="((lo + hi) / 2)")} AS e, {_TOO_OFTEN.format(a="((lo2 + hi2) / 2)")} AS t FROM b, o WHERE k < 50)
), a AS (
  SELECT o.*, greatest(if({_ENOUGH.format(a="1")}, CAST(1 AS DOUBLE), lo), if({_TOO_OFTEN.format(a="1")}, CAST(1 AS DOUBLE), if({_TOO_OFTEN.format(a="0")}, lo2, CAST(0 AS DOUBLE)))) AS alpha
  FROM o, b WHERE k = 50
), w AS (
  SELECT source, tokens, if(tokens > 0, pow(tokens / total, alpha) / z, 0) AS weight,
    if(tokens > 0, CAST(floor(pow(tokens / total, alpha) / z * total) AS BIGINT), 0) AS budget
  FROM s, (SELECT *, {_MASS.format(a="alpha")} AS z FROM a)
), plan AS (SELECT *, if(tokens > 0, budget // tokens, 0) AS passes, if(tokens > 0, budget % tokens, 0) AS rest FROM w),
t AS (
  SELECT doc_id, source, tokens, weight, passes, rest, block, CAST('0x' || substr(md5(block || ':' || doc_id), 1, 15) AS BIGINT) AS place
  FROM (SELECT d.*, weight, passes, rest, unnest(range(0, passes + 1)) AS block FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source)
), c AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT doc_id, source, block, place, tokens, round(weight, 9) AS weight FROM c
WHERE block < passes OR (block = passes AND if(tokens = 0, rest > 0 OR passes = 0, rest > 0 AND upto <= rest))
"""


#: What a call of ``reply`` takes.
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.chat_tools import dialogue_calls, link

    out = link(*dialogue_calls(_table(spark, sf_dir, "conversations")), REPLY)
    return out.select("conv_id", "position", "kind", "turn", "call_id", "name", "status", F.array_join("errors", ";").alias("errors"), F.md5("json").alias("json_md5"))


OP6_SQL = """
WITH ac AS (
  SELECT DISTINCT conv_id, conv_id || ':' || turn AS call_id, turn, coalesce(text, '') AS prompt FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), ar AS (
  SELECT DISTINCT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, to_json(prompt)) AS nth FROM ac
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content NULLS FIRST) AS nth FROM ar),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS ct, r.turn AS rt, prompt, content
  FROM (SELECT * FROM c WHERE nth = 1) c FULL JOIN (SELECT * FROM r WHERE nth = 1) r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
), m AS (
  SELECT conv_id, call_id, 'call' AS kind, ct AS turn, 'reply' AS name, if(rt IS NULL, 'unanswered', 'linked') AS status, prompt, NULL AS content FROM j WHERE ct IS NOT NULL
  UNION ALL SELECT conv_id, call_id, 'call', turn, 'reply', 'repeated call', prompt, NULL FROM c WHERE nth > 1
  UNION ALL SELECT conv_id, call_id, 'result', rt, if(ct IS NULL, NULL, 'reply'), if(ct IS NULL, 'orphan', 'linked'), NULL, content FROM j WHERE rt IS NOT NULL
  UNION ALL SELECT r.conv_id, r.call_id, 'result', r.turn, if(ct IS NULL, NULL, 'reply'), 'second result', NULL, r.content FROM r JOIN j ON j.conv_id = r.conv_id AND j.call_id = r.call_id WHERE nth > 1
)
SELECT conv_id, turn * 1048576 AS position, kind, turn, call_id, name, status, '' AS errors, md5(if(kind = 'call',
  '{"arguments":{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"turn":' || turn || '},"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":"reply","type":"call"}',
  '{"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"type":"result"}')) AS json_md5
FROM m
"""


def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meshlake.llm.token_shards import token_matrices

    return token_matrices(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), width=1024, end_id=50256, pad_id=50256)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.embedding_dedup import near_duplicates

    return near_duplicates(spark, _table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.topk_search import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(spark, vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256).drop("read_share")


#: On check_l-sized tables this is a join of every query with every row; DuckDB evaluates it at sf0.01.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.e, c.e) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.jaccard_join import jaccard_components

    return jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.licenses import scan

    return scan(spark, _table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    from meshlake.llm.licenses import KNOWN, SPELLINGS

    def canonical(text: str) -> str:
        out = rf"regexp_replace(lower(coalesce({text}, '')), '(^|\n)[\x20\x09*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*', '\1', 'g')"
        out = rf"' ' || trim(regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"sha256(trim({out}))"

    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    return f"""
    WITH k AS (SELECT {canonical("text")} AS digest, min(license) AS license FROM (VALUES {known}) AS t(license, text) GROUP BY 1)
    SELECT doc_id, d.digest, license FROM (SELECT doc_id, {canonical("text")} AS digest FROM documents) d LEFT JOIN k ON d.digest = k.digest
    """


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from meshlake.llm.packing import pack

    return pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


#: Words of a text, and the planted period: from word ``a`` on the text repeats its next ``p`` words. Counts are longs.
_WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_PLANTED = "array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')"


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.periodic_runs import periodic_runs

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("words", F.expr(f"if(h % 10 = 0, {_WORDS}, null)"))
    docs = docs.withColumn("n", F.expr("if(size(words) > 0, size(words), null)")).withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    docs = docs.select("doc_id", F.expr(f"if(n is null, text, {_PLANTED})").alias("text"))
    found = periodic_runs(spark, docs, least=6, exponent=4)
    longest = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, 1) end)")
    found = found.withColumn("best", F.get(longest, F.lit(0)))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.forest_search import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(spark, vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.conversation_repair import digests, repair

    whole = _table(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = whole.withColumn("d", F.crc32(name) % 20).where("d <> 0")
    rows = rows.withColumn("text", F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("d") == 4, "user").otherwise(F.col("role"))).withColumn("copy", F.explode(F.expr("if(d = 3, array(0, 1), array(0))")))
    found, repaired = repair(rows)
    found = found.withColumnRenamed("conv_id", "found")
    said = digests(repaired).withColumnRenamed("conv_id", "said")
    ids = whole.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    # conversations that lost all their rows are empty, as is the digest of those whose turns were all left out
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").join(said, F.col("conv_id").eqNullSafe(F.col("said")), "left")
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_toxicity, op4_pii, op5_mixing, op6_tool_calls, op7_token_matrices, op8_embedding_dedup, op9_exact_topk, op10_jaccard_join, op11_periodic_runs, op12_forest_search, op13_conversation_repair)}


def oracle_sql() -> dict:
    return {"op1_license_scan": _op1_sql(), "op5_mixing": OP5_SQL, "op6_tool_calls": OP6_SQL, "op9_exact_topk": OP9_SQL}
