"""Registered queries of the text operators, and their SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitcast.llm import (
    exact_dedup, fuzzy_lines, mixing, near_dedup, packing, periodic_runs, quality, resampling, sentencepieces, substring_dedup, suffix_array, tool_calls, toxicity,
)
from pitcast.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files come with the machine and not with this library."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op6_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_array_dedup(table(spark, sf_dir, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` packed with the public word vocabulary, ids as a checksum."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: Tools of the derived calls: type and need of each parameter.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "follow_up": {"question": ("string", True), "turn": ("integer", True)},
}


def call_messages(conversations: DataFrame) -> DataFrame:
    """Every turn of the conversations as a tool message: users' turns call, assistants' turns answer the turn before.

    The first turn searches, later ones follow up or browse, which no schema knows. Depending on their lengths, turns leave
    out an argument, give it a wrong type, or wait for the user's turn before.
    """
    n = F.length("text")
    question = F.when(n % 13 == 0, F.to_json(F.struct(F.col("text").alias("question")))).when(
        n % 5 == 0, F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), F.col("text").alias("question")))
    ).otherwise(F.to_json(F.struct(F.col("turn"), F.col("text").alias("question"))))
    search = F.when(n % 11 == 0, F.to_json(F.struct(F.col("text").alias("query")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), (n % 50).alias("limit"))))
    call = F.struct(
        F.concat(F.lit("call-"), "turn").alias("id"),
        F.when(F.col("turn") == 0, "search").when(n % 7 == 0, "browse").otherwise("follow_up").alias("name"),
        F.when(F.col("turn") == 0, search).otherwise(question).alias("arguments"),
        F.when((F.col("turn") >= 2) & (n % 3 == 0), F.array(F.concat(F.lit("call-"), F.col("turn") - 2))).alias("after"),
    )
    answer = F.struct(F.concat(F.lit("call-"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    body = F.when(F.col("text").isNull(), None).when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(
        F.col("role") == "assistant", F.to_json(answer)
    ).otherwise(F.col("text"))
    return conversations.withColumn("text", body)


@query
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_tool_calls(call_messages(table(spark, sf_dir, "conversations")), SCHEMAS)


ORACLE["op5_tool_calls"] = """
WITH RECURSIVE m AS (SELECT *, length(text) AS n FROM conversations WHERE text IS NOT NULL),
u AS (SELECT *, 'call-' || turn AS call_id, CASE WHEN turn = 0 THEN 'search' WHEN n % 7 = 0 THEN 'browse' ELSE 'follow_up' END AS name FROM m WHERE role = 'user'),
c AS (SELECT conv_id, call_id, min(turn) AS turn, count(*) AS copies, first(text ORDER BY turn) AS text, first(n ORDER BY turn) AS n, first(name ORDER BY turn) AS name FROM u GROUP BY ALL),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, min(turn) AS result_turn, first(text ORDER BY turn) AS result, count(*) AS n_results FROM m WHERE role = 'assistant' GROUP BY ALL),
e AS (SELECT c.conv_id, c.call_id, p.call_id AS cause FROM c JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 WHERE c.turn >= 2 AND c.n % 3 = 0),
l AS (SELECT conv_id, call_id, 0 AS level FROM c WHERE (conv_id, call_id) NOT IN (SELECT (conv_id, call_id) FROM e)
      UNION ALL SELECT e.conv_id, e.call_id, l.level + 1 FROM l JOIN e ON e.conv_id = l.conv_id AND e.cause = l.call_id),
a AS (SELECT *, CASE
        WHEN turn = 0 AND n % 11 = 0 THEN json_object('query', text) WHEN turn = 0 THEN json_object('limit', n % 50, 'query', text)
        WHEN n % 13 = 0 THEN json_object('question', text) WHEN n % 5 = 0 THEN json_object('question', text, 'turn', CAST(turn AS VARCHAR))
        ELSE json_object('question', text, 'turn', turn) END AS arguments,
      CASE WHEN name = 'browse' THEN 'unknown tool' WHEN turn = 0 THEN '' WHEN n % 13 = 0 THEN 'missing turn' WHEN n % 5 = 0 THEN 'type turn' ELSE '' END AS problems FROM c)
SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id, a.turn, CASE WHEN a.turn IS NOT NULL THEN 0 END AS seq,
  coalesce(l.level, 0) AS level, a.name, coalesce(a.copies, 0) AS copies, r.result_turn, coalesce(r.n_results, 0) AS n_results,
  coalesce(a.problems, 'unasked result') AS problems,
  CASE WHEN a.turn IS NULL THEN json_object('id', r.call_id, 'level', 0, 'result', r.result)
       WHEN r.result IS NULL THEN json_object('arguments', a.arguments, 'id', a.call_id, 'level', l.level, 'name', a.name)
       ELSE json_object('arguments', a.arguments, 'id', a.call_id, 'level', l.level, 'name', a.name, 'result', r.result) END::VARCHAR AS message
FROM a FULL JOIN r ON a.conv_id = r.conv_id AND a.call_id = r.call_id LEFT JOIN l ON l.conv_id = a.conv_id AND l.call_id = a.call_id"""


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_line_dedup(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` where one text in ten goes over into a repetition of its own words, as the checksum of its identifier says.

    Such a text becomes its words joined by one space. Texts without words and rows without an identifier stay.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", body.alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    drawn = F.col("h") % 10 == 0
    words = F.when(drawn, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    named = split.withColumn("words", words).withColumns({"n": F.size("words").cast("long"), "g": F.expr("h div 10")})
    begun = named.withColumn("a", F.when(drawn & (F.col("n") > 0), F.col("g") % F.col("n")))
    placed = begun.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    rest = F.col("n").cast("int") - F.col("a")
    block = F.slice("words", F.col("a") + 1, F.least("p", rest))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), listed.alias("listed"), "collapsed_text")
    return best.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), (-F.col("r.less")).alias("length"), F.col("r.period").alias("period"),
        F.expr("1000 * -r.less div r.period").alias("exponent_milli"), F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE["op12_importance_resampling"] = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS entry FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w FROM d),
v AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM dw UNION ALL SELECT w, 0, 1 FROM b) GROUP BY w),
h AS (SELECT v.*, xor(4294967295, list_reduce(range(octet_length(encode(w))), lambda c, k: xor(c >> 8, entry[1 + (xor(c, CAST('0x' || substr(hex(w), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)) & 255)]), 4294967295)) % 10000 AS bucket FROM v, crc),
c AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM c) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM c) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM c),
f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r"""


@query
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


ORACLE["op13_source_mixing"] = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS number FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(number - 1) % 3 + 1] AS weight FROM p),
o AS (SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS full_at FROM w),
l AS (SELECT full_at, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM o WINDOW before AS (ORDER BY full_at, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by(level, full_at) AS level FROM l WHERE full_at > level),
t AS (SELECT o.*, CASE WHEN level IS NULL OR full_at <= level THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target, CAST(ceil(source_size / 128.0::DOUBLE) AS BIGINT) AS blocks FROM o, v),
k AS (SELECT *, CAST(least(2 * blocks, floor(target * blocks / source_size + 0.5::DOUBLE)) AS BIGINT) AS draws FROM t WHERE source_size > 0),
x AS (SELECT number, blocks, i // blocks AS turn, i % blocks AS i FROM k, range(draws) r(i)),
y AS (SELECT number, list_reduce(range(1, 21), lambda a, r: CASE WHEN md5('mix:' || number || ':' || turn || ':' || r || ':' ||
        greatest(a, ((CAST('0x' || substr(md5('mix:' || number || ':' || turn || ':' || r), 1, 15) AS BIGINT) % blocks - a) % blocks + blocks) % blocks)) < '8'
        THEN ((CAST('0x' || substr(md5('mix:' || number || ':' || turn || ':' || r), 1, 15) AS BIGINT) % blocks - a) % blocks + blocks) % blocks ELSE a END, i) AS block FROM x),
n AS (SELECT number, block, count(*) AS times FROM y GROUP BY number, block),
q AS (SELECT doc_id, size, number, source_size, target, coalesce(sum(size) OVER (PARTITION BY number ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
u AS (SELECT q.*, CAST(unnest(range(CAST(start // 128 AS BIGINT), CAST((start + size - 1) // 128 AS BIGINT) + 1)) AS BIGINT) AS block FROM q WHERE size > 0),
a AS (SELECT number, start, CAST(sum(times * (least(start + size, (block + 1) * 128) - greatest(start, block * 128))) AS BIGINT) AS taken FROM u JOIN n USING (number, block) GROUP BY number, start)
SELECT q.doc_id, q.size, q.source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(a.taken, 0) ELSE 0 END AS taken FROM q LEFT JOIN a ON a.number = q.number AND a.start = q.start"""
