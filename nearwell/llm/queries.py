"""Registered queries of this subpackage and the SQL they are checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwell.llm import (align, decontaminate, lexical, minhash, packing, passages, quality,
                          repeats, shards, tools, toxicity, urls, warc)

TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- quality rules -----------------------------------------------------------------------------

SQL_MEASURES = r"""
t AS (SELECT {key}, coalesce(text, '') AS text FROM {source}),
ws AS (SELECT {key}, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'),
         lambda w: w <> '') AS w,
       list_filter(string_split(text, chr(10)),
         lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT {key}, unnest(range(1, len(w) - 1)) AS i, w FROM ws),
dup AS (SELECT {key}, i FROM (SELECT {key}, i, count(*) OVER (
         PARTITION BY {key}, w[i], w[i + 1], w[i + 2]) AS n FROM g) WHERE n > 1),
rep AS (SELECT {key}, count(DISTINCT p) AS n FROM (
         SELECT {key}, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY {key}),
m AS (SELECT {key}, len(w)::bigint AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        coalesce(n, 0)::bigint AS n_repeat_words
      FROM ws LEFT JOIN rep USING ({key}))"""
SQL_BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SQL_FAILED = (f"{SQL_BASE_FAILED} OR 2 * n_symbols > n_words OR word_chars < 2 * n_words "
              "OR word_chars > 20 * n_words OR 20 * n_dup_lines > n_words")


@query("op2_quality_rules", f"""
WITH {SQL_MEASURES.format(key='doc_id', source='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({SQL_BASE_FAILED}) AS base_failed, NOT ({SQL_FAILED}) AS kept,
  ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
   + 4 * (2 * n_symbols > n_words)::bigint + 8 * (word_chars < 2 * n_words)::bigint
   + 16 * (word_chars > 20 * n_words)::bigint + 32 * (20 * n_dup_lines > n_words)::bigint)::bigint
   AS fail_bits
FROM m""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policies(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", *quality.MEASURES, (~F.col("kept_base")).alias("base_failed"),
                       F.col("kept_v1").alias("kept"), "fail_bits")


# --- URL filters -------------------------------------------------------------------------------

# The rules that the query judges by.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/"))
SQL_RULES = ", ".join(
    f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in URL_RULES)


@query("op3_url_filters", rf"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {SQL_RULES}),
u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
s AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
hit AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (
          PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS n
        FROM p LEFT JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host)
          AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE n = 1""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.match(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


# --- MinHash near-duplicates -------------------------------------------------------------------

@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


# --- best-fit packing --------------------------------------------------------------------------

@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path(TOKENIZER))


# --- benchmark decontamination -----------------------------------------------------------------

@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


# --- substring near-duplicates -----------------------------------------------------------------

@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(table(spark, sf_dir, "documents"))


# --- exact repeated strings --------------------------------------------------------------------

@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# --- toxicity ----------------------------------------------------------------------------------

@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- WARC --------------------------------------------------------------------------------------

@query("op7_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- chat formatting ---------------------------------------------------------------------------

# The tools of the derived calls.
TOOL_SCHEMAS = (("search", "query", "string", True), ("search", "limit", "integer", False),
                ("lookup", "query", "string", True), ("lookup", "limit", "number", True))


def tool_log(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from conversations.

    Every assistant turn calls a tool with its whole text, and the turn after it is the result; the
    arguments of some are damaged, every second call uses the one before, and in some conversations
    the one after. System turns, and turns that open a conversation, are results that nothing asked
    for. A turn without a role is a result, and one without a number has no identifier.
    """
    def call_id(turn: str):
        return F.expr(f"concat('call_', conv_id, '_', {turn})")

    odd = F.expr("pmod(conv_id + turn, 11)")
    sound = F.to_json(F.struct("text", F.expr("pmod(turn, 5)").alias("limit")).withField(
        "query", F.col("text")).dropFields("text"))
    calls = chats.where("role = 'assistant'").select(
        "conv_id", "turn", call_id("turn").alias("call_id"),
        F.expr("CASE pmod(conv_id, 5) WHEN 0 THEN 'lookup' WHEN 1 THEN 'write' ELSE 'search' END")
        .alias("name"),
        F.when(odd == 0, F.concat(F.lit('{"limit":"x","query":'), F.to_json(F.struct("text")).substr(
            9, 2_000_000_000)))
        .when(odd == 1, F.lit('{"limit": 3, "page": 1}')).when(odd == 2, F.lit("{"))
        .otherwise(sound).alias("arguments"),
        F.expr("CASE WHEN pmod(conv_id, 7) = 3 AND pmod(turn, 4) = 1 THEN array(concat('call_', "
               "conv_id, '_', turn + 2)) WHEN pmod(turn, 4) = 3 AND pmod(conv_id, 7) <> 3 THEN "
               "array(concat('call_', conv_id, '_', turn - 2)) ELSE array() END").alias("uses"))
    results = chats.where("role IS DISTINCT FROM 'assistant'").select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.lit("none")).when(
            F.col("turn") == 0, F.lit("opening")).otherwise(call_id("turn - 1")).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results


@query("op1_tool_calls")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_log(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(list(TOOL_SCHEMAS),
                                    "name string, param string, type string, required boolean")
    out = tools.link(calls, results, schemas)
    return out.withColumn("errors", F.array_join("errors", ","))


# --- sharding ----------------------------------------------------------------------------------

@query("op11_sharding")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# --- cross-tokenizer alignment -----------------------------------------------------------------

@query("op12_cross_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.summaries(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                           public_tokenizers.path(PIECE_TOKENIZER))


# --- ranked lexical search ---------------------------------------------------------------------

SQL_TERMS = (r"list_filter(regexp_extract_all(translate(coalesce(text, ''), "
             r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')")


@query("op13_ranked_lexical_search", f"""
WITH t AS (SELECT doc_id, {SQL_TERMS} AS terms FROM documents),
d AS (SELECT doc_id, len(terms)::bigint AS n, terms FROM t WHERE len(terms) > 0),
g AS (SELECT count(*)::bigint AS nd, sum(n)::bigint AS nl FROM d),
f AS (SELECT doc_id, term, count(*)::bigint AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
      GROUP BY ALL),
q AS (SELECT item_id, unnest(list_distinct({SQL_TERMS})) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint AS w
      FROM (SELECT term, count(*)::bigint AS df FROM f GROUP BY term), g),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nd) // nl) AS m FROM d, g),
s AS (SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.doc_id = f.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
