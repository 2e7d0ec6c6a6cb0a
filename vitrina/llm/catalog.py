"""Queries of the training-data operators over the whole test tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.llm import chat, lexical, mixing, mtree, packing, reputation, rptree, sharding, simhash, token_files, toxicity, variants, warc
from vitrina.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), F.col("doc_id"))
    return found.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query("op8_rans")
def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write(_table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2)
    return token_files.read(spark, folder)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_pareto_mix")
def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@query("op3_reply_trees", """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role || text) + length(regexp_replace(role || text, '[^<[]', '', 'g'))
    + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id""")
def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_trees(chat.conversation_tree(rows.unionByName(planted))))


RULES = (
    reputation.Rule("com", "/", "allow"), reputation.Rule("example.com", "/en/", "block"),
    reputation.Rule("www.example.com", "/en/", "allow"), reputation.Rule("net", "/es/", "block"), reputation.Rule("net", "/fr/", "block"))


# The suffixes of two labels are left out: no test page has one.
_STRENGTH_SQL = """(SELECT 1 / least(greatest(CASE WHEN free > 0 THEN (spread - (k - 1)) / free ELSE 0 END, 1 / 1001.0), 0.5) - 1
  FROM (SELECT *, total - squares / total - (k - 1) AS free FROM (
    SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * n) AS DOUBLE) AS squares,
      sum(n * pow(bad / n - mean, 2) / (mean * (1 - mean))) AS spread FROM {0} WHERE n > 0)))"""
_FITS_SQL = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"


def _rules_sql(column: str) -> str:
    longest = sorted(RULES, key=lambda r: len(r.host + r.path), reverse=True)
    value = lambda r: r.verdict if column == "verdict" else r.host + r.path
    return "CASE " + " ".join(f"WHEN {_FITS_SQL.format(r.host, r.path)} THEN '{value(r)}'" for r in longest) + " END"


@query("op6_host_reputation", f"""
WITH outcomes AS (SELECT doc_id AS page_id, max(CAST(toxic = 1 OR quality = 0 AS INTEGER)) AS bad FROM labels GROUP BY 1),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
judged AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, bad FROM parts LEFT JOIN outcomes USING (page_id)),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(regexp_replace(host, '^.*@|:[0-9]*$|[.]$', '', 'g'), '.') AS labels FROM judged GROUP BY host),
hosts AS (SELECT *, list_extract(labels, -1) AS suffix, array_to_string(labels[-2:], '.') AS domain FROM counted),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS mean FROM domains GROUP BY ALL),
suffix_rates AS (SELECT suffix, (bad + s * mean) / (n + s) AS rate FROM suffixes, (SELECT {_STRENGTH_SQL.format("suffixes")} AS s)),
domain_means AS (SELECT domains.*, rate AS mean FROM domains JOIN suffix_rates USING (suffix)),
domain_rates AS (SELECT suffix, domain, (bad + s * mean) / (n + s) AS rate FROM domain_means, (SELECT {_STRENGTH_SQL.format("domain_means")} AS s)),
host_means AS (SELECT hosts.*, rate AS mean FROM hosts JOIN domain_rates USING (suffix, domain)),
host_rates AS (SELECT host, n, s, (bad + s * mean) / (n + s) AS rate FROM host_means, (SELECT {_STRENGTH_SQL.format("host_means")} AS s)),
bounds AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) AS bound FROM host_rates)
SELECT page_id, host, path, {_rules_sql("rule")} AS rule,
  coalesce({_rules_sql("verdict")}, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM judged JOIN bounds USING (host)""")
def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables label documents by number; the page of that number takes the label. Bad: toxic, or of low quality."""
    labels = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id", "left")
    return reputation.judge(pages, RULES)


@query("op1_kneser_ney")
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op10_rp_forest")
def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rptree.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query("op9_m_tree", """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def op9_m_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op2_warc_derivatives")
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no capture date, so all get one."""
    made = warc.derive(warc.responses(_table(spark, sf_dir, "pages"), date="2000-01-01T00:00:00Z"))
    field = lambda name: warc.header_of(F.col("record"), name)
    return made.select(
        F.col("key").alias("page_id"), "warc_type", "record_id", field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"), field("WARC-Block-Digest").alias("block_digest"),
        field("Content-Length").cast("long").alias("content_length"), F.sha2("record", 256).alias("record_sha256"))


@query("op11_reduced_alphabet")
def op11_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))


@query("op12_external_shuffle")
def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the law of rows: counts at most one apart. Sizes and checksums are of the texts as read back from the shards."""
    rows = sharding.write_shards(_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return rows.select(
        "doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# Terms of a text, and the rows of them; numbers of rows stand for documents, since ids may repeat.
_TERMS_SQL = r"""unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""


@query("op13_max_sketch", f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, text FROM documents),
held AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, {_TERMS_SQL.format("text")} FROM rows) GROUP BY ALL),
sizes AS MATERIALIZED (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY d),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
norms AS MATERIALIZED (SELECT d, 100 - 25 + ((25 * n * docs) // length) AS m FROM sizes, totals),
asked AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS_SQL.format("text")} FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scores AS (SELECT item_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN norms USING (d) GROUP BY item_id, d),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores JOIN rows USING (d) WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 20""")
def op13_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_table(spark, sf_dir, "documents"))
    found = lexical.top_k(index, _table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")
