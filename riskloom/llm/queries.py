"""The registered queries of this package: thin steps from the given tables to the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialize
from riskloom.llm import (ctw_texts, decontamination, infill, mixing, pii, runs, simhash, token_codec, token_rollup, topk, toxicity, url_rules, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DOCUMENT = {"transcript_id": "doc_id", "full_text": "text"}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- 1: mixing

# A domain is the first four characters of a source; every node not listed has weight 1.
DOMAIN = "left(source, 4)"
MIX_WEIGHTS = [("src1", None, None, 3), ("src1", "en", "src1", 5), *[
    (f"src{d}", lang, None, weight) for d in range(10) for lang, weight in (("en", 4), ("fr", 2), ("de", 2))]]
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = (1, 2), 2, "mix-1"


def mix_columns() -> dict:
    return {**DOCUMENT, "main_topics": F.expr(DOMAIN), "detected_language": "lang", "transcription_model": "source"}


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_weights_sql()} v(main_topics, detected_language, transcription_model, weight)")


def _share_sql(level: str, parents: str, name: str) -> str:
    """The same division of a budget as `mixing.leaf_budgets`, for one level."""
    over = f"PARTITION BY {parents}"
    order = f"ORDER BY capacity / weight, {name}"
    return f"""
{level}_a AS (SELECT *, coalesce(sum(capacity) OVER ({over} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
   sum(weight) OVER ({over} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {level}_in),
{level}_b AS (SELECT *, capacity::HUGEINT * open <= (budget - taken)::HUGEINT * weight AS is_full FROM {level}_a),
{level}_c AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}) AS spent,
   sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}) AS shared,
   row_number() OVER ({over} ORDER BY is_full, capacity / weight, {name}) AS place FROM {level}_b),
{level}_d AS (SELECT *, CASE WHEN is_full THEN capacity ELSE ((budget - spent)::HUGEINT * weight) // shared END AS floor_given FROM {level}_c),
{level}_e AS (SELECT *, budget - spent - sum(CASE WHEN is_full THEN 0 ELSE floor_given END) OVER ({over}) AS rests FROM {level}_d),
{level} AS (SELECT *, CASE WHEN NOT is_full AND place <= rests THEN floor_given + 1 ELSE floor_given END AS given FROM {level}_e)"""


def _weights_sql() -> str:
    def text(v):
        return "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({text(a)}, {text(b)}, {text(c)}, {w})" for a, b, c, w in MIX_WEIGHTS)


MIX_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(left(source, 4), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   coalesce(text, '') AS body, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
weights(d, l, s, weight) AS (SELECT * FROM (VALUES {_weights_sql()}) v),
supply AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {MIX_EPOCHS} AS capacity FROM base GROUP BY ALL),
total AS (SELECT sum(tokens) * {MIX_FRACTION[0]} // {MIX_FRACTION[1]} AS wanted FROM supply),
one_in AS (SELECT a.*, coalesce(w.weight, 1) AS weight, least(wanted, sum(capacity) OVER ()) AS budget
   FROM (SELECT domain, sum(capacity) AS capacity FROM supply GROUP BY ALL) a CROSS JOIN total
   LEFT JOIN weights w ON w.d = a.domain AND w.l IS NULL AND w.s IS NULL),
{_share_sql("one", "1", "domain")},
two_in AS (SELECT a.*, coalesce(w.weight, 1) AS weight, one.given AS budget
   FROM (SELECT domain, lang, sum(capacity) AS capacity FROM supply GROUP BY ALL) a JOIN one USING (domain)
   LEFT JOIN weights w ON w.d = a.domain AND w.l = a.lang AND w.s IS NULL),
{_share_sql("two", "domain", "lang")},
three_in AS (SELECT a.domain, a.lang, a.source, a.tokens AS supply, a.capacity, coalesce(w.weight, 1) AS weight, two.given AS budget
   FROM supply a JOIN two USING (domain, lang) LEFT JOIN weights w ON w.d = a.domain AND w.l = a.lang AND w.s = a.source),
{_share_sql("three", "domain, lang", "source")},
plan AS (SELECT b.*, CASE WHEN t.supply > 0 THEN t.given // t.supply ELSE 0 END AS passes, t.given, t.supply
   FROM base b JOIN three t USING (domain, lang, source)),
drawn AS (SELECT *, given - passes * supply AS rest, md5(concat_ws('|', '{MIX_SEED}', passes::BIGINT::VARCHAR, doc_id::VARCHAR)) AS h FROM plan),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn WHERE rest > 0)
SELECT doc_id, domain, lang, source, e::INTEGER AS epoch, tokens, tokens AS taken FROM plan, unnest(range(passes::BIGINT)) u(e)
UNION ALL SELECT doc_id, domain, lang, source, passes::INTEGER, tokens, least(tokens, rest - start)::BIGINT FROM placed WHERE start < rest
"""


@query("op1_source_mixing", MIX_SQL)
def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.mix_transcripts(read(spark, folder, "documents"), mix_weights(spark), fraction=MIX_FRACTION, epochs=MIX_EPOCHS,
                                    seed=MIX_SEED, **mix_columns())
    return chosen.select(F.col("transcript_id").alias("doc_id"), F.col("main_topics").alias("domain"), F.col("detected_language").alias("lang"),
                         F.col("transcription_model").alias("source"), "epoch", "tokens", "taken")


# ---------------------------------------------------------------- 2: near duplicates

@query("op2_simhash_dedup")
def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicate_transcripts(read(spark, folder, "documents"), **DOCUMENT)
    return found.select(F.col("transcript_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- 3: archives

@query("op3_warc_archive")
def op3_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    path = warc.archive_folder(spark, "warc")
    warc.write_archives(read(spark, folder, "pages"), path, smallest_revisit=0)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---------------------------------------------------------------- 4: token totals

ROLLUP_SQL = """
WITH counted AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n1,
   len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+'))::BIGINT AS n2 FROM documents),
left_over AS (SELECT source, lang, 'blank-words-1' AS version, n1 AS n FROM counted WHERE doc_id % 10 <> 3
   UNION ALL SELECT CASE WHEN doc_id % 10 = 5 THEN 'moved' ELSE source END, lang, 'ascii-words-2', CASE WHEN doc_id % 10 = 4 THEN n1 ELSE n2 END
   FROM counted WHERE doc_id % 10 <> 3)
SELECT source, lang, version AS tokenizer_version, count(*) AS documents, sum(n)::BIGINT AS n_tokens FROM left_over GROUP BY ALL
"""


@query("op4_token_totals", ROLLUP_SQL)
def op4_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """All documents inserted under two tokenizer versions, then a batch that deletes those with 3 as last
    digit of the id, revises the counts of those with 4 and the source of those with 5, committed twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = materialize(read(spark, folder, "documents").select(
        F.col("doc_id").alias("transcript_id"), F.col("source").alias("transcription_model"), F.col("lang").alias("detected_language"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n1"),
        F.regexp_count(text, F.lit("[0-9A-Za-z]+")).cast("bigint").alias("n2")), "counted")
    digit = F.pmod("transcript_id", F.lit(10))
    versions = F.explode(F.array(F.struct(F.lit("blank-words-1").alias("tokenizer_version"), F.col("n1").alias("n_tokens")),
                                 F.struct(F.lit("ascii-words-2").alias("tokenizer_version"), F.col("n2").alias("n_tokens")))).alias("v")
    inserts = counted.select("*", versions).select("transcript_id", "transcription_model", "detected_language", "v.*", F.lit("insert").alias("op"))
    totals = token_rollup.TokenTotals(warc.archive_folder(spark, "token-totals"))
    totals.commit(1, inserts)
    later = counted.select("*", digit.alias("digit")).filter("digit IN (3, 4, 5)")
    changes = later.filter("digit = 3").select("*", versions).select(
        "transcript_id", "transcription_model", "detected_language", "v.*", F.lit("delete").alias("op"))
    changes = changes.unionByName(later.filter("digit > 3").select(
        "transcript_id", F.when(F.col("digit") == 5, "moved").otherwise(F.col("transcription_model")).alias("transcription_model"), "detected_language",
        F.lit("ascii-words-2").alias("tokenizer_version"), F.when(F.col("digit") == 4, F.col("n1")).otherwise(F.col("n2")).alias("n_tokens"),
        F.lit("revise").alias("op")))
    for _ in range(2):
        totals.commit(2, changes)
    return totals.totals(spark).select(F.col("transcription_model").alias("source"), F.col("detected_language").alias("lang"),
                                       "tokenizer_version", "documents", "n_tokens")


# ---------------------------------------------------------------- 5: toxicity

@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_transcripts(read(spark, folder, "documents"), read(spark, folder, "labels"), labelled_id="doc_id", **DOCUMENT)
    return scored.select(F.col("transcript_id").alias("doc_id"), "held_out", "score", "predicted")


# ---------------------------------------------------------------- 6: language model

@query("op6_context_tree")
def op6_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.texts import remainder
    found = ctw_texts.score_transcripts(read(spark, folder, "documents"), remainder(F.col("doc_id"), 7) != 2, **DOCUMENT)
    return found.select(F.col("transcript_id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


# ---------------------------------------------------------------- 7: decontamination

@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), complaint_id="item_id",
                                          description="text", **DOCUMENT)
    return found.select(F.col("transcript_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


# ---------------------------------------------------------------- 8: personal data

@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, folder, "documents"), **DOCUMENT)
    return found.select(F.col("transcript_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


# ---------------------------------------------------------------- 9: token files

def token_rows(docs: DataFrame) -> DataFrame:
    path = warc.archive_folder(docs.sparkSession, "tokens")
    token_codec.write_token_files(docs, path, tokenizer_file(), **DOCUMENT)
    return token_codec.read_token_files(docs.sparkSession, path).withColumnRenamed("transcript_id", "doc_id")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_rows(read(spark, folder, "documents"))


# ---------------------------------------------------------------- 10: nearest vectors

@query("op10_nearest_vectors")
def op10_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = topk.nearest_customers(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, customer_id="vec_id", features="embedding")
    return found.select("query_id", "rank", F.col("customer_id").alias("vec_id"), "score")


# ---------------------------------------------------------------- 11: periodic runs

WORDS = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents of the query: where crc32(doc_id) ends in 0, the words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    drawn = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    drawn = drawn.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    drawn = drawn.withColumn("p", F.when(F.col("n") > 0, F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(
        F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))))
    return drawn.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.slice(repeated, F.lit(1), F.col("n")), " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.transcript_runs(with_planted_runs(read(spark, folder, "documents").select("doc_id", "text")), **DOCUMENT)
    found = found.withColumn("best", runs.longest_run())
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(F.col("transcript_id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
                        length.alias("length"), period.alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        runs.runs_digest().alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


# ---------------------------------------------------------------- 12: fill in the middle

INFILL_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
   sha256('7:' || doc_id::VARCHAR) AS d FROM documents),
drawn AS (SELECT doc_id, body, u, len(u)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[25:32])::BIGINT AS h4,
   body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') AS plain FROM cut),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN plain THEN NULL ELSE length(p) END::BIGINT AS prefix_chars, CASE WHEN plain THEN NULL ELSE length(m) END::BIGINT AS middle_chars,
   sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
   sha256(body) AS restored_sha256 FROM parts
""".replace("\\n", "\n")


@query("op12_fill_in_middle", INFILL_SQL)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.restore_transcripts(infill.fill_in_middle(read(spark, folder, "documents"), seed="7", **DOCUMENT))
    return made.select(F.col("transcript_id").alias("doc_id"), F.col("n_lines").alias("n"), "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("full_text").cast("binary"), 256).alias("restored_sha256"))


# ---------------------------------------------------------------- 13: address rules

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

URL_SQL = f"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parsed AS (SELECT page_id, translate(coalesce(regexp_extract(tail, '^[^/?#]*'), ''), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
   coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(rule_host, rule_path, v) AS (SELECT * FROM (VALUES {_RULE_ROWS}) r)
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host) * 10000 + length(rule_path)) AS rule,
   coalesce(arg_max(v, length(rule_host) * 10000 + length(rule_path)), 'allow') AS verdict
FROM (SELECT row_number() OVER () AS row, * FROM parsed) LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY row, page_id, host, path
"""


@query("op13_url_rules", URL_SQL)
def op13_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_ROWS} r(host, path, verdict)")
    judged = url_rules.judge_events(read(spark, folder, "pages"), rules, event_id="page_id", page_url="url")
    return judged.select(F.col("event_id").alias("page_id"), "host", "path", "rule", "verdict")
