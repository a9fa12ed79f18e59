"""Input tables, and the contract corpus derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_scan(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a declared schema, so that only the columns in use are read."""
    return spark.read.schema(DOCUMENTS).parquet(path)


def text_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per plain-text file: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def record_scan(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """JSON records, one for each file or one for each line; files of other names are skipped, broken records give nulls."""
    return spark.read.schema(schema).option("multiLine", one_per_file).option("pathGlobFilter", "*.json").json(path)


def report_sink(reports: DataFrame, path: str) -> None:
    """Reports as JSON, one folder per language, replacing what was there."""
    reports.write.mode("overwrite").partitionBy("language").json(path)


# Fixed test wording of the contract corpus: one clause for each remainder of (part + line) by 12.
CLAUSE_SQL = """
SELECT l_orderkey AS contract_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
  CAST(l_linenumber AS VARCHAR(9)) || '. ' || CASE (l_partkey + l_linenumber) % 12
    WHEN 0 THEN 'Buyer shall pay invoice ' || CAST(l_orderkey AS VARCHAR(19)) || ' within ' || CAST(l_linenumber AS VARCHAR(9)) || ' days.'
    WHEN 1 THEN 'Seller must deliver part ' || CAST(l_partkey AS VARCHAR(19)) || ' within ' || CAST(l_linenumber + 5 AS VARCHAR(9)) || ' days; later delivery is late.'
    WHEN 2 THEN 'A penalty of ' || CAST(l_linenumber AS VARCHAR(9)) || ' percent applies for each day of delay.'
    WHEN 3 THEN 'Supplier may unilaterally change the price at its sole discretion.'
    WHEN 4 THEN 'Further terms are set by agreement of the parties.'
    WHEN 5 THEN 'The contractor is entitled to finish within a reasonable time.'
    WHEN 6 THEN 'Each party keeps confidential papers of the other party secret.'
    WHEN 7 THEN 'Seller shall indemnify the buyer; buyer must report losses within 3 days.'
    WHEN 8 THEN 'Questo accordo: il fornitore deve consegnare entro ' || CAST(l_linenumber AS VARCHAR(9)) || ' giorni; si applica una penale.'
    WHEN 9 THEN 'Покупатель обязан оплатить товар в срок ' || CAST(l_linenumber AS VARCHAR(9)) || ' дней.'
    WHEN 10 THEN 'Le prix est payé dans un délai raisonnable.'
    ELSE 'GENERAL PROVISIONS' END AS clause_text
FROM lineitem"""

CONTRACT_SQL = """
SELECT o_orderkey AS contract_id, o_custkey AS customer_id,
  CASE o_custkey % 4 WHEN 0 THEN 'buyer' WHEN 1 THEN 'seller' WHEN 2 THEN 'Supplier' ELSE 'contractor' END AS role,
  CASE o_custkey % 4 WHEN 0 THEN 'seller' WHEN 1 THEN 'buyer' WHEN 2 THEN 'buyer' END AS counterparty_role,
  CASE o_orderkey % 7 WHEN 0 THEN 'ru' WHEN 1 THEN 'EN' WHEN 2 THEN ' it ' WHEN 3 THEN 'fr' WHEN 4 THEN 'de' WHEN 5 THEN '' END AS language_raw,
  CASE o_orderkey % 5 WHEN 2 THEN 'en' WHEN 3 THEN 'xx' WHEN 4 THEN 'FR' END AS locale_raw,
  CASE o_orderkey % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'APPLICATION/PDF ' WHEN 3 THEN 'image/png' WHEN 4 THEN 'text/html' END AS mime_type,
  (o_orderkey % 40) * 524288 AS size_bytes, o_orderdate AS uploaded_at, t.document_text
FROM orders LEFT JOIN (SELECT contract_id, {agg} AS document_text FROM ({clause}) GROUP BY contract_id) t ON o_orderkey = t.contract_id"""

_SPARK_AGG = "array_join(transform(array_sort(collect_list(struct(ln, pk, sk, clause_text))), x -> x.clause_text), '\n\n')"
_DUCK_AGG = "string_agg(clause_text, chr(10) || chr(10) ORDER BY ln, pk, sk)"

# SQL that other counterparts begin with: the contracts, as a common table expression.
CONTRACTS_CTE = f"contracts AS MATERIALIZED ({CONTRACT_SQL.format(agg=_DUCK_AGG, clause=CLAUSE_SQL)})"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = CONTRACT_SQL.format(agg=_SPARK_AGG, clause=CLAUSE_SQL.replace("FROM lineitem", "FROM {lineitem}")).replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts as requests: as text, as payloads with and without faults, and with nothing in them, by contract_id modulo 11."""
    packed = lambda b: F.regexp_replace(F.base64(b), "[\r\n]", "")
    fault, text = F.col("contract_id") % 11, F.col("document_text")
    raw = F.encode(text, "utf-8")
    payload = (
        F.when(fault == 1, F.concat(F.lit("%"), packed(raw))).when(fault == 2, packed(F.concat(F.unhex(F.lit("FFFE")), raw)))
        .when(fault == 5, F.concat(F.lit(" "), F.regexp_replace(packed(raw), "=", ""), F.lit("\n"))))
    given = F.when(fault == 4, "").when(fault.isin(0, 6, 7, 8, 9, 10), text)
    mime = F.when(fault == 8, "application/msword").otherwise(F.col("mime_type"))
    return contracts(spark, sf_dir).withColumns({"document_base64": payload, "document_text": given, "mime_type": mime})


# Fixed test wording of the deep corpus: risks, near misses, duties and lists; one clause for each remainder of (part + 3 line) by 26.
DEEP_CLAUSE_SQL = """
SELECT l_orderkey AS contract_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
  CAST(l_linenumber AS VARCHAR(9)) || '. ' || CASE (l_partkey + 3 * l_linenumber) % 26
    WHEN 0 THEN 'Supplier may unilaterally change the price at its sole discretion.'
    WHEN 1 THEN 'GENERAL PROVISIONS'
    WHEN 2 THEN 'Buyer shall pay a penalty of ' || CAST(l_linenumber AS VARCHAR(9)) || ' percent for each day of delay.'
    WHEN 3 THEN 'Seller is liable for all losses and lost profit in full. Buyer keeps records.'
    WHEN 4 THEN 'Goods are deemed accepted without objection; acceptance takes ' || CAST(l_linenumber AS VARCHAR(9)) || ' days.'
    WHEN 5 THEN 'Acceptance act'
    WHEN 6 THEN 'Acceptance follows within five days with written reasons. Acceptance needs papers of both parties.'
    WHEN 7 THEN 'Buyer shall:' || chr(10) || 'a) pay the invoice within ' || CAST(l_linenumber AS VARCHAR(9)) || ' days;' || chr(10) || 'b) report losses;' || chr(10) || 'c) keep secret papers.'
    WHEN 8 THEN 'Contractor must perform the following: deliver goods; undertakes to send papers. Seller undertakes to answer.'
    WHEN 9 THEN 'Reference only: a penalty of 5 percent for delay is an example.'
    WHEN 10 THEN 'The scope and price are to be agreed. Terms are set by agreement of the parties.'
    WHEN 11 THEN 'Work is done within a reasonable time.'
    WHEN 12 THEN 'Work is done promptly, within ' || CAST(l_linenumber AS VARCHAR(9)) || ' calendar days.'
    WHEN 13 THEN 'Supplier is entitled to a penalty of ' || CAST(l_linenumber AS VARCHAR(9)) || ' percent for delay.'
    WHEN 14 THEN 'Seller shall indemnify the buyer for damages without limit.'
    WHEN 15 THEN 'Lost profit is not recoverable by seller; damages are limited to the price.'
    WHEN 16 THEN 'Claims go to the court of the seller. Disputes are heard there.'
    WHEN 17 THEN 'Confidential papers stay secret for an unlimited term.'
    WHEN 18 THEN 'Personal data may be passed to third parties.'
    WHEN 19 THEN 'Full prepayment: payment is due immediately, before delivery, ' || CAST(l_linenumber AS VARCHAR(9)) || ' EUR.'
    WHEN 20 THEN 'Supplier may sell the pledge out of court as collateral.'
    WHEN 21 THEN 'An independent guarantee, irrevocable, is paid on first demand.'
    WHEN 22 THEN 'Insurance: the insured event is excluded and not covered.'
    WHEN 23 THEN 'Исполнитель обязан оплатить неустойку за каждый день, срок ' || CAST(l_linenumber AS VARCHAR(9)) || ' дней.'
    WHEN 24 THEN 'Section 3.2 Buyer must provide access at its own expense.3.3 Seller waits.'
    ELSE 'This term is renewed automatically and extended for the same term.' END AS clause_text
FROM lineitem"""

DEEP_SQL = """
SELECT o_orderkey AS contract_id,
  CASE o_custkey % 5 WHEN 0 THEN 'Buyer' WHEN 1 THEN 'seller' WHEN 2 THEN 'Supplier' WHEN 3 THEN 'contractor' ELSE 'Исполнитель' END AS role, t.document_text
FROM orders JOIN (SELECT contract_id, {agg} AS document_text FROM ({clause}) GROUP BY contract_id) t ON o_orderkey = t.contract_id"""


def deep_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by order as numbers: the clauses are written, and put together, where they arrive
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    sql = DEEP_SQL.format(agg=_SPARK_AGG, clause=DEEP_CLAUSE_SQL.replace("FROM lineitem", "FROM {lineitem}")).replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, lineitem=lines, orders=table(spark, sf_dir, "orders"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states from the event stream."""
    states = {"signup": "uploaded", "view": "queued", "click": "preprocessing", "purchase": "report_ready", "error": "failed"}
    pairs = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), pairs[F.col("event_type")].alias("status"))


JOB_LOG_CTE = """job_log AS (
  SELECT event_id, ts, user_id AS job_id,
         CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'preprocessing'
              WHEN 'purchase' THEN 'report_ready' WHEN 'error' THEN 'failed' END AS status
  FROM events)"""
