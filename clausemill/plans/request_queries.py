"""Requests: admission, languages, routing, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import segmentation
from ..sources import rules as R
from ..sources import tables as T
from .registry import query

C = T.CONTRACTS_CTE
MIMES = ", ".join(f"'{m}'" for m in R.ACCEPTED_MIMES)


def lang_sql(raw: str) -> str:
    return f"CASE WHEN lower(trim({raw})) IN ('ru', 'en', 'it', 'fr') THEN lower(trim({raw})) ELSE 'ru' END"


LOCALE = f"CASE WHEN locale_raw IS NOT NULL THEN {lang_sql('locale_raw')} ELSE {lang_sql('language_raw')} END"
# contracts with their language and a text that is never empty
TEXTS_CTE = f"""{C}, texts AS (
  SELECT c.*, {LOCALE} AS language FROM contracts c
), filled AS MATERIALIZED (
  SELECT t.* EXCLUDE (document_text),
         CASE WHEN coalesce(trim(document_text), '') = '' THEN p.placeholder ELSE document_text END AS document_text
  FROM texts t JOIN {R.PLACEHOLDER_SQL} ON p.language = t.language
)"""


def case_sql(values: dict, key: str) -> str:
    put = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {put(v)}" for k, v in values.items()) + " END"


@query("SELECT doc_id, text, length(text)::INT AS n FROM documents")
def q_doc_scan(spark, sf):
    return T.doc_scan(spark, f"{sf}/documents.parquet").select("doc_id", "text", F.length("text").alias("n"))


@query(f"""WITH {C} SELECT contract_id, CASE WHEN size_bytes IS NULL OR size_bytes <= 0 THEN 'missing_file'
  WHEN size_bytes > 18874368 THEN 'too_large' WHEN coalesce(mime_type, '') NOT IN ({MIMES}) THEN 'mime_not_allowed' END AS reject_reason FROM contracts""")
def q_admit_documents(spark, sf):
    return T.contracts(spark, sf).select("contract_id", L.reject_reason(F.col("size_bytes"), F.col("mime_type")).alias("reject_reason"))


@query(f"WITH {C} SELECT contract_id, coalesce(document_text, '') <> '' OR coalesce(mime_type, '') <> '' AS ok FROM contracts")
def q_payload_one_of(spark, sf):
    ok = F.coalesce(L.blank_to_null(F.col("document_text")), L.blank_to_null(F.col("mime_type"))).isNotNull()
    return T.contracts(spark, sf).select("contract_id", ok.alias("ok"))


@query(f"WITH {C} SELECT contract_id, {lang_sql('language_raw')} AS language FROM contracts")
def q_normalize_language(spark, sf):
    return T.contracts(spark, sf).select("contract_id", L.normalize_language(F.col("language_raw")).alias("language"))


@query(f"WITH {C} SELECT contract_id, {LOCALE} AS language FROM contracts")
def q_locale_precedence(spark, sf):
    return T.contracts(spark, sf).select("contract_id", L.locale_precedence(F.col("language_raw"), F.col("locale_raw")).alias("language"))


@query(f"WITH {C} SELECT contract_id, p.placeholder AS text FROM (SELECT *, {LOCALE} AS language FROM contracts) c JOIN {R.PLACEHOLDER_SQL} ON p.language = c.language")
def q_localize_text(spark, sf):
    language = L.locale_precedence(F.col("language_raw"), F.col("locale_raw"))
    return T.contracts(spark, sf).select("contract_id", L.localize_text(L.text_map(R.PLACEHOLDER), language).alias("text"))


@query(f"WITH {C} SELECT contract_id, 'Contract ' || contract_id || ' for ' || role || ' and ' || coalesce(counterparty_role, '') || '.' AS line FROM contracts")
def q_render_template(spark, sf):
    template = F.lit("Contract {id} for {role} and {other}.{unknown}")
    line = L.render_template(template, {"id": F.col("contract_id"), "role": F.col("role"), "other": F.col("counterparty_role")})
    return T.contracts(spark, sf).select("contract_id", line.alias("line"))


@query(f"""WITH {C}, m AS (SELECT contract_id, document_text IS NOT NULL AS has_text, lower(trim(mime_type)) AS mime, {case_sql(R.MIME_MODES, 'lower(trim(mime_type))')} AS override FROM contracts),
  x AS (SELECT contract_id, coalesce(override, CASE WHEN has_text THEN 'local_first' ELSE 'server_assist' END) AS mode,
        CASE WHEN override IS NOT NULL THEN 'mime_type:' || mime WHEN has_text THEN 'document_text' ELSE 'document_base64' END AS policy_source FROM m)
  SELECT contract_id, mode, mode = 'local_first' AS offline_capable, mode = 'server_assist' AS network_required, policy_source FROM x""")
def q_route_execution(spark, sf):
    plan = L.execution_plan(F.col("mime_type"), F.col("document_text").isNotNull())
    return T.contracts(spark, sf).select("contract_id", plan.alias("plan")).select("contract_id", "plan.*")


# What a page is said to be, by page_id; some say nothing, or something unknown, so that the name decides.
SAID = ("text/plain", " Text/HTML ", "application/pdf", "application/msword", R.ACCEPTED_MIMES[1].upper(), "image/png", "")
_SAID_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(SAID)) + " END"
_KINDS = (("txt", "text/plain", ("txt",)), ("docx", R.ACCEPTED_MIMES[1], ("docx",)), ("html", "text/html", ("html", "htm")), ("doc", "application/msword", ("doc",)), ("pdf", "application/pdf", ("pdf",)))


@query(f"""WITH f AS (SELECT page_id, lower(split_part(split_part(url, '?', 1), '/', -1)) AS name, coalesce(lower(trim({_SAID_SQL})), '') AS mime FROM pages)
  SELECT page_id, CASE """ + " ".join(f"WHEN mime = '{m}' OR " + " OR ".join(f"name LIKE '%.{e}'" for e in ends) + f" THEN '{k}'" for k, m, ends in _KINDS) + " ELSE 'fallback' END AS extractor FROM f")
def q_content_dispatch(spark, sf):
    name = F.substring_index(F.substring_index("url", "?", 1), "/", -1)
    return T.table(spark, sf, "pages").select("page_id", L.extractor(F.expr(_SAID_SQL), name).alias("extractor"))


@query(f"WITH {T.JOB_LOG_CTE} SELECT event_id, {case_sql(R.LIFECYCLE, 'status')} AS lifecycle, {case_sql(R.PROGRESS, 'status')}::INT AS progress FROM job_log")
def q_status_rollup(spark, sf):
    return T.job_log(spark, sf).select("event_id", L.lookup(R.LIFECYCLE, F.col("status")).alias("lifecycle"), L.lookup(R.PROGRESS, F.col("status")).alias("progress"))


@query(f"WITH {C} SELECT contract_id, nullif(trim(language_raw), '') AS language FROM contracts")
def q_blank_to_null(spark, sf):
    return T.contracts(spark, sf).select("contract_id", L.blank_to_null(F.col("language_raw")).alias("language"))


@query(f"WITH {TEXTS_CTE} SELECT contract_id, language, document_text FROM filled")
def q_placeholder_text(spark, sf):
    return segmentation.with_text(T.contracts(spark, sf)).select("contract_id", "language", "document_text")
