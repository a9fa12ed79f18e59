"""Checks and jobs over the registry's tables: constraints, keys, defaults, configuration, retention, access patterns, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import tables as D
from ..sources import rules as R
from ..sources import tables as T
from ..sources.layout import bucketed
from ..sources.registry_tables import cte
from ..sources.registry_tables import registry_table as reg
from ..sources.shared import new_folder
from .match_queries import MATCH_CTE, matched
from .registry import query
from .request_queries import C, LOCALE, case_sql

STATES = "('queued', 'running', 'completed', 'failed', 'cancelled')"
# The conditions of each table, as SQL; RX is a regular expression's match anywhere.
CHECKS = (
    ("app_config.key", "app_config", "RX(config_key, '^[a-z][a-z0-9_.]*$')"),
    ("app_config.value_type", "app_config", "value_type IN ('string', 'integer', 'boolean', 'json')"),
    ("app_config.value", "app_config", "CASE WHEN value_type = 'string' THEN RX(value_json, '^\"') ELSE RX(value_json, '^[0-9]+$') END"),
    ("language_catalog.code", "language_catalog", "RX(code, '^[a-z]{2}$')"),
    ("language_catalog.default_active", "language_catalog", "NOT is_default OR is_active"),
    ("users.email", "users", "RX(email, '@')"),
    ("users.locale", "users", "RX(locale, '^[a-z]{2}(-[A-Z]{2})?$')"),
    ("role_profiles.role", "role_profiles", "length(role) BETWEEN 2 AND 64"),
    ("role_profiles.role_kind", "role_profiles", "role_kind IN ('party', 'counterparty', 'observer')"),
    ("contracts.sha256", "contracts", "RX(file_sha256, '^[0-9a-f]{64}$')"),
    ("contracts.size", "contracts", "size_bytes > 0"),
    ("contracts.status", "contracts", "status IN ('uploaded', 'queued', 'preprocessing', 'analyzing', 'report_ready', 'failed')"),
    ("contracts.language", "contracts", "language_code IN ('ru', 'en', 'it', 'fr')"),
    ("analysis_jobs.status", "analysis_jobs", f"status IN {STATES}"),
    ("analysis_jobs.priority", "analysis_jobs", "priority BETWEEN 1 AND 9"),
    ("risk_items.severity", "risk_items", "severity IN ('low', 'medium', 'high', 'critical')"),
    ("risk_items.score", "risk_items", "score BETWEEN 0 AND 100"),
    ("risk_items.confidence", "risk_items", "confidence BETWEEN 0 AND 1"),
    ("risk_items.role_impact", "risk_items", "role_impact IN ('positive', 'negative', 'neutral')"),
    ("disputed_clauses.confidence", "disputed_clauses", "confidence BETWEEN 0 AND 0.999"),
    ("disputed_clauses.text", "disputed_clauses", "length(clause_text) > 0"),
    ("summaries.key_terms", "summaries", "RX(key_terms, '^\\[')"),
    ("audit_logs.payload", "audit_logs", "RX(event_payload, '^\\{')"),
)


def duck(cond: str) -> str:
    return cond.replace("RX(", "regexp_matches(")


def jvm(cond: str) -> str:
    return cond.replace("RX(", "regexp_like(").replace("\\", "\\\\")


TABLES = tuple(dict.fromkeys(t for _, t, _ in CHECKS))


@query(f"WITH {cte(*TABLES)} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (WHERE NOT ({duck(c)}))::BIGINT AS violations FROM r_{t}" for n, t, c in CHECKS))
def q_check_constraints(spark, sf):
    parts = []
    for t in TABLES:
        # one scan and one row for each table, its checks as columns, turned to rows
        mine = [(n, c) for n, of, c in CHECKS if of == t]
        row = D.violations(reg(spark, sf, t), {f"c{i}": F.expr(jvm(c)) for i, (_, c) in enumerate(mine)})
        stack = ", ".join(f"'{n}', c{i}" for i, (n, _) in enumerate(mine))
        parts.append(row.selectExpr(f"stack({len(mine)}, {stack}) AS (name, violations)"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"WITH {cte('contracts')} SELECT contract_id, file_sha256 FROM r_contracts WHERE NOT regexp_full_match(file_sha256, '[0-9a-f]{{64}}')")
def q_check_sha256(spark, sf):
    return reg(spark, sf, "contracts").where(~F.col("file_sha256").rlike("^[0-9a-f]{64}$")).select("contract_id", "file_sha256")


# Child, its key, parent, its key.
FOREIGN = (
    ("role_profiles", "user_id", "users", "user_id"), ("contracts", "user_id", "users", "user_id"), ("contracts", "profile_id", "role_profiles", "profile_id"),
    ("contracts", "language_code", "language_catalog", "code"), ("users", "locale", "language_catalog", "code"),
    ("analysis_jobs", "contract_id", "contracts", "contract_id"), ("analysis_jobs", "requested_by", "users", "user_id"), ("analysis_jobs", "language_code", "language_catalog", "code"),
    ("risk_items", "job_id", "analysis_jobs", "job_id"), ("risk_items", "contract_id", "contracts", "contract_id"),
    ("disputed_clauses", "job_id", "analysis_jobs", "job_id"), ("disputed_clauses", "contract_id", "contracts", "contract_id"),
    ("summaries", "job_id", "analysis_jobs", "job_id"), ("summaries", "contract_id", "contracts", "contract_id"),
    ("audit_logs", "user_id", "users", "user_id"), ("audit_logs", "contract_id", "contracts", "contract_id"), ("audit_logs", "job_id", "analysis_jobs", "job_id"),
    ("app_config", "updated_by", "users", "user_id"),
)
FK_TABLES = tuple(dict.fromkeys(x for c, _, p, _ in FOREIGN for x in (c, p)))


@query(f"WITH {cte(*FK_TABLES)} " + " UNION ALL ".join(
    f"SELECT '{c}.{ck}' AS fk, count(*)::BIGINT AS orphans FROM r_{c} x WHERE x.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r_{p} y WHERE y.{pk} = x.{ck})" for c, ck, p, pk in FOREIGN))
def q_fk_orphans(spark, sf):
    return D.orphans({t: reg(spark, sf, t) for t in FK_TABLES}, list(FOREIGN))


UNIQUE = (("users", ("email",)), ("contracts", ("storage_key",)), ("role_profiles", ("user_id", "role")), ("analysis_jobs", ("idempotency_key",)), ("summaries", ("job_id",)))


@query(f"WITH {cte(*[t for t, _ in UNIQUE])} " + " UNION ALL ".join(
    f"SELECT '{t}' AS name, concat_ws('|', {', '.join(k)}) AS value, count(*)::BIGINT AS n FROM r_{t} GROUP BY {', '.join(k)} HAVING count(*) > 1" for t, k in UNIQUE))
def q_unique_keys(spark, sf):
    parts = [D.duplicates(reg(spark, sf, t), list(k)).select(F.lit(t).alias("name"), F.concat_ws("|", *[F.col(c).cast("string") for c in k]).alias("value"), "n") for t, k in UNIQUE]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"""WITH {cte('language_catalog', 'role_profiles')} SELECT 'language' AS kind, scope AS id, count(*)::BIGINT AS defaults FROM r_language_catalog WHERE is_default GROUP BY scope HAVING count(*) > 1
  UNION ALL SELECT 'role', user_id, count(*)::BIGINT FROM r_role_profiles WHERE is_default GROUP BY user_id HAVING count(*) > 1""")
def q_single_default(spark, sf):
    of = lambda t, key, kind: D.many_defaults(reg(spark, sf, t), key, F.col("is_default")).select(F.lit(kind).alias("kind"), F.col("user_id").alias("id"), "defaults")
    return of("language_catalog", "scope", "language").unionByName(of("role_profiles", "user_id", "role"))


@query(f"""WITH {cte('language_catalog')} SELECT scope, arg_min(code, (CASE WHEN is_default THEN 0 ELSE 1 END, code)) FILTER (WHERE is_active) AS code,
  CASE WHEN count(*) FILTER (WHERE is_active) = 0 THEN 'no active language' END AS error FROM r_language_catalog GROUP BY scope""")
def q_default_language(spark, sf):
    return D.default_language(reg(spark, sf, "language_catalog"))


@query(f"""WITH {cte('language_catalog')}, s AS (SELECT *, coalesce(bool_or(is_active AND code = 'en') OVER (PARTITION BY scope), false) AS can FROM r_language_catalog)
  SELECT scope, code, CASE WHEN can THEN code = 'en' ELSE is_default END AS is_default FROM s""")
def q_set_default(spark, sf):
    return D.set_default(reg(spark, sf, "language_catalog"), "en").select("scope", "code", "is_default")


@query(f"""WITH {cte('language_catalog')}, a AS (SELECT scope, coalesce(array_to_string(list(code ORDER BY code) FILTER (WHERE is_active), ','), '') AS supported,
    coalesce(bool_or(is_default AND is_active), false) AS fine, min(code) FILTER (WHERE is_active) AS first, arg_min(code, code) FILTER (WHERE is_active AND is_default) AS held FROM r_language_catalog GROUP BY scope)
  SELECT scope, supported, supported <> 'en,fr,it,ru' AS drifted, CASE WHEN fine THEN held ELSE first END AS elected FROM a""")
def q_supported_sync(spark, sf):
    return D.supported_sync(reg(spark, sf, "language_catalog"), ",".join(sorted(R.LANGUAGES)))


REQUIRED = (("jobs.min_priority", "integer"), ("jobs.max_priority", "integer"), ("quality.target", "integer"), ("language.default", "string"))
_REQ_SQL = R.values(REQUIRED) + " AS q(config_key, value_type)"


@query(f"""WITH {cte('app_config')}, s AS (SELECT DISTINCT scope FROM r_app_config), w AS (SELECT s.scope, q.config_key, q.value_type FROM s CROSS JOIN {_REQ_SQL}),
  j AS (SELECT w.*, c.value_json FROM w LEFT JOIN r_app_config c ON c.scope = w.scope AND c.config_key = w.config_key AND c.value_type = w.value_type)
  SELECT scope, config_key, CASE WHEN value_type = 'string' THEN trim(value_json, '"') WHEN regexp_full_match(value_json, '[0-9]+') THEN value_json END AS value,
    CASE WHEN value_json IS NULL THEN 'missing' WHEN value_type = 'integer' AND NOT regexp_full_match(value_json, '[0-9]+') THEN 'not an integer' END AS error FROM j""")
def q_typed_config(spark, sf):
    return D.typed_config(reg(spark, sf, "app_config"), REQUIRED)


@query(f"""WITH {cte('app_config')} SELECT scope, config_key, value_type, CASE WHEN value_json LIKE '"%' THEN 'string' WHEN regexp_full_match(value_json, '-?[0-9]+') THEN 'integer' ELSE 'other' END AS held FROM r_app_config
  WHERE value_type <> CASE WHEN value_json LIKE '"%' THEN 'string' WHEN regexp_full_match(value_json, '-?[0-9]+') THEN 'integer' ELSE 'other' END""")
def q_json_type_check(spark, sf):
    schema = F.schema_of_variant(F.try_parse_json("value_json"))
    held = F.when(schema == "STRING", "string").when(schema == "BIGINT", "integer").otherwise("other")
    return reg(spark, sf, "app_config").select("scope", "config_key", "value_type", held.alias("held")).where("value_type <> held")


@query(f"""WITH {cte('app_config', 'language_catalog')}, v AS (SELECT scope, max(try_cast(value_json AS BIGINT)) FILTER (WHERE config_key = 'jobs.min_priority') AS lo, max(try_cast(value_json AS BIGINT)) FILTER (WHERE config_key = 'jobs.max_priority') AS hi,
    max(try_cast(value_json AS BIGINT)) FILTER (WHERE config_key = 'quality.target') AS target, max(trim(value_json, '"')) FILTER (WHERE config_key = 'language.default') AS lang FROM r_app_config GROUP BY scope),
  ok AS (SELECT DISTINCT scope, code FROM r_language_catalog WHERE is_active)
  SELECT v.scope, coalesce(1 <= lo AND lo <= hi AND hi <= 9, false) AS range_ok, coalesce(0 < target AND target <= 8, false) AS target_ok, ok.code IS NOT NULL AS default_ok FROM v LEFT JOIN ok ON ok.scope = v.scope AND ok.code = v.lang""")
def q_config_invariants(spark, sf):
    return D.config_invariants(reg(spark, sf, "app_config"), reg(spark, sf, "language_catalog"), cap=8)


@query(f"""WITH {cte('contracts', 'audit_logs')} SELECT 'contracts' AS kept_in, contract_id AS id FROM r_contracts WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMP '1998-01-31' - INTERVAL 30 DAY
  UNION ALL SELECT 'audit_logs', event_id FROM r_audit_logs WHERE created_at >= TIMESTAMP '2025-01-20' - INTERVAL 365 DAY""")
def q_retention_purge(spark, sf):
    gone, logs = reg(spark, sf, "contracts"), reg(spark, sf, "audit_logs")
    kept = gone.where("deleted_at IS NULL").unionByName(D.retained(gone.where("deleted_at IS NOT NULL"), "deleted_at", "1998-01-31 00:00:00", 30))
    return kept.select(F.lit("contracts").alias("kept_in"), F.col("contract_id").alias("id")).unionByName(
        D.retained(logs, "created_at", "2025-01-20 00:00:00", 365).select(F.lit("audit_logs").alias("kept_in"), F.col("event_id").alias("id")))


CHILDREN = (("analysis_jobs", "job_id"), ("risk_items", "risk_id"), ("disputed_clauses", "dispute_id"), ("summaries", "summary_id"))


@query(f"WITH {cte('contracts', 'audit_logs', *[t for t, _ in CHILDREN])}, gone AS (SELECT contract_id FROM r_contracts WHERE status = 'analyzing') " + " UNION ALL ".join(
    [f"SELECT '{t}' AS child, {k} AS id, contract_id::VARCHAR AS contract_id FROM r_{t} x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.contract_id = x.contract_id)" for t, k in CHILDREN]
    + ["SELECT 'audit_logs', event_id, CASE WHEN g.contract_id IS NULL THEN x.contract_id END::VARCHAR FROM r_audit_logs x LEFT JOIN gone g ON g.contract_id = x.contract_id"]))
def q_cascade_delete(spark, sf):
    gone = reg(spark, sf, "contracts").where("status = 'analyzing'").select("contract_id")
    left = [D.cascaded(reg(spark, sf, t), gone, "contract_id").select(F.lit(t).alias("child"), F.col(k).alias("id"), "contract_id") for t, k in CHILDREN]
    logs = D.nulled(reg(spark, sf, "audit_logs"), gone, "contract_id").select(F.lit("audit_logs").alias("child"), F.col("event_id").alias("id"), "contract_id")
    return reduce(lambda a, b: a.unionByName(b), [*left, logs]).withColumn("contract_id", F.col("contract_id").cast("string"))


@query(f"""WITH {cte('analysis_jobs')}, q AS (SELECT job_id, contract_id, priority, created_at, requested_by FROM r_analysis_jobs WHERE status IN ('queued', 'running'))
  SELECT job_id, requested_by, priority, row_number() OVER (ORDER BY priority DESC, created_at, job_id, contract_id, requested_by)::BIGINT AS place FROM q""")
def q_job_queue(spark, sf):
    waiting = reg(spark, sf, "analysis_jobs").where("status IN ('queued', 'running')").withColumn("rank", -F.col("priority"))
    return D.ranked_by_ranges(waiting, ["rank", "created_at"], ["job_id", "contract_id", "requested_by"]).select("job_id", "requested_by", "priority", "place")


# Children of a contract: kind, table, id, label, number.
NESTED = (
    ("jobs", "analysis_jobs", "job_id", "status", "priority"), ("risks", "risk_items", "risk_id", "severity", "score"),
    ("disputes", "disputed_clauses", "dispute_id", "clause_text", "confidence"), ("summaries", "summaries", "summary_id", "brief", "job_id"),
)


@query(f"WITH {cte('users', 'contracts', *(c[1] for c in NESTED))}, ch AS (" + " UNION ALL ".join(
    f"SELECT contract_id, '{k}' AS kind, {i} AS id, {l} AS label, round({v}::DOUBLE, 6) AS number FROM r_{t}" for k, t, i, l, v in NESTED) + """)
  SELECT c.contract_id, u.email, ch.kind, row_number() OVER (PARTITION BY c.contract_id, ch.kind ORDER BY ch.id, ch.label, ch.number)::INT AS n, ch.id, ch.label, ch.number
  FROM r_contracts c LEFT JOIN r_users u ON u.user_id = c.user_id LEFT JOIN ch ON ch.contract_id = c.contract_id""")
def q_report_fetch(spark, sf):
    owners = reg(spark, sf, "users").select("user_id", "email")
    contracts = bucketed(reg(spark, sf, "contracts").select("contract_id", "user_id").join(owners, "user_id", "left"), "contracts", "contract_id")
    children = {
        kind: (bucketed(reg(spark, sf, t).select("contract_id", F.col(i).alias("id"), F.col(label).alias("label"), F.round(F.col(v).cast("double"), 6).alias("number")), t, "contract_id"), ["id", "label", "number"])
        for kind, t, i, label, v in NESTED}
    nested = D.report_fetch(contracts, children, "contract_id")
    rows = F.concat(*[_numbered(kind) for kind, *_ in NESTED])
    return nested.select("contract_id", "email", F.inline_outer(rows))


def _numbered(kind: str):
    return F.transform(kind, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("n"), x["id"].alias("id"), x["label"].alias("label"), x["number"].alias("number")))


@query(f"""WITH {cte('contracts', 'analysis_jobs', 'risk_items', 'audit_logs')},
  h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, contract_id DESC) AS n FROM r_contracts WHERE deleted_at IS NULL),
  l AS (SELECT contract_id, arg_max(job_id, (created_at, job_id)) AS job_id FROM r_analysis_jobs GROUP BY 1),
  k AS (SELECT job_id, severity, score, row_number() OVER (PARTITION BY job_id, severity ORDER BY score DESC, risk_id) AS n FROM r_risk_items)
  SELECT 'history' AS pattern, user_id::VARCHAR AS k, contract_id::DOUBLE AS v FROM h WHERE n <= 3
  UNION ALL SELECT 'status', status, count(*)::DOUBLE FROM r_contracts GROUP BY status
  UNION ALL SELECT 'active', user_id::VARCHAR, count(*)::DOUBLE FROM r_contracts WHERE deleted_at IS NULL GROUP BY user_id
  UNION ALL SELECT 'latest_job', contract_id::VARCHAR, job_id::DOUBLE FROM l
  UNION ALL SELECT 'top_risk', job_id || ':' || severity, round(score, 3)::DOUBLE FROM k WHERE n = 1
  UNION ALL SELECT 'category', category || ':' || role_impact, count(*)::DOUBLE FROM r_risk_items GROUP BY category, role_impact
  UNION ALL SELECT 'events', event_type, count(*)::DOUBLE FROM r_audit_logs GROUP BY event_type""")
def q_idx_queries(spark, sf):
    """Access patterns over tables that are laid out for them: contracts by status and in buckets of users, jobs in buckets of contracts, risks of jobs, events by type."""
    c = bucketed(reg(spark, sf, "contracts").select("contract_id", "user_id", "status", "uploaded_at", "deleted_at"), "contracts", "user_id", by="status", order=("uploaded_at",))
    j = bucketed(reg(spark, sf, "analysis_jobs").select("job_id", "contract_id", "created_at"), "jobs", "contract_id", order=("created_at",))
    r = bucketed(reg(spark, sf, "risk_items").select("risk_id", "job_id", "severity", "score", "category", "role_impact"), "risks", "job_id")
    a = reg(spark, sf, "audit_logs")
    live = c.where("deleted_at IS NULL")
    out = lambda df, name, k, v: df.select(F.lit(name).alias("pattern"), k.cast("string").alias("k"), v.cast("double").alias("v"))
    n = lambda *by: F.row_number().over(W.partitionBy(*by[:-1]).orderBy(*by[-1]))
    newest = live.withColumn("n", n("user_id", [F.desc("uploaded_at"), F.desc("contract_id")])).where("n <= 3")
    latest = j.groupBy("contract_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
    worst = r.withColumn("n", n("job_id", "severity", [F.desc("score"), "risk_id"])).where("n = 1")
    count = F.col("count")
    return reduce(lambda x, y: x.unionByName(y), [
        out(newest, "history", F.col("user_id"), F.col("contract_id")), out(c.groupBy("status").count(), "status", F.col("status"), count),
        out(live.groupBy("user_id").count(), "active", F.col("user_id"), count), out(latest, "latest_job", F.col("contract_id"), F.col("job_id")),
        out(worst, "top_risk", F.concat_ws(":", F.col("job_id").cast("string"), "severity"), F.round("score", 3)),
        out(r.groupBy("category", "role_impact").count(), "category", F.concat_ws(":", "category", "role_impact"), count), out(a.groupBy("event_type").count(), "events", F.col("event_type"), count)])


@query(f"""WITH {cte('contracts', 'analysis_jobs', 'risk_items', 'summaries')}, rl AS (SELECT DISTINCT contract_id FROM r_risk_items), ng AS (SELECT DISTINCT contract_id FROM r_risk_items WHERE role_impact = 'negative')
  SELECT (SELECT avg((status = 'completed')::INT) FROM r_analysis_jobs WHERE status IN ('completed', 'failed'))::DOUBLE AS success_rate,
    (SELECT avg((status IN ('completed', 'failed'))::INT) FROM r_analysis_jobs)::DOUBLE AS terminal_share, (SELECT avg((brief <> '')::INT) FROM r_summaries)::DOUBLE AS brief_share,
    (SELECT avg((rl.contract_id IS NOT NULL)::INT) FROM r_contracts c LEFT JOIN rl ON rl.contract_id = c.contract_id)::DOUBLE AS risk_share,
    (SELECT avg((language_code = locale)::INT) FROM r_contracts)::DOUBLE AS language_is_locale, (SELECT avg((language_code IN ('ru', 'en', 'it', 'fr'))::INT) FROM r_contracts)::DOUBLE AS localized_share,
    (SELECT avg((ng.contract_id IS NOT NULL)::INT) FROM r_contracts c LEFT JOIN ng ON ng.contract_id = c.contract_id)::DOUBLE AS role_share,
    (SELECT avg(l.quality) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE contains(lower(d.text), 'license'))::DOUBLE AS rule_precision""")
def q_quality_metrics(spark, sf):
    c, j, r, s = (reg(spark, sf, t) for t in ("contracts", "analysis_jobs", "risk_items", "summaries"))
    share = lambda cond: F.avg(cond.cast("int"))
    done = F.col("status").isin("completed", "failed")
    jobs = j.agg(F.avg(F.when(done, (F.col("status") == "completed").cast("int"))).alias("success_rate"), share(done).alias("terminal_share"))
    flags = r.groupBy("contract_id").agg(F.max((F.col("role_impact") == "negative").cast("int")).alias("negative"))
    held = c.join(flags, "contract_id", "left").agg(
        share(F.col("negative").isNotNull()).alias("risk_share"), share(F.col("language_code") == F.col("locale")).alias("language_is_locale"),
        share(F.col("language_code").isin(*R.LANGUAGES)).alias("localized_share"), F.avg(F.coalesce("negative", F.lit(0))).alias("role_share"))
    found = T.table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("license"))).join(T.table(spark, sf, "labels"), "doc_id").agg(F.avg("quality").alias("rule_precision"))
    # each side is one row
    return jobs.join(s.agg(share(F.col("brief") != "").alias("brief_share")), how="cross").join(held, how="cross").join(found, how="cross")


# A rule pack of each customer, as JSON; some lack a language, a known severity, its label, a mode's name or server assist.
PACKS = """SELECT c_custkey AS pack_id, '{"rules":[' || '{"id":"r' || CAST(c_custkey AS VARCHAR(20)) || '","severity":"' || CASE WHEN c_custkey % 9 = 4 THEN 'severe' WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END
  || '","keywords":["' || lower(c_mktsegment) || '","penalty"],"title":{"ru":"a","en":"b"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"it":"c"' END || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ',"fr":"d"' END || '}}],"labels":{"low":"L"'
  || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',"high":"H"' END || ',"severe":"S"},"modes":["' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'local_first' END || '","server_assist"],"network_modes":["' || CASE WHEN c_custkey % 8 = 0 THEN 'local_first' ELSE 'server_assist' END || '"]}' AS pack FROM customer"""
PACK_SCHEMA = "rules array<struct<id:string,severity:string,keywords:array<string>,title:map<string,string>>>, labels map<string,string>, modes array<string>, network_modes array<string>"


def _packs(spark, sf):
    sql = PACKS.replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}")
    return spark.sql(sql, customer=T.table(spark, sf, "customer")).select("pack_id", F.from_json("pack", PACK_SCHEMA).alias("p")).select("pack_id", "p.*")


@query(f"""WITH p AS ({PACKS}), r AS (SELECT pack_id, json_extract(pack, '$.rules[0]') AS r FROM p)
  SELECT pack_id, r->>'$.id' AS rule_id, r->>'$.severity' AS severity, k.keyword FROM r, LATERAL (SELECT unnest(from_json(json_extract(r, '$.keywords'), '["VARCHAR"]')) AS keyword) k""")
def q_rule_pack_load(spark, sf):
    rules = _packs(spark, sf).select("pack_id", F.explode("rules").alias("r"))
    return rules.select("pack_id", F.col("r.id").alias("rule_id"), F.col("r.severity").alias("severity"), F.explode("r.keywords").alias("keyword"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 4 THEN 'severe' WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS s FROM customer)
  SELECT k AS pack_id, 'title:it' AS violation FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'title:fr' FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 'severity:severe' FROM c WHERE s = 'severe'
  UNION ALL SELECT k, 'label:high' FROM c WHERE s = 'high' AND k % 5 = 0 UNION ALL SELECT k, 'mode:empty' FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'network:local_first' FROM c WHERE k % 8 = 0""")
def q_rule_pack_validate(spark, sf):
    return D.pack_violations(_packs(spark, sf), list(R.LANGUAGES), list(R.SEVERITY_RANK))


@query(f"WITH {MATCH_CTE} SELECT contract_id, clause_index, rule_id, {case_sql(R.SEVERITY_RANK, 'severity')}::INT AS rank, CASE WHEN severity = 'critical' THEN 0 ELSE {case_sql(R.UI_ORDER, 'severity')} END::INT AS ui_order FROM matched")
def q_severity_map(spark, sf):
    ui = F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity"))
    return matched(spark, sf).select("contract_id", "clause_index", "rule_id", L.lookup(R.SEVERITY_RANK, F.col("severity")).alias("rank"), L.lookup(R.UI_ORDER, ui).alias("ui_order"))


@query(f"""WITH {MATCH_CTE}, g AS (SELECT contract_id, {LOCALE} AS language FROM contracts)
  SELECT m.contract_id, m.clause_index, m.rule_id, l.label || ': ' || m.rule_id AS title FROM matched m JOIN g ON g.contract_id = m.contract_id JOIN {R.LABEL_SQL} ON l.severity = m.severity AND l.language = g.language""")
def q_severity_label(spark, sf):
    docs = T.contracts(spark, sf).select("contract_id", L.locale_precedence(F.col("language_raw"), F.col("locale_raw")).alias("language"))
    rows = matched(spark, sf).select("contract_id", "clause_index", "rule_id", "severity").join(docs.hint("shuffle_hash"), "contract_id")
    return rows.select("contract_id", "clause_index", "rule_id", F.concat_ws(": ", L.severity_label(F.col("language"), F.col("severity")), "rule_id").alias("title"))


# Documents in the language of their lang, the default one for others; a hundred repeats make some of them too long.
_GATE_LANG = "CASE WHEN lang IN ('ru', 'en', 'it', 'fr') THEN lang ELSE 'ru' END"


@query(f"""WITH t AS (SELECT doc_id, {_GATE_LANG} AS language, CASE WHEN doc_id % 10 = 3 THEN repeat(text, 100) ELSE text END AS text FROM documents),
  e AS (SELECT doc_id, language, CASE WHEN length(text) > {R.MAX_TEXT_CHARS} THEN 'text_too_long' WHEN length(to_base64(encode(text))) > {R.MAX_BASE64_CHARS} THEN 'payload_too_long' END AS error FROM t)
  SELECT e.doc_id, e.error, n.words AS message FROM e LEFT JOIN {R.words_sql(R.NOTICES)} AS n(code, lang, words) ON n.code = e.error AND n.lang = e.language""")
def q_length_gate(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", F.expr(_GATE_LANG).alias("language"), F.expr("CASE WHEN doc_id % 10 = 3 THEN repeat(text, 100) ELSE text END").alias("text"))
    gate = docs.select("doc_id", "language", L.length_error(F.col("text"), F.base64(F.encode("text", "UTF-8"))).alias("error"))
    return gate.select("doc_id", "error", L.said(R.NOTICES, F.col("error"), F.col("language")).alias("message"))


# Texts whose lengths go beyond the bounds for some orders.
FIELDS = {"role": "CASE o_orderkey % 40 WHEN 0 THEN 'x' WHEN 1 THEN repeat('r', 65) ELSE 'buyer' END", "counterparty_role": "repeat('c', CAST(o_orderkey % 90 AS INT))", "name": "repeat('n', CAST(o_orderkey % 300 AS INT))",
          "mime_type": "repeat('m', CAST(o_orderkey % 160 AS INT))", "language": "repeat('l', CAST(o_orderkey % 11 AS INT))", "label": "repeat('b', CAST(o_orderkey % 140 AS INT))", "notes": "repeat('t', CAST(o_orderkey % 600 AS INT))"}
BOUNDS = {"role": (2, 64), "counterparty_role": (0, 64), "name": (1, 255), "mime_type": (0, 128), "language": (2, 8), "label": (0, 120), "notes": (0, 500)}
_FIELDS_SQL = "SELECT o_orderkey AS contract_id, " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM orders"


@query(f"""WITH f AS ({_FIELDS_SQL}), v AS (SELECT contract_id, list_filter([{', '.join(f"CASE WHEN length({k}) NOT BETWEEN {lo} AND {hi} THEN '{k}' END" for k, (lo, hi) in BOUNDS.items())}], lambda x: x IS NOT NULL) AS bad FROM f)
  SELECT contract_id, array_to_string(bad, ',') AS violations FROM v WHERE len(bad) > 0""")
def q_field_checks(spark, sf):
    rows = spark.sql(_FIELDS_SQL.replace("FROM orders", "FROM {orders}"), orders=T.table(spark, sf, "orders"))
    bad = F.array_compact(F.array(*[F.when(~F.length(c).between(lo, hi), c) for c, (lo, hi) in BOUNDS.items()]))
    return rows.select("contract_id", F.array_join(bad, ",").alias("violations")).where("violations <> ''")


VALIDATION = (
    ("users have emails", "users", "email IS NULL"), ("contracts have sizes", "contracts", "size_bytes <= 0"), ("digests are hexadecimal", "contracts", "NOT RX(file_sha256, '^[0-9a-f]{64}$')"),
    ("priorities are in range", "analysis_jobs", "priority NOT BETWEEN 1 AND 9"), ("job states are known", "analysis_jobs", f"status NOT IN {STATES}"), ("severities are known", "risk_items", "severity NOT IN ('low', 'medium', 'high', 'critical')"),
    ("scores are in range", "risk_items", "score NOT BETWEEN 0 AND 100"), ("confidences are in range", "risk_items", "confidence NOT BETWEEN 0 AND 1"), ("defaults are active", "language_catalog", "is_default AND NOT is_active"),
    ("keys are well formed", "app_config", "NOT RX(config_key, '^[a-z][a-z0-9_.]*$')"), ("payloads are objects", "audit_logs", "NOT RX(event_payload, '^\\{')"), ("briefs are there", "summaries", "brief = ''"),
)
_RV_TABLES = tuple(dict.fromkeys([t for _, t, _ in VALIDATION] + list(FK_TABLES)))


@query(f"WITH {cte(*_RV_TABLES)} " + " UNION ALL ".join(
    [f"SELECT '{n}' AS name, count(*) FILTER (WHERE {duck(c)}) = 0 AS passed FROM r_{t}" for n, t, c in VALIDATION]
    + [f"SELECT '{c}.{ck} has a parent', count(*) = 0 FROM r_{c} x WHERE x.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r_{p} y WHERE y.{pk} = x.{ck})" for c, ck, p, pk in FOREIGN]
    + [f"SELECT '{t} keys are unique', NOT EXISTS (SELECT 1 FROM r_{t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in UNIQUE]))
def q_runtime_validation(spark, sf):
    parts = []
    for t in dict.fromkeys(t for _, t, _ in VALIDATION):
        mine = [(n, c) for n, of, c in VALIDATION if of == t]
        row = reg(spark, sf, t).agg(*[(F.count(F.when(F.expr(jvm(c)), 1)) == 0).alias(f"c{i}") for i, (_, c) in enumerate(mine)])
        parts.append(row.selectExpr(f"stack({len(mine)}, " + ", ".join(f"'{n}', c{i}" for i, (n, _) in enumerate(mine)) + ") AS (name, passed)"))
    parts.append(q_fk_orphans(spark, sf).select(F.concat("fk", F.lit(" has a parent")).alias("name"), (F.col("orphans") == 0).alias("passed")))
    for t, k in UNIQUE:
        n = D.duplicates(reg(spark, sf, t), list(k)).agg((F.count("*") == 0).alias("passed"))
        parts.append(n.select(F.lit(f"{t} keys are unique").alias("name"), "passed"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(f"WITH {cte('contracts')} SELECT contract_id, storage_key, status, size_bytes::BIGINT AS size_bytes FROM r_contracts")
def q_record_scan(spark, sf):
    """Contract records as JSON files in the shared folder, read back with a declared schema; files of other names there are left alone."""
    at = new_folder(spark, "records")
    rows = reg(spark, sf, "contracts").select("contract_id", "storage_key", "status", F.col("size_bytes").cast("long").alias("size_bytes"))
    rows.write.json(f"{at}/a")
    rows.select(F.lit("not a record").alias("value")).limit(1).write.text(f"{at}/b")
    return T.record_scan(spark, f"{at}/*", "contract_id LONG, storage_key STRING, status STRING, size_bytes LONG", one_per_file=False)


@query(f"WITH {C}, g AS (SELECT contract_id, role, {LOCALE} AS language FROM contracts) SELECT language, contract_id, role FROM g")
def q_report_sink(spark, sf):
    """One report a contract as JSON, a folder for each language, replaced by a second write, and read back."""
    at = new_folder(spark, "reports") + "/out"
    reports = T.contracts(spark, sf).select("contract_id", "role", L.locale_precedence(F.col("language_raw"), F.col("locale_raw")).alias("language"))
    T.report_sink(reports.where("contract_id % 2 = 0"), at)
    T.report_sink(reports, at)
    return spark.read.schema("contract_id LONG, role STRING, language STRING").json(at).select("language", "contract_id", "role")
