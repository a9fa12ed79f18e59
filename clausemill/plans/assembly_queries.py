"""Candidates, final orders, briefs and reports; scores that choose between extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import payload
from ..functions import shape as S
from ..functions import text as X
from ..operators import report as P
from ..operators import safe, segmentation
from ..sources import rules as R
from ..sources import tables as T
from .match_queries import MATCH_CTE, disputed, matched
from .registry import query
from .report_queries import DISPUTES, RISKS
from .request_queries import LOCALE, TEXTS_CTE, case_sql
from .text_queries import CLAUSES_CTE, COLLAPSE, COUNT, STATEMENTS_CTE, _html_sql, clauses, rx

KEY = "contract_id"


def score_sql(c: str) -> str:
    n = lambda p: COUNT.format(c, rx(p))
    a, b, d, e = n(X.CASED), n(X.SPACE), n(X.BAD), n(X.C1)
    return f"(({a} * 20 + {b} * 4 - {d} * 40 - {e} * 10 + (length({c}) - {a} - {b} - {d} - {e}) * 10) / 10.0)::DOUBLE"


FLAT = COLLAPSE.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")


@query(f"SELECT doc_id, {score_sql('text')} AS score FROM documents")
def q_char_class_score(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.char_class_score(F.col("text")).alias("score"))


@query(f"""WITH p AS (SELECT page_id, {_html_sql()} AS s, {FLAT} AS f FROM pages)
  SELECT page_id, CASE WHEN s <> '' AND length(s) * 10 >= length(f) * 6 THEN s ELSE f END AS text FROM p""")
def q_structured_or_flat(spark, sf):
    html = F.col("html")
    return T.table(spark, sf, "pages").select("page_id", X.structured_or_flat(X.html_to_text(html), X.flat_text(html)).alias("text"))


@query(f"""WITH c AS (SELECT page_id, 'text' AS kind, {_html_sql()} AS t FROM pages UNION ALL SELECT page_id, 'flat', {FLAT} FROM pages),
  s AS (SELECT page_id, kind, length(t) AS n, {score_sql('t')} AS score FROM c)
  SELECT page_id, arg_max(kind, (score, n, kind)) AS kind, max(score) AS score FROM s GROUP BY page_id""")
def q_best_candidate(spark, sf):
    html = F.col("html")
    scored = F.array(*[
        F.struct(X.char_class_score(t).alias("score"), F.length(t).alias("n"), F.lit(kind).alias("kind"))
        for kind, t in (("text", X.html_to_text(html)), ("flat", X.flat_text(html)))])
    best = T.table(spark, sf, "pages").select("page_id", F.array_max(scored).alias("b"))
    return best.select("page_id", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


_TAILED = "clause_text || ' ' || (clause_index + 1) || '.2)'"
_BARE = rf"regexp_replace(regexp_replace({_TAILED}, '[.!?]\d+(?:[.,]\d+){{0,5}}[.)]?\s*$', ''), '\s+\d+(?:[.,]\d+){{0,5}}[.)]?\s*$', '')"


@query(rf"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, regexp_replace({_BARE}, '\s+$', '') AS text FROM clauses")
def q_strip_trailing_marker(spark, sf):
    tailed = F.concat("clause_text", F.lit(" "), (F.col("clause_index") + 1).cast("string"), F.lit(".2)"))
    return clauses(spark, sf).select(KEY, "clause_index", S.strip_trailing_marker(tailed).alias("text"))


_POINTS = rf"""{TEXTS_CTE}, cut AS (
  SELECT contract_id, regexp_split_to_array(regexp_replace({COLLAPSE.format('document_text')}, '([.!?])\s+', '\1' || chr(10), 'g'), '[\n;]+') AS parts FROM filled
), points AS (
  SELECT contract_id, trim(regexp_replace(regexp_replace(trim(unnest(parts)), '^[\x{{2022}}\x{{25AA}}\x{{2023}}\x{{25E6}}*-]\s*', ''), '^\d+(?:\.\d+)*[.)]\s*', '')) AS x, generate_subscripts(parts, 1) AS i FROM cut
), firsts AS (SELECT contract_id, x, min(i) AS i FROM points WHERE x <> '' GROUP BY 1, 2), placed AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY i) AS n FROM firsts)"""


@query(f"WITH {_POINTS} SELECT contract_id, array_to_string(list(x ORDER BY n), '|') AS points FROM placed WHERE n <= 8 GROUP BY 1")
def q_report_points(spark, sf):
    docs = segmentation.with_text(T.contracts(spark, sf))
    return docs.select(KEY, F.array_join(X.report_points(F.col("document_text")), "|").alias("points")).where("points <> ''")


@query(f"WITH {T.CONTRACTS_CTE}, c AS (SELECT contract_id, {LOCALE} AS language, coalesce({case_sql(R.TYPE_OF_MIME, 'mime_type')}, 'other') AS kind FROM contracts) SELECT c.contract_id, y.label AS type FROM c JOIN {R.TYPE_LABEL_SQL} ON y.language = c.language AND y.kind = c.kind")
def q_type_label_by_mime(spark, sf):
    language = L.locale_precedence(F.col("language_raw"), F.col("locale_raw"))
    return T.contracts(spark, sf).select(KEY, L.type_label(language, F.col("mime_type")).alias("type"))


@query(f"WITH {MATCH_CTE} SELECT contract_id, rule_id, array_to_string(list('clause ' || (clause_index + 1) ORDER BY clause_index), ', ') AS labels FROM matched GROUP BY 1, 2")
def q_clause_labels(spark, sf):
    refs = F.concat(F.array(F.lit("overview"), F.lit("system")), F.transform(F.array_sort(F.collect_set("clause_index")), lambda i: (i + 1).cast("string")))
    labels = F.array_distinct(F.transform(F.filter(refs, lambda r: ~r.isin("overview", "system")), lambda r: F.concat(F.lit("clause "), r)))
    return matched(spark, sf).groupBy(KEY, "rule_id").agg(F.array_join(labels, ", ").alias("labels"))


CANDIDATES = f"""{CLAUSES_CTE}, candidates AS (
  SELECT c.contract_id, c.clause_index, k.rule_id, k.rule_index, k.severity, count(*) AS marker_hits, count(*) * 4 AS lexical
  FROM clauses c JOIN {R.KEYWORDS_SQL} ON contains(lower(c.clause_text), k.keyword) GROUP BY ALL)"""


def _candidates(spark, sf):
    return P.candidates(clauses(spark, sf), R.keywords(spark), KEY)


@query(f"WITH {CANDIDATES} SELECT contract_id, clause_index, rule_id, marker_hits, lexical FROM candidates")
def q_clause_risk_candidates(spark, sf):
    return _candidates(spark, sf).select(KEY, "clause_index", "rule_id", "marker_hits", "lexical")


@query(f"WITH {CANDIDATES} SELECT contract_id, clause_index, rule_id, row_number() OVER (PARTITION BY contract_id ORDER BY lexical DESC, marker_hits DESC, clause_index, rule_index)::INT AS n FROM candidates")
def q_clause_candidate_order(spark, sf):
    return P.candidate_order(_candidates(spark, sf), KEY).select(KEY, "clause_index", "rule_id", "n")


@query(f"WITH {MATCH_CTE} SELECT contract_id, clause_index, excerpt, arg_min(dispute_id, (-confidence, dispute_index)) AS dispute_id, max(confidence)::DOUBLE AS confidence FROM disputed GROUP BY 1, 2, 3")
def q_clause_dispute_best(spark, sf):
    found = disputed(spark, sf).select(KEY, "clause_index", "dispute_id", "dispute_index", "confidence", "excerpt")
    return P.dispute_best(found, KEY)


FINAL = f"""{MATCH_CTE}, o AS (SELECT contract_id, rule_id, rule_index, severity, count(*) AS occurrences, min(clause_index) AS first_clause FROM matched GROUP BY ALL),
  e AS (SELECT * EXCLUDE (severity), CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN occurrences >= 2 AND severity = 'low' THEN 'medium' WHEN occurrences >= 2 AND severity = 'medium' THEN 'high' ELSE severity END AS severity FROM o),
  final AS (SELECT contract_id, row_number() OVER (PARTITION BY contract_id ORDER BY {case_sql(R.UI_ORDER, 'severity')}, occurrences DESC, first_clause, rule_index)::INT AS n, rule_id, severity, occurrences::BIGINT AS occurrences FROM e)"""


@query(f"WITH {FINAL} SELECT contract_id, n, rule_id, severity, occurrences FROM final")
def q_final_risk_order(spark, sf):
    return P.final_risk_order(matched(spark, sf), KEY)


@query(f"""WITH {FINAL}, r AS (SELECT contract_id, language, role, bool_or(contains(lower(clause_text), lower(role))) AS found FROM clauses GROUP BY ALL)
  SELECT contract_id, n, rule_id, severity, occurrences, NULL AS summary FROM final UNION ALL SELECT contract_id, 0, 'role_missing', 'medium', 1, {R.brief_sql('role_missing')} || role || '.' FROM r WHERE NOT found""")
def q_role_missing_row(spark, sf):
    return P.with_role_missing(P.final_risk_order(matched(spark, sf), KEY), clauses(spark, sf), KEY)


def _said(where: str, section: str) -> str:
    return f"coalesce(array_to_string(list(piece ORDER BY pos) FILTER (WHERE section = '{section}' AND {where})[1:2], '; '), '')"


@query(f"""WITH {STATEMENTS_CTE}, hit AS (
    SELECT DISTINCT s.contract_id, m.section, s.pos, s.piece, contains(lower(s.piece), lower(s.role)) AS own, coalesce(contains(lower(s.piece), lower(s.counterparty_role)), false) AS other
    FROM stmts s JOIN {R.SECTIONS_SQL.replace('AS s(', 'AS m(')} ON contains(lower(s.piece), m.marker)),
  g AS (SELECT contract_id, {_said('own', 'must_do')} AS own, {_said('true', 'must_do')} AS any_, {_said('other', 'must_do')} AS other,
    {_said('true', 'payment_terms')} AS pay, {_said('true', 'deadlines')} AS due, {_said('true', 'penalties')} AS fine FROM hit GROUP BY 1),
  cut AS (SELECT contract_id, list_filter(list_transform(string_split(replace(document_text, chr(13), ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM filled),
  cl AS (SELECT contract_id, unnest(parts) AS c FROM cut), n AS (SELECT contract_id, count(*) AS n FROM cl GROUP BY 1),
  d AS (SELECT contract_id, count(DISTINCT (c, dispute_id, i)) AS n FROM (SELECT contract_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS i FROM cut) x JOIN {R.MARKERS_SQL} ON contains(lower(x.c), m.marker) GROUP BY 1),
  t AS (SELECT f.contract_id, {R.brief_sql('for')} || f.role || {R.brief_sql('with')} || n.n || '.' AS opening, concat_ws(' ',
    CASE WHEN g.own <> '' THEN {R.brief_sql('own')} || g.own || '.' WHEN g.any_ <> '' THEN {R.brief_sql('any')} || g.any_ || '.' END,
    CASE WHEN g.other <> '' THEN {R.brief_sql('other')} || g.other || '.' END, CASE WHEN g.pay <> '' THEN {R.brief_sql('payment_terms')} || g.pay || '.' END,
    CASE WHEN g.due <> '' THEN {R.brief_sql('deadlines')} || g.due || '.' END, CASE WHEN g.fine <> '' THEN {R.brief_sql('penalties')} || g.fine || '.' END,
    CASE WHEN d.n > 0 THEN {R.brief_sql('disputes')} || d.n || '.' END) AS rest, f.language
    FROM filled f JOIN n ON n.contract_id = f.contract_id LEFT JOIN g ON g.contract_id = f.contract_id LEFT JOIN d ON d.contract_id = f.contract_id)
  SELECT contract_id, language, opening || ' ' || CASE WHEN rest = '' THEN {R.brief_sql('nothing')} ELSE rest END AS brief FROM t""")
def q_brief(spark, sf):
    docs = segmentation.with_text(T.contracts(spark, sf))
    return P.brief(docs, segmentation.clauses_simple(docs), disputed(spark, sf), R.section_markers(spark))


@query(f"""WITH {MATCH_CTE}, risks AS ({RISKS}), disputes AS ({DISPUTES})
  SELECT c.contract_id, r.risk_id, coalesce(r.clause_id, u.unknown) AS clause_ref, CASE r.severity WHEN 'critical' THEN 'high' ELSE r.severity END AS severity, r.title, no.words AS description, r.mitigation AS recommendation,
    (SELECT count(*) FROM disputes d WHERE d.contract_id = c.contract_id)::BIGINT AS disputes
  FROM filled c JOIN risks r ON r.contract_id = c.contract_id JOIN {R.UNKNOWN_SQL} ON u.language = c.language
    JOIN {R.words_sql(R.RULE_NOTE)} AS no(rule, lang, words) ON no.rule = coalesce(r.rule_id, 'none') AND no.lang = c.language""")
def q_core_report(spark, sf):
    report = P.core_report(P.analysis_output(spark, sf))
    rows = report.select(KEY, F.explode("risks").alias("r"), F.size("disputes").cast("long").alias("disputes"))
    return rows.select(KEY, "r.*", "disputes")


# What each request holds, and what is wrong with it, from the contract it was made of.
REQUESTS = f"""{T.CONTRACTS_CTE}, req AS MATERIALIZED (
  SELECT contract_id, {LOCALE} AS language, contract_id % 11 AS fault, CASE WHEN contract_id % 11 = 8 THEN 'application/msword' ELSE lower(trim(mime_type)) END AS mime,
    CASE WHEN contract_id % 11 = 4 THEN '' ELSE document_text END AS t FROM contracts
), read AS MATERIALIZED (
  SELECT contract_id, language, CASE WHEN fault = 3 OR t IS NULL THEN 'missing_payload' WHEN fault = 1 THEN 'invalid_base64' END AS error, t, mime, fault FROM req
), warned AS MATERIALIZED (
  SELECT contract_id, language, error, CASE WHEN fault = 4 THEN p.placeholder ELSE t END AS t, list_filter([CASE WHEN error IS NULL AND fault = 2 THEN 'invalid_utf8' END, CASE WHEN fault = 4 THEN 'empty_text' END,
    CASE WHEN error IS NULL AND mime = 'application/pdf' AND length(t) < 160 THEN 'limited_pdf_text' END, CASE WHEN mime = 'application/msword' THEN 'legacy_document' END], lambda x: x IS NOT NULL) AS warnings
  FROM read JOIN {R.PLACEHOLDER_SQL.replace("AS p(language", "AS p(lang")} ON p.lang = read.language
)"""


def _by_language(words: dict, language: str) -> str:
    return case_sql({k: v.replace("'", "''") for k, v in words.items()}, language)


def _notices(codes: str) -> str:
    return f"(SELECT string_agg(n.words, ' ' ORDER BY x.i) FROM (SELECT unnest({codes}) AS code, generate_subscripts({codes}, 1) AS i) x JOIN {R.words_sql(R.NOTICES)} AS n(code, lang, words) ON n.code = x.code AND n.lang = language)"


@query(f"""WITH {REQUESTS},
  cut AS (SELECT contract_id, list_filter(list_transform(string_split(replace(t, chr(13), ''), chr(10) || chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10))), lambda x: x <> '') AS parts FROM warned WHERE error IS NULL),
  cl AS (SELECT contract_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS i FROM cut),
  hit AS (SELECT DISTINCT contract_id, i, k.rule_id, k.rule_index, k.severity FROM cl JOIN {R.KEYWORDS_SQL} ON contains(lower(c), k.keyword)),
  ranked AS (SELECT h.*, row_number() OVER (PARTITION BY contract_id ORDER BY r.rank DESC, i, rule_index) AS n FROM hit h JOIN {R.RANK_SQL} ON r.severity = h.severity),
  told AS (SELECT w.*, coalesce(rk.n, 1) AS n, coalesce(rk.rule_id, 'none') AS group_id, coalesce(CASE rk.severity WHEN 'critical' THEN 'high' ELSE rk.severity END, 'low') AS severity, rk.i
    FROM warned w LEFT JOIN ranked rk ON rk.contract_id = w.contract_id WHERE error IS NULL)
  SELECT contract_id, language, 'analyzed' AS state, error, array_to_string(warnings, ',') AS warnings, {_by_language(R.ANALYZED, 'language')} || coalesce(' ' || {_notices('warnings')}, '') AS summary,
    'risk-' || n AS risk_id, group_id, severity, coalesce('clause-' || i, {_by_language(R.UNKNOWN_CLAUSE, 'language')}) AS clause_ref, 1::BIGINT AS occurrences, ti.words AS title, no.words AS description, mi.words AS recommendation
  FROM told JOIN {R.words_sql(R.RULE_TITLE)} AS ti(rule, lang, words) ON ti.rule = group_id AND ti.lang = language JOIN {R.words_sql(R.RULE_NOTE)} AS no(rule, lang, words) ON no.rule = group_id AND no.lang = language
    JOIN {R.words_sql(R.MITIGATION)} AS mi(rule, lang, words) ON mi.rule = group_id AND mi.lang = language
  UNION ALL SELECT contract_id, language, 'fallback', error, array_to_string(warnings, ','), {_by_language(R.SAFE_MODE, 'language')} || ' ' || {_notices('list_concat([error], warnings)')},
    'risk-1', 'analysis-safe-mode', 'medium', 'overview', greatest(len(warnings), 1)::BIGINT, {_by_language(R.REVIEW_TITLE, 'language')},
    {_by_language(R.SAFE_MODE, 'language')} || ' ' || {_notices('list_concat([error], warnings)')}, {_by_language(R.REVIEW_ADVICE, 'language')} FROM warned WHERE error IS NOT NULL""")
def q_safe_report(spark, sf):
    rows = safe.safe_report(T.requests(spark, sf), KEY)
    return rows.select(KEY, "language", "state", "error", F.array_join("warnings", ",").alias("warnings"), "summary", F.inline("risks"))


@query(f"""WITH {REQUESTS} SELECT contract_id, error, array_to_string(list_filter(warnings, lambda x: x = 'invalid_utf8'), '') AS warning,
  CASE WHEN error IS NULL THEN md5(CASE WHEN len(list_filter(warnings, lambda x: x = 'empty_text')) > 0 THEN '' ELSE t END) END AS text_md5 FROM warned""")
def q_payload_decode(spark, sf):
    got = payload.request_text(F.col("document_text"), F.col("document_base64"), R.MAX_TEXT_CHARS, R.MAX_BASE64_CHARS)
    out = T.requests(spark, sf).select(KEY, got.alias("g"))
    return out.select(KEY, "g.error", F.coalesce("g.warning", F.lit("")).alias("warning"), F.md5(F.encode("g.text", "utf-8")).alias("text_md5"))


@query(f"WITH {REQUESTS} SELECT contract_id, array_to_string(warnings, ',') AS warnings FROM warned")
def q_extraction_warnings(spark, sf):
    return safe.read_requests(T.requests(spark, sf)).select(KEY, F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {REQUESTS} SELECT contract_id, 'medium' AS severity, len(warnings)::INT AS occurrences, {_notices('warnings')} AS details FROM warned WHERE len(warnings) > 0")
def q_warning_row(spark, sf):
    rows = safe.read_requests(T.requests(spark, sf)).where(F.size("warnings") > 0)
    return rows.select(KEY, F.lit("medium").alias("severity"), F.size("warnings").alias("occurrences"), safe.warning_text(F.col("warnings"), F.col("language")).alias("details"))
