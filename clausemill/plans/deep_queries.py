"""The deep analysis over the deep corpus, with SQL that works its steps out from the line items."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import deep as D
from ..functions import shape as S
from ..functions import text as X
from ..operators import deep as O
from ..operators.scoring import context_scores
from ..sources import deep_pack as P
from ..sources import tables as T
from ..sources.packs import STARTER
from ..sources.shared import written
from .registry import query

KEYS = ("contract_id", "clause_index", "fragment_index")
UP = S.UPPER


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def hits(text: str, words: str) -> str:
    return f"len(list_filter({words}, lambda w: contains({text}, w)))"


def places(text: str, words: str) -> str:
    """Start offsets of all words, from the lengths of the parts between them."""
    parts = f"string_split({text}, w)"
    return (f"list_sort(flatten(list_transform({words}, lambda w: list_transform(range(1, len({parts})), "
            f"lambda i: (list_sum(list_transform(list_slice({parts}, 1, i), lambda x: length(x))) + (i - 1) * length(w))::INT))))")


def near(a: str, b: str, cond: str) -> str:
    return f"len(list_filter({a}, lambda p: len(list_filter({b}, lambda q: {cond})) > 0))"


def norm(c: str) -> str:
    """The search form of this corpus' text: it has no damage to repair."""
    return rf"lower(translate(trim(regexp_replace({tidy(c)}, '\s+', ' ', 'g')), 'йё', 'ие'))"


def tidy(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '[ \t]*\n[ \t]*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10))"


LABEL = "(?:(?:clause|section|article|пункт|раздел)\\s+)?"
NO0, NO1 = LABEL + r"\d+(?:\.\d+){0,5}[.)]?", LABEL + r"\d+(?:\.\d+){1,5}[.)]?"
STEPS = (
    (rf"([{UP}\s]{{6,}})([{UP}][a-z]{{2,}}\s+(?:обязан|обязуется|вправе|должен|shall|must|undertakes|may)(?:[^0-9A-Za-z_]|$))", r"\1\n\2"),
    (r"(?i)(обязан|обязуется|должен|вправе|shall|must|undertakes|may):\s*([0-9A-Za-zА-Яа-я])", r"\1:\n\2"),
    (rf"([:.;])(\d+(?:\.\d+){{1,5}}[.)]?[\s{UP}])", r"\1\n\2"),
    (rf"(?i)({NO1})([{UP}])", r"\1\n\2"),
    (rf"([.!?])\s+([{UP}])", r"\1\n\2"),
    (rf"([.!?])\s+({NO0})(\s+[{UP}])", r"\1\n\2\3"),
    (rf"\s+({NO0})(\s+[{UP}])", r"\n\1\2"),
)


def broken(c: str) -> str:
    for pattern, by in STEPS:
        # DuckDB takes no escape for a newline in the replacement
        parts = "' || chr(10) || '".join(by.split(r"\n"))
        c = f"regexp_replace({c}, {lit(pattern)}, '{parts}', 'g')"
    return c


def lead(c: str) -> str:
    for p in (r"^\s*[\x{2022}*-]+\s*", r"(?i)^\s*\(?[a-zа-яё]\)\s*", r"(?i)^\s*(?:clause|section|article|пункт|раздел)\s+\d+(?:\.\d+){0,5}[.)]?\s*", r"^\s*\d+(?:\.\d+){0,5}[.)]?\s*"):
        c = f"regexp_replace({c}, {lit(p)}, '')"
    return f"trim({c})"


BOUNDS = (rf"[.!?]{NO0}\s*[{UP}]", rf"[.!?]\s+{NO0}\s+[{UP}]", rf"\s+{NO0}\s+[{UP}]")


def boundary(c: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({c}, {lit(p)}) THEN length(regexp_extract({c}, {lit('(?s)^(.*?)' + p)}, 1)) + 1" for p in BOUNDS)
    return f"(CASE {whens} ELSE -1 END)"


def loose(c: str) -> str:
    bare = rf"rtrim(regexp_replace(regexp_replace(rtrim({c}), '[.!?]\d+(?:[.,]\d+){{0,5}}[.)]?\s*$', ''), '\s+\d+(?:[.,]\d+){{0,5}}[.)]?\s*$', ''))"
    return rf"(CASE WHEN regexp_matches({c}, '(?i)(?:clause|section|article|пункт|раздел)\s+\d+(?:\.\d+){{0,5}}[.)]?\s*$') THEN rtrim({c}) ELSE {bare} END)"


def headed(c: str) -> str:
    letters, upper = f"len(regexp_extract_all({c}, '[{X.LETTER}]'))", f"len(regexp_extract_all({c}, '[{UP}]'))"
    return f"({c} = '' OR {c} LIKE '%:' OR ({letters} > 0 AND {upper} > {letters} * 0.72))"


CLAUSES = f"""dclauses AS (
  SELECT contract_id, (row_number() OVER (PARTITION BY contract_id ORDER BY ln, pk, sk) - 1)::INT AS clause_index, ln::VARCHAR AS clause_ref, clause_text, {norm('clause_text')} AS clause_norm
  FROM ({T.DEEP_CLAUSE_SQL})
), droles AS (
  SELECT o_orderkey AS contract_id, CASE o_custkey % 5 WHEN 0 THEN 'buyer' WHEN 1 THEN 'seller' WHEN 2 THEN 'supplier' WHEN 3 THEN 'contractor' ELSE 'исполнитель' END AS r FROM orders
), dforms AS (
  SELECT contract_id, CASE WHEN r LIKE '%тель' THEN list_transform(['', 'я', 'ю', 'ем', 'е'], lambda e: CASE WHEN e = '' THEN r ELSE substr(r, 1, length(r) - 1) || e END) ELSE [r] END AS roles FROM droles
)"""
FRAGS = f"""{CLAUSES}, dparts AS (
  SELECT contract_id, clause_index, clause_ref, clause_norm, list_filter(list_transform(regexp_split_to_array({broken(tidy('clause_text'))}, '\\n+|[;•]+'), lambda x: {tidy('x')}), lambda x: x <> '') AS parts FROM dclauses
), dfrag0 AS (
  SELECT contract_id, clause_index, clause_ref, clause_norm, unnest(parts) AS fragment, (generate_subscripts(parts, 1) - 1)::INT AS fragment_index FROM dparts
), dfrag1 AS (
  SELECT *, {norm('fragment')} AS norm, {lead('fragment')} AS l FROM dfrag0
), dfrag2 AS (
  SELECT *, {boundary('l')} AS b FROM dfrag1
), dfrag3 AS (
  SELECT *, {loose("(CASE WHEN b >= 0 THEN trim(substr(l, 1, b)) ELSE l END)")} AS body FROM dfrag2
), dfrags AS MATERIALIZED (
  SELECT d.* EXCLUDE (l, b, body), CASE WHEN {headed('body')} THEN '' ELSE body END AS excerpt, f.roles FROM dfrag3 d JOIN dforms f ON f.contract_id = d.contract_id
)"""
ACTS = items(P.SIGNALS["role_action"])
DUTY = "(?:обязан(?:а|ы)?|обязуется|должен(?:а|ы)?|shall|must|undertakes)"
OPEN_BEFORE = r"(?i)(?:[.;:!?,]\s*|[-–—*]\s*|\d+(?:\.\d+)*[.)]?\s*|(?:clause|section|article|пункт|раздел)\s+\d+(?:\.\d+)*[.)]?\s*)$"


def acting(text: str) -> str:
    before = f"substr({text}, greatest(p - 20, 0) + 1, p - greatest(p - 20, 0))"
    acts = f"len(list_filter({places(text, ACTS)}, lambda q: q >= p AND q - p <= 96)) > 0"
    return f"(len(list_filter({places(text, 'roles')}, lambda p: p <= 72 AND (p = 0 OR regexp_matches({before}, {lit(OPEN_BEFORE)})) AND {acts})) > 0)"


REFERENCE = "(" + hits("norm", items(P.SIGNALS["reference_neutral"])) + " > 0 AND (" + " OR ".join(f"starts_with(norm, {lit(s)})" for s in P.REFERENCE_STARTS) + " OR " + " OR ".join(f"contains(norm, {lit(s)})" for s in P.REFERENCE_PARTS) + "))"
LISTED = "(regexp_matches(fragment, '(?i)^(?:\\(?[a-zа-яё]\\)|\\d+(?:\\.\\d+)*[.)]|[-–—*])\\s*') OR " + hits("norm", items(P.SIGNALS["obligations"])) + " > 0)"
FOREIGN = rf"(NOT subject AND regexp_matches(fragment, '(?i)^\s*(?:\d+(?:\.\d+)*[.)]?\s*)?(?:[A-Za-zА-ЯЁ][A-Za-zА-Яа-яЁё-]{{2,}}(?:\s+[A-Za-zА-Яа-яЁё-]{{2,}}){{0,2}})\s+{DUTY}(?:[^0-9A-Za-z_]|$)'))"
LEADS = rf"(subject AND {hits('norm', items(P.SIGNALS['obligations']))} > 0 AND ld <> '' AND length(ld) <= 88 AND len(regexp_split_to_array(ld, '\s+')) <= 10 AND (regexp_matches(fragment, ':\s*$') OR {hits('norm', items(P.SIGNALS['carry_lead']))} > 0))"
WHO = f"""{FRAGS}, dwho0 AS (
  SELECT *, {hits('norm', 'roles')} AS f_role, {acting('norm')} AS subject, trim(regexp_replace({lead('fragment')}, ':\\s*$', '')) AS ld FROM dfrags
), dwho AS MATERIALIZED (
  SELECT *, {FOREIGN} AS foreign_lead, {LEADS} AND f_role > 0 AS leads, {LISTED} AS listed FROM dwho0
)"""


def _forms(role: str) -> list[str]:
    """Case forms of a one-word role, by the first ending that fits."""
    for ending, cases in P.ROLE_ENDINGS:
        if role.endswith(ending):
            return [role, *(role[: -len(ending)] + c for c in cases)]
    return [role]


OTHERS = f"list_filter({items(dict.fromkeys(f for p in P.PARTIES for f in _forms(p) if len(f) >= 5))}, lambda t: NOT list_contains(roles, t))"


def _has(a: str, b: str, within: int) -> str:
    return near(places("norm", a), places("norm", b), f"abs(p - q) <= {within}") + " > 0"


def _before(a: str, b: str, within: int) -> str:
    return near(places("norm", a), places("norm", b), f"p <= q AND q - p <= {within}") + " > 0"


_EX, _SUB = hits("norm", items(P.RECOVERY_EXCLUDED)) + " > 0", items(P.RECOVERY_SUBJECT)
_PAY, _FINE = items(P.BURDEN["liability"]), items(P.BURDEN["penalties"])
BURDEN = f"""(CASE WHEN len(roles) = 0 OR {hits('norm', 'others')} = 0 THEN false
  WHEN rule_id = 'liability' THEN NOT ({_before('roles', _PAY, 112)} OR ({_EX} AND {_has('roles', _SUB, 88)})) AND NOT {_has('others', items(P.BENEFIT['liability']), 96)}
    AND ({_before('others', _PAY, 112)} OR ({_EX} AND {_has('others', _SUB, 88)}))
  WHEN rule_id = 'penalties' THEN NOT {_before('roles', _FINE, 112)} AND NOT {_has('others', items(P.BENEFIT['penalties']), 96)} AND {_before('others', _FINE, 112)}
  ELSE false END)"""


def _good(kind: str) -> str:
    return f"burden OR ({hits('norm', items(P.GENERIC_BENEFIT[kind]))} > 0 AND {hits('norm', 'others')} = 0) OR (f_role > 0 AND {_has('roles', items(P.BENEFIT[kind]), 96)})"


GOOD = f"(CASE rule_id WHEN 'liability' THEN {_good('liability')} WHEN 'penalties' THEN {_good('penalties')} WHEN 'unilateral' THEN f_role > 0 AND {_before('roles', items(P.BENEFIT['unilateral']), 72)} ELSE false END)"
OUT = (f"(rule_id = 'acceptance' AND (regexp_matches({lead('fragment')}, '(?i)^(?:acceptance acts?\\s*$|акты?\\s+приемки|акты?\\s+сдачи[-\\s]приемки)') OR {headed('fragment')}"
       f" OR {hits('norm', items(P.SIGNALS['acceptance_negative']))} >= 2 OR ({hits('clause_norm', items(P.SIGNALS['acceptance_clarity']))} >= 2 AND {hits('norm', items(P.SIGNALS['acceptance_clarity']))} = 0)))")


def _rules_sql(rows) -> str:
    return "(VALUES " + ", ".join(f"({lit(r)}, {i}, {lit(s)}, {items(k)})" for r, i, s, k in rows) + ") AS k(rule_id, rule_index, severity, keywords)"


RISK_SQL = _rules_sql([(r, i, s, k) for i, (r, s, k, *_) in enumerate(P.RULES)])
DISPUTE_SQL = _rules_sql([(r, i, "", k) for i, (r, k, *_) in enumerate(P.DISPUTES)])
NUM = r"regexp_matches(excerpt, '(?:^|[^0-9A-Za-z_])\d+(?:[.,]\d+)?(?:$|[^0-9A-Za-z_])')"


def money(c: str) -> str:
    return rf"regexp_matches({c}, '(?i)(?:^|[^0-9A-Za-z_])\d[\d\s.,]*\s*(?:(?:{S.UNITS})(?:$|[^0-9A-Za-z_])|(?:{S.SIGNS})[0-9A-Za-z_])')"


def matches(name: str, rules: str) -> str:
    return rf"""{name}0 AS (
  SELECT w.*, k.*, {hits('norm', 'k.keywords')} AS marker_hits, {OTHERS} AS others FROM dwho w JOIN {rules} ON {hits('norm', 'k.keywords')} > 0 WHERE excerpt <> '' AND NOT {REFERENCE}
), {name}1 AS (
  SELECT * REPLACE (coalesce(nullif(regexp_extract(fragment, '^\s*(\d+(?:\.\d+){{0,5}})[.)]?(?:\s|$)', 1), ''), nullif(regexp_extract(fragment, '(?i)^\s*(?:clause|section|article|пункт|раздел)\s+(\d+(?:\.\d+){{0,5}})', 1), ''), clause_ref) AS clause_ref),
    {BURDEN} AS burden, {OUT} AS excluded FROM {name}0
)"""


MATCHES = f"{WHO}, {matches('rm', RISK_SQL)}, rmatch AS MATERIALIZED (SELECT *, {GOOD} AS good FROM rm1), cand AS (SELECT *, marker_hits * 4 AS lexical FROM rmatch WHERE NOT excluded AND NOT good)"
DMATCHES = f"{WHO}, {matches('dm', DISPUTE_SQL)}, cand AS (SELECT *, marker_hits * 4 AS lexical FROM dm1)"


def _case(rules, text: str, at: int) -> str:
    """The score or condition of each rule, signals spelt out over the given text."""
    side = "f" if text == "norm" else "c"
    names = {n: hits(text, items(w)) for n, w in P.SIGNALS.items()} | {"role": f"{side}_role", "subject": f"{side}_subject"}
    put = lambda e: re.sub(r"[a-z_]+", lambda m: names.get(m[0], m[0]), e)
    return "(CASE rule_id " + " ".join(f"WHEN {lit(r[0])} THEN {put(r[at])}" for r in rules) + " END)"


def scored(rules, with_role: bool) -> str:
    """Continues cand with scores, totals and who passes."""
    kw = places("norm", "keywords")
    prox = near("kw", places("norm", ACTS), "abs(p - q) <= 96")
    if with_role:
        prox += " + 2 * " + near(places("norm", "roles"), "kw", "abs(p - q) <= 88")
    focus = "(CASE WHEN length(excerpt) < 48 THEN -1 WHEN length(excerpt) <= 180 THEN 2 WHEN length(excerpt) <= 260 THEN 1 ELSE 0 END)"
    return f"""sc0 AS (
  SELECT *, subject AS f_subject, {hits('clause_norm', 'roles')} AS c_role, {acting('clause_norm')} AS c_subject, {NUM} AS num, {money('excerpt')} AS mon, {money('norm')} AS norm_mon, {kw} AS kw FROM cand
), sc1 AS MATERIALIZED (
  SELECT *, {_case(rules, 'norm', -2)}::INT AS f_score, {_case(rules, 'clause_norm', -2)}::INT AS c_score, ({prox})::INT AS prox FROM sc0
), sc2 AS (
  SELECT *, (f_score + trunc(c_score / 2.0)::INT + prox + {focus})::INT AS contextual FROM sc1
), sc3 AS (
  SELECT *, (lexical + contextual)::INT AS total FROM sc2
), sc AS MATERIALIZED (
  SELECT *, coalesce({_case(rules, 'norm', -1)}, false) AS passed FROM sc3
)"""


RISK_SCORES, DISPUTE_SCORES = f"{MATCHES}, {scored(P.RULES, True)}", f"{DMATCHES}, {scored(P.DISPUTES, False)}"
SORT = "total DESC, contextual DESC, marker_hits DESC, clause_index, fragment_index, rule_index"
KEPT = f"""{RISK_SCORES}, k0 AS (
  SELECT *, row_number() OVER (PARTITION BY contract_id, rule_id, clause_ref, excerpt ORDER BY {SORT}) AS one, f_role = 0 OR f_subject AS directed FROM sc WHERE passed
), k1 AS (
  SELECT *, bool_or(directed) OVER (PARTITION BY contract_id, rule_id) AS any_led FROM k0 WHERE one = 1
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY {SORT})::INT AS n FROM k1 WHERE directed OR NOT any_led
)"""
ITEMS = f"""{KEPT}, it0 AS (
  SELECT contract_id, rule_id, any_value(severity) AS base, count(*)::BIGINT AS occurrences, min(n) AS first, list(clause_ref ORDER BY n) AS refs, list(excerpt ORDER BY n) AS excerpts FROM kept GROUP BY 1, 2
), it1 AS (
  SELECT *, CASE WHEN occurrences >= 2 AND base = 'low' THEN 'medium' WHEN occurrences >= 2 AND base = 'medium' THEN 'high' ELSE base END AS severity FROM it0
), risk_items AS (
  SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, occurrences DESC, first)::INT AS risk_no FROM it1
)"""


def _contracts(spark, sf):
    return T.deep_contracts(spark, sf)


def _each(spark, sf, made, *columns):
    """made(fragments) of distinct clauses at all their places: keys and columns."""
    return O.by_clause(_contracts(spark, sf), made, "fragment_index", *columns).select(*KEYS, *columns)


def _flag(spark, sf, name, value):
    return _each(spark, sf, lambda f: f.withColumn(name, value), name)


def _risk_matches(f):
    return O.risk_matches(O.with_signals(f))


def _risk_candidates(f):
    return O.risk_candidates(O.with_signals(f))


def _dispute_candidates(f):
    return O.dispute_candidates(O.with_signals(f))


def _risks(f):
    return O.reranked(_risk_candidates(f), "rules")


def _disputes(f):
    return O.reranked(_dispute_candidates(f), "disputes")


def _carried(f):
    return O.carried(O.with_signals(f))


def _ranked(spark, sf, made):
    """Candidates of distinct clauses at their places, with what ranking needs."""
    return O.by_clause(_contracts(spark, sf), made, *O.RANKED)


def _passed(made):
    return lambda f: made(f).where("passed")


@query(f"WITH {FRAGS} SELECT contract_id, clause_index, fragment_index, fragment FROM dfrags")
def q_fragments(spark, sf):
    return _each(spark, sf, lambda f: f, "fragment")


@query(f"WITH {FRAGS} SELECT contract_id, clause_index, fragment_index, excerpt FROM dfrags")
def q_excerpt(spark, sf):
    return _each(spark, sf, lambda f: f, "excerpt")


@query(f"""WITH {FRAGS}, e AS (SELECT *, {norm('excerpt')} AS k FROM dfrags WHERE excerpt <> ''), u AS (
  SELECT contract_id, k, min(clause_index * 1000 + fragment_index) AS pos, arg_min(excerpt, clause_index * 1000 + fragment_index) AS line FROM e GROUP BY 1, 2)
  SELECT contract_id, row_number() OVER (PARTITION BY contract_id ORDER BY pos)::INT AS n, line FROM u""")
def q_candidate_excerpts(spark, sf):
    return O.candidate_excerpts(_contracts(spark, sf))


@query(f"WITH {CLAUSES} SELECT contract_id, clause_index, {boundary('clause_text')}::INT AS boundary FROM dclauses")
def q_embedded_boundary(spark, sf):
    clauses = _clause_rows(spark, sf)
    return clauses.select("contract_id", "clause_index", D.embedded_boundary(F.col("clause_text")).alias("boundary"))


def _clause_rows(spark, sf):
    from ..operators import segmentation

    docs = _contracts(spark, sf).select("contract_id", "role", X.normalize_text(F.col("document_text")).alias("document_text"))
    return segmentation.clauses_numbered(docs)


@query(f"WITH {FRAGS} SELECT contract_id, clause_index, fragment_index, regexp_replace(excerpt, ':\\s*\\d+(?:[.,]\\d+)*[.)]?\\s*$', '') AS item FROM dfrags")
def q_summary_item(spark, sf):
    return _flag(spark, sf, "item", D.summary_item(F.col("fragment")))


@query(f"WITH {FRAGS} SELECT contract_id, clause_index, fragment_index, {REFERENCE} AS reference FROM dfrags")
def q_reference_like(spark, sf):
    return _flag(spark, sf, "reference", D.reference_like(F.col("norm")))


@query(f"WITH {FRAGS} SELECT contract_id, clause_index, fragment_index, {LISTED} AS listed FROM dfrags")
def q_continuation_like(spark, sf):
    return _flag(spark, sf, "listed", D.continuation_like(F.col("fragment"), F.col("norm")))


@query(f"WITH {CLAUSES} SELECT f.contract_id, array_to_string(roles, ',') AS roles FROM dforms f WHERE f.contract_id IN (SELECT contract_id FROM dclauses)")
def q_role_forms(spark, sf):
    return _contracts(spark, sf).select("contract_id", F.array_join(D.role_forms(F.col("role")), ",").alias("roles"))


@query(f"WITH {CLAUSES} SELECT f.contract_id, array_to_string(list_sort({OTHERS}), ',') AS others FROM dforms f WHERE f.contract_id IN (SELECT contract_id FROM dclauses)")
def q_counterparty_terms(spark, sf):
    others = D.counterparty_terms(D.role_forms(F.col("role")))
    return _contracts(spark, sf).select("contract_id", F.array_join(F.array_sort(others), ",").alias("others"))


@query(f"WITH {WHO} SELECT contract_id, clause_index, fragment_index, subject FROM dwho")
def q_role_action_lead(spark, sf):
    return _flag(spark, sf, "subject", D.role_action_lead(F.col("norm"), F.col("roles")))


@query(f"WITH {WHO} SELECT contract_id, clause_index, fragment_index, leads FROM dwho")
def q_role_lead_fragment(spark, sf):
    return _flag(spark, sf, "leads", D.role_lead_fragment(F.col("fragment"), F.col("norm"), F.col("roles")))


@query(f"WITH {WHO} SELECT contract_id, clause_index, fragment_index, foreign_lead FROM dwho")
def q_foreign_role_lead(spark, sf):
    return _flag(spark, sf, "foreign_lead", D.foreign_role_lead(F.col("fragment"), F.col("norm"), F.col("roles")))


MATCH_KEYS = "contract_id, clause_index, fragment_index, rule_id"


@query(f"WITH {MATCHES} SELECT {MATCH_KEYS}, burden FROM rmatch")
def q_counterparty_burden(spark, sf):
    return _each(spark, sf, _risk_matches, "rule_id", "burden")


@query(f"WITH {MATCHES} SELECT {MATCH_KEYS} FROM rmatch WHERE NOT good")
def q_beneficial_antijoin(spark, sf):
    return _each(spark, sf, lambda f: _risk_matches(f).where(~F.col("beneficial")), "rule_id")


@query(f"WITH {MATCHES} SELECT {MATCH_KEYS}, excluded FROM rmatch WHERE rule_id = 'acceptance'")
def q_acceptance_exclusions(spark, sf):
    return _each(spark, sf, lambda f: _risk_matches(f).where("rule_id = 'acceptance'"), "rule_id", "excluded")


@query(f"WITH {MATCHES} SELECT {MATCH_KEYS}, clause_ref, marker_hits::INT AS marker_hits, lexical::INT AS lexical FROM cand")
def q_risk_candidates(spark, sf):
    return _each(spark, sf, _risk_candidates, "rule_id", "clause_ref", "marker_hits", "lexical")


@query(f"WITH {RISK_SCORES} SELECT {MATCH_KEYS}, f_score, c_score FROM sc")
def q_risk_context_score(spark, sf):
    return _each(spark, sf, lambda f: context_scores(_risk_candidates(f), STARTER, "rules"), "rule_id", "f_score", "c_score")


@query(f"WITH {RISK_SCORES} SELECT {MATCH_KEYS}, contextual, total FROM sc")
def q_risk_rerank(spark, sf):
    return _each(spark, sf, _risks, "rule_id", "contextual", "total")


@query(f"WITH {RISK_SCORES} SELECT {MATCH_KEYS}, passed FROM sc")
def q_risk_threshold(spark, sf):
    return _each(spark, sf, _risks, "rule_id", "passed")


@query(f"WITH {RISK_SCORES} SELECT {MATCH_KEYS}, row_number() OVER (PARTITION BY contract_id ORDER BY {SORT})::INT AS n FROM sc")
def q_candidate_order(spark, sf):
    from pyspark.sql import Window as W

    return _ranked(spark, sf, _risks).select(*KEYS, "rule_id", F.row_number().over(W.partitionBy("contract_id").orderBy(*O.ranking())).alias("n"))


@query(f"WITH {KEPT} SELECT {MATCH_KEYS}, n FROM kept")
def q_direction_filter(spark, sf):
    return O.risk_matches_kept(_ranked(spark, sf, _passed(_risks))).select(*KEYS, "rule_id", "n")


@query(f"WITH {DMATCHES} SELECT {MATCH_KEYS}, clause_ref, marker_hits::INT AS marker_hits FROM cand")
def q_dispute_candidates(spark, sf):
    return _each(spark, sf, _dispute_candidates, "rule_id", "clause_ref", "marker_hits")


@query(f"WITH {DISPUTE_SCORES} SELECT {MATCH_KEYS}, f_score, c_score FROM sc")
def q_dispute_context_score(spark, sf):
    return _each(spark, sf, lambda f: context_scores(_dispute_candidates(f), STARTER, "disputes"), "rule_id", "f_score", "c_score")


@query(f"WITH {DISPUTE_SCORES} SELECT {MATCH_KEYS}, contextual, total FROM sc")
def q_dispute_rerank(spark, sf):
    return _each(spark, sf, _disputes, "rule_id", "contextual", "total")


@query(f"WITH {DISPUTE_SCORES} SELECT {MATCH_KEYS}, passed FROM sc")
def q_dispute_threshold(spark, sf):
    return _each(spark, sf, _disputes, "rule_id", "passed")


@query(f"""WITH {DISPUTE_SCORES}, b AS (SELECT *, row_number() OVER (PARTITION BY contract_id, clause_ref, excerpt ORDER BY {SORT}) AS one FROM sc WHERE passed)
  SELECT contract_id, row_number() OVER (PARTITION BY contract_id ORDER BY {SORT})::INT AS n, clause_ref, excerpt, rule_id FROM b WHERE one = 1""")
def q_dispute_best(spark, sf):
    return O.dispute_items(_ranked(spark, sf, _passed(_disputes)))


CARRIED = f"""{WHO}, ev AS (
  SELECT *, CASE WHEN leads THEN true WHEN foreign_lead OR (f_role > 0 AND NOT subject) OR NOT listed THEN false END AS event FROM dwho
), carried AS MATERIALIZED (
  SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY contract_id, clause_index ORDER BY fragment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS carry FROM ev
)"""
_EXCL, _OBL, _DUE = (hits("norm", items(P.SIGNALS[n])) for n in ("exclude", "obligations", "deadlines"))
_PAYS = hits("norm", items(P.SIGNALS["payment"]))
DUTIES = f"""{CARRIED}, du0 AS (
  SELECT *, carry AND NOT foreign_lead AND f_role = 0 AND {_EXCL} = 0 AND listed AS goes_on FROM carried
), du1 AS (
  SELECT *, CASE WHEN f_role > 0 AND subject THEN f_role ELSE goes_on::INT END AS own FROM du0
), duties AS (
  SELECT *, (own * 6 + {_OBL} * 4 + ({_PAYS} + {_DUE}) * 2 + goes_on::INT * 2)::INT AS score FROM du1
  WHERE own > 0 AND {_OBL} + {_PAYS} + {_DUE} + goes_on::INT > 0 AND {_EXCL} = 0 AND excerpt <> ''
)"""
BLOCKS = f"""{DUTIES}, bl0 AS (
  SELECT *, subject AND regexp_matches(fragment, '(?i){DUTY}\\s*:\\s*$') AS opening FROM carried
), bl1 AS (
  SELECT *, sum(opening::INT) OVER (PARTITION BY contract_id ORDER BY clause_index, fragment_index ROWS UNBOUNDED PRECEDING) AS block FROM bl0
), bl2 AS (
  SELECT *, NOT opening AND (foreign_lead OR clause_index > min(clause_index) OVER (PARTITION BY contract_id, block)) AS stops FROM bl1
), bl3 AS (
  SELECT *, bool_or(stops) OVER (PARTITION BY contract_id, block ORDER BY clause_index, fragment_index ROWS UNBOUNDED PRECEDING) AS stopped FROM bl2
), blocks AS (
  SELECT * FROM bl3 WHERE block > 0 AND NOT opening AND NOT stopped AND excerpt <> '' AND {_EXCL} = 0 AND ({_OBL} > 0 OR {_PAYS} > 0 OR listed)
)"""
MERGED = f"""{BLOCKS}, own_items AS (
  SELECT contract_id, list_slice(list({{'x': excerpt, 'o': subject}} ORDER BY score DESC, clause_index, fragment_index), 1, 12) AS own FROM duties GROUP BY 1
), led_items AS (
  SELECT contract_id, list_slice(list(excerpt ORDER BY clause_index, fragment_index), 1, 40) AS led FROM blocks GROUP BY 1
), merged0 AS (
  SELECT coalesce(a.contract_id, b.contract_id) AS contract_id, CASE WHEN len(led) > 0 THEN list_concat(led, list_transform(list_filter(coalesce(own, []), lambda x: x.o), lambda x: x.x)) ELSE list_transform(own, lambda x: x.x) END AS xs
  FROM own_items a FULL JOIN led_items b ON a.contract_id = b.contract_id
), merged AS (
  SELECT contract_id, list_slice(list_filter(xs, lambda x, i: list_position(xs, x) = i), 1, 12) AS items FROM merged0
)"""


@query(f"WITH {CARRIED} SELECT contract_id, clause_index, fragment_index, carry FROM carried")
def q_carry_role(spark, sf):
    return _each(spark, sf, _carried, "carry")


@query(f"WITH {DUTIES} SELECT contract_id, clause_index, fragment_index, score, excerpt AS item FROM duties")
def q_role_obligations(spark, sf):
    return _each(spark, sf, lambda f: O.role_obligations(_carried(f)).withColumn("score", F.col("score").cast("int")), "score", "item")


@query(f"WITH {BLOCKS} SELECT contract_id, clause_index, fragment_index, block::BIGINT AS block, excerpt AS item FROM blocks")
def q_role_led_blocks(spark, sf):
    return O.role_led_blocks(O.by_clause(_contracts(spark, sf), _carried, *O.BLOCKED)).select(*KEYS, "block", "item")


@query(f"WITH {MERGED} SELECT contract_id, array_to_string(items, '|') AS items FROM merged")
def q_merge_obligations(spark, sf):
    places, frags = O.clause_units(_contracts(spark, sf))
    rows = written(_carried(frags), "carried")
    led, own = O.role_led_blocks(O.at_places(places, rows, *O.BLOCKED)), O.at_places(places, O.role_obligations(rows), *O.OWED)
    return O.merged_obligations(led, own).select("contract_id", F.array_join("items", "|").alias("items"))


@query(f"""WITH {ITEMS}, found AS (SELECT d.contract_id, bool_or({hits('d.clause_norm', 'f.roles')} > 0) AS ok FROM dclauses d JOIN dforms f ON f.contract_id = d.contract_id GROUP BY 1),
  told AS (SELECT contract_id, string_agg(risk_no || ':' || rule_id || ':' || severity || ':' || occurrences, '|' ORDER BY risk_no) AS risks FROM risk_items GROUP BY 1)
  SELECT f.contract_id, f.ok AS role_found, CASE WHEN f.ok THEN '' ELSE '0:role-missing:medium:1|' END || coalesce(t.risks, '1:low-signal:low:1') AS risks FROM found f LEFT JOIN told t ON t.contract_id = f.contract_id""")
def q_deep_digest(spark, sf):
    risks = F.array_join(F.transform("risks", lambda r: F.concat_ws(":", r["risk_no"].cast("string"), r["rule_id"], r["severity"], r["occurrences"].cast("string"))), "|")
    return O.deep_report(_contracts(spark, sf), parts=("risks",)).select("contract_id", "role_found", risks.alias("risks"))


def _first_of_equal(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


_TOLD = f"""found AS (SELECT d.contract_id, bool_or({hits('d.clause_norm', 'f.roles')} > 0) AS ok FROM dclauses d JOIN dforms f ON f.contract_id = d.contract_id GROUP BY 1), rows AS (
  SELECT contract_id, risk_no, rule_id, severity, occurrences, array_to_string({_first_of_equal('refs')}, '|') AS clause_refs, array_to_string(list_slice(excerpts, 1, 6), '|') AS evidence FROM risk_items
  UNION ALL SELECT contract_id, 0, 'role-missing', 'medium', 1, 'overview', '' FROM found WHERE NOT ok
  UNION ALL SELECT contract_id, 1, 'low-signal', 'low', 1, 'overview', '' FROM found WHERE contract_id NOT IN (SELECT contract_id FROM risk_items)
)"""


@query(f"""WITH {ITEMS}{MERGED[len(WHO):]}, {_TOLD}
  SELECT f.contract_id, f.ok AS role_found, coalesce(array_to_string(m.items, '|'), '') AS duties, r.risk_no, r.rule_id, r.severity, r.occurrences::BIGINT AS occurrences, r.clause_refs, r.evidence
  FROM found f JOIN rows r ON r.contract_id = f.contract_id LEFT JOIN merged m ON m.contract_id = f.contract_id""")
def q_deep_report(spark, sf):
    """Reports with a row for each risk; disputes are those of dispute_best."""
    out = O.deep_report(_contracts(spark, sf), parts=("risks", "duties")).select("contract_id", "role_found", F.array_join("duties", "|").alias("duties"), F.inline("risks"))
    return out.withColumns({"clause_refs": F.array_join("clause_refs", "|"), "evidence": F.array_join("evidence", "|")})


@query(f"WITH {ITEMS} SELECT contract_id, rule_id, occurrences, array_to_string({_first_of_equal('refs')}, '|') AS refs, array_to_string(list_slice(excerpts, 1, 6), '|') AS evidence FROM risk_items")
def q_occurrence_rollup(spark, sf):
    """Occurrences of each rule, the clauses they are in and the first excerpts as evidence."""
    items_ = O.risk_items(O.risk_matches_kept(_ranked(spark, sf, _passed(_risks))))
    return items_.select("contract_id", "rule_id", "occurrences", F.array_join("clause_refs", "|").alias("refs"), F.array_join("evidence", "|").alias("evidence"))


@query(f"WITH {KEPT} SELECT contract_id, rule_id, row_number() OVER (PARTITION BY contract_id, rule_id ORDER BY n)::INT AS place, clause_ref, excerpt FROM kept")
def q_risk_group(spark, sf):
    """The matches of each rule in order, one of those that are equal in clause and excerpt."""
    kept = O.risk_matches_kept(_ranked(spark, sf, _passed(_risks)))
    rows = kept.groupBy("contract_id", "rule_id").agg(F.array_sort(F.collect_list(F.struct("n", "clause_ref", "excerpt"))).alias("x"))
    return rows.select("contract_id", "rule_id", F.posexplode("x").alias("place", "r")).select("contract_id", "rule_id", (F.col("place") + 1).alias("place"), "r.clause_ref", "r.excerpt")


@query(f"WITH {WHO} SELECT d.contract_id, bool_or({hits('d.clause_norm', 'f.roles')} > 0) AS found FROM dclauses d JOIN dforms f ON f.contract_id = d.contract_id GROUP BY 1")
def q_role_found(spark, sf):
    """Whether a clause names the role, in any of its words and case forms."""
    return O.role_found(O.by_clause(_contracts(spark, sf), O.role_named, "c_role")).withColumnRenamed("role_found", "found")


_PREVIEW = "regexp_extract(substr(x, 1, 220), '(?s)^(.{79,}[.!?;])', 1)"


@query(r"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN length(x) <= 220 THEN x WHEN """ + _PREVIEW + " <> '' THEN trim(" + _PREVIEW + r""")
    ELSE trim(coalesce(nullif(regexp_extract(substr(x, 1, 218), '(?s)^(.{80,}) ', 1), ''), substr(x, 1, 217))) || '...' END) AS cs FROM d)
  SELECT doc_id, array_to_string(list_slice(list_filter(cs, lambda x, i: list_position(cs, x) = i), 1, 3), chr(10)) AS items FROM c""")
def q_preview_items(spark, sf):
    docs = T.table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(D.preview_items(F.split("text", "\n", -1)), "\n").alias("items"))


_EVIDENCE_TEXT = "CASE doc_id % 3 WHEN 0 THEN text ELSE substr(text, 1, 40) || ' ' || CASE doc_id % 5 WHEN 0 THEN 'Detected in clause 4: ' WHEN 1 THEN 'Found in clause 2. ' ELSE 'обнаружено в пункте 3 ' END || substr(text, 41) END"


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'en' ELSE 'ru' END AS lang, {_EVIDENCE_TEXT} AS t FROM documents WHERE text IS NOT NULL),
  p AS (SELECT *, CASE lang WHEN 'en' THEN coalesce(least(nullif(strpos(lower(t), 'detected in clause'), 0), nullif(strpos(lower(t), 'found in clause'), 0)), 0) ELSE strpos(lower(t), 'обнаружено в пункте') END AS pos FROM d)
  SELECT doc_id, trim(CASE WHEN pos = 0 THEN t ELSE substr(t, 1, pos - 1) END, ' ') AS main_text, CASE WHEN pos = 0 THEN '' ELSE trim(substr(t, pos), ' ') END AS evidence FROM p""")
def q_inline_evidence(spark, sf):
    docs = T.table(spark, sf, "documents").where("text IS NOT NULL").selectExpr("doc_id", "CASE doc_id % 2 WHEN 0 THEN 'en' ELSE 'ru' END AS lang", f"{_EVIDENCE_TEXT} AS t")
    e = docs.select("doc_id", D.inline_evidence(F.col("t"), F.col("lang")).alias("e"))
    return e.select("doc_id", F.col("e.primary").alias("main_text"), F.array_join("e.evidence", "|").alias("evidence"))


_TYPES = ", ".join(f"({i}, {lit(k)}, {items(w)})" for i, (k, w) in enumerate(P.CONTRACT_TYPES.items()))


@query(f"""WITH {CLAUSES}, t AS (SELECT contract_id, string_agg(clause_text, chr(10) || chr(10) ORDER BY clause_index) AS text FROM dclauses GROUP BY 1), h AS (SELECT contract_id, {norm('substr(text, 1, 4000)')} AS head FROM t),
  s AS (SELECT h.contract_id, k.no, k.type, {hits('h.head', 'k.words')} AS n FROM h CROSS JOIN (VALUES {_TYPES}) AS k(no, type, words))
  SELECT contract_id, coalesce(arg_min(type, (-n, no)) FILTER (WHERE n > 0), 'unknown') AS type FROM s GROUP BY 1""")
def q_contract_type(spark, sf):
    from ..operators.report import best_type

    docs = _contracts(spark, sf).select("contract_id", X.search_head(F.col("document_text"), 4000).alias("head"))
    return docs.select("contract_id", best_type(F.col("head"), {k: list(w) for k, w in P.CONTRACT_TYPES.items()}).alias("type"))
