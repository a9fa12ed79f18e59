"""Text normalization and clause shape over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deep, repair
from ..functions import shape as S
from ..functions import text as X
from ..operators import segmentation
from ..sources import tables as T
from .registry import query
from .request_queries import TEXTS_CTE

LETTER = X.LETTER


def rx(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _docs(spark, sf):
    return T.table(spark, sf, "documents")


def ws_sql(c: str) -> str:
    c = f"translate({c}, chr(160) || chr(173), ' ')"
    for p, by in ((r"\r\n?", "chr(10)"), (r"[ \t\f\x0B]+\n", "chr(10)"), (r"\n[ \t\f\x0B]+", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
        c = f"regexp_replace({c}, {rx(p)}, {by}, 'g')"
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
COUNT = "len(regexp_extract_all({}, {}))"


@query(f"SELECT doc_id, regexp_replace(text, {rx(X.CONTROL)}, '', 'g') AS value FROM documents")
def q_strip_control(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip_control(F.col("text")).alias("value"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(translate(text, '±©ª', '-""'), {rx(X.GLYPHS)}, '-', 'g'), '[ \t]*-[ \t]+', ' - ', 'g') AS value FROM documents""")
def q_glyph_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", X.glyph_normalize(F.col("text")).alias("value"))


@query(f"SELECT doc_id, {ws_sql('text')} AS value FROM documents")
def q_whitespace_canon(spark, sf):
    return _docs(spark, sf).select("doc_id", X.whitespace_canon(F.col("text")).alias("value"))


@query(f"SELECT doc_id, {COLLAPSE.format('text')} AS value FROM documents")
def q_collapse_ws(spark, sf):
    return _docs(spark, sf).select("doc_id", X.collapse_ws(F.col("text")).alias("value"))


@query(f"SELECT doc_id, regexp_replace(translate(text, '{X.MARKED}', '{X.PLAIN}'), {rx(X.COMBINING)}, '', 'g') AS value FROM documents")
def q_fold_diacritics(spark, sf):
    return _docs(spark, sf).select("doc_id", X.fold_diacritics(F.col("text")).alias("value"))


@query()
def q_search_text(spark, sf):
    return _docs(spark, sf).select("doc_id", X.search_text(F.col("text")).alias("value"))


@query()
def q_join_spaced_letters(spark, sf):
    spaced = F.regexp_replace(F.substring("text", 1, 200), r"(\p{L})", "$1 ")
    return _docs(spark, sf).select("doc_id", X.join_spaced_letters(F.concat(F.col("text"), F.lit(" 1 "), spaced)).alias("value"))


@query(rf"SELECT doc_id, regexp_replace(replace(text, ' th', '-' || chr(10) || 'th'), '([0-9{LETTER}])[\x{{00AD}}\x{{2010}}\x{{2011}}-][ \t]*\n[ \t]*([0-9{LETTER}])', '\1\2', 'g') AS value FROM documents")
def q_dehyphenate(spark, sf):
    return _docs(spark, sf).select("doc_id", X.dehyphenate(F.replace(F.col("text"), F.lit(" th"), F.lit("-\nth"))).alias("value"))


def _soft_sql(c: str) -> str:
    """Twice, as what a match ends with may begin the next one."""
    for _ in range(2):
        c = rf"regexp_replace({c}, '([0-9{LETTER}])\n([0-9{X.LOWER}][0-9{LETTER}])', '\1 \2', 'g')"
    return c


@query(f"SELECT doc_id, {_soft_sql("replace(text, ' of', chr(10) || 'of')")} AS value FROM documents")
def q_soft_line_break(spark, sf):
    return _docs(spark, sf).select("doc_id", X.soft_line_break(F.replace(F.col("text"), F.lit(" of"), F.lit("\nof"))).alias("value"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(translate({COLLAPSE.format('text')}, '{X.MARKED}', '{X.PLAIN}')), '[^0-9{LETTER}]+'), lambda x: x <> ''))), ' ') AS tokens FROM documents""")
def q_tokenize_unique(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(F.array_sort(X.tokenize_unique(F.col("text"))), " ").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))), chr(10)) AS lines FROM documents")
def q_unique_strings(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(F.array_sort(X.unique_strings(F.split("text", "\n", -1))), "\n").alias("lines"))


@query(f"SELECT doc_id, {COUNT.format('text', rx(repair.MOJIBAKE))}::INT AS score FROM documents")
def q_mojibake_score(spark, sf):
    return _docs(spark, sf).select("doc_id", repair.mojibake_score(F.col("text")).alias("score"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS value FROM pages")
def q_xml_entities(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", X.xml_entities(F.col("html")).alias("value"))


def _html_sql() -> str:
    c = "html"
    for p, by in ((r"(?is)<script\b.*?</script>", "' '"), (r"(?is)<style\b.*?</style>", "' '"), (X.BREAK_TAG, "chr(10)"), ("<[^>]+>", "' '")):
        c = f"regexp_replace({c}, {rx(p)}, {by}, 'g')"
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', {rx(by)})"
    return ws_sql(c)


@query(f"SELECT page_id, {_html_sql()} AS value FROM pages")
def q_html_to_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("value"))


@query()
def q_repeated_noise(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", X.repeated_noise(F.col("html")).alias("n"))


@query()
def q_readability_score(spark, sf):
    return _docs(spark, sf).select("doc_id", X.readability_score(F.col("text")).alias("score"))


@query()
def q_readable_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", X.readable_lines(F.col("text")).alias("value"))


_L, _N = COUNT.format("text", r"'\p{L}'"), COUNT.format("text", r"'\p{N}'")


@query(f"SELECT doc_id, length(text) >= 20 AND {_L} >= 12 AND {COUNT.format('text', rx(X.STRANGE))} <= greatest(6, floor(({_L} + {_N}) * 0.25)) AS ok FROM documents")
def q_likely_text_gate(spark, sf):
    return _docs(spark, sf).select("doc_id", X.likely_text(F.col("text")).alias("ok"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT - 1 AS pos FROM d)
  SELECT doc_id, trim(line) AS line, min(pos)::INT AS pos FROM l GROUP BY doc_id, trim(line)""")
def q_chunk_dedupe(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.groupBy("doc_id", F.trim("line").alias("line")).agg(F.min("pos").alias("pos"))


CLAUSES_CTE = f"""{TEXTS_CTE}, cut AS (
  SELECT * EXCLUDE (document_text), list_filter(list_transform(string_split(replace(document_text, chr(13), ''), chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM filled
), clauses AS MATERIALIZED (
  SELECT * EXCLUDE (parts), unnest(parts) AS clause_text, (generate_subscripts(parts, 1) - 1)::INT AS clause_index FROM cut
)"""


def clauses(spark, sf):
    return segmentation.clauses_simple(segmentation.with_text(T.contracts(spark, sf)))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, 'clause-' || (clause_index + 1) AS clause_id, clause_text FROM clauses")
def q_clauses_simple(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", "clause_id", "clause_text")


@query(rf"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, coalesce(nullif(regexp_extract(clause_text, '^\s*(\d+(?:\.\d+){{0,5}})[.)]?(?:\s|$)', 1), ''), (clause_index + 1)::VARCHAR) AS clause_ref, clause_text FROM clauses")
def q_clauses_numbered(spark, sf):
    out = segmentation.clauses_numbered(segmentation.with_text(T.contracts(spark, sf)))
    return out.select("contract_id", "clause_index", "clause_ref", "clause_text")


@query(rf"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, coalesce(nullif(regexp_extract(clause_text, '^\s*(\d+(?:\.\d+){{0,5}})[.)]?(?:\s|$)', 1), ''), (clause_index + 1)::VARCHAR) AS ref FROM clauses")
def q_clause_ref(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", S.clause_ref(F.col("clause_text"), F.col("clause_index")).alias("ref"))


_LEAD = r"trim(regexp_replace(clause_text, '^\s*\d+(?:\.\d+){0,5}[.)]?\s*', ''))"


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, {_LEAD} AS body FROM clauses")
def q_trim_lead(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", S.trim_lead(F.col("clause_text")).alias("body"))


_UP, _AL = COUNT.format("b", rx(f"[{S.UPPER}]")), COUNT.format("b", rx(f"[{LETTER}]"))


@query(f"WITH {CLAUSES_CTE}, x AS (SELECT contract_id, clause_index, {_LEAD} AS b FROM clauses) SELECT contract_id, clause_index, b = '' OR b LIKE '%:' OR ({_AL} > 0 AND {_UP} > {_AL} * 0.72) AS heading FROM x")
def q_heading_like(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", S.heading_like(S.trim_lead(F.col("clause_text"))).alias("heading"))


@query(rf"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, regexp_matches({_LEAD}, '(?:^|[^0-9A-Za-z_])\d+(?:[.,]\d+)?(?:$|[^0-9A-Za-z_])') AS numeric FROM clauses")
def q_numeric_signal(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", S.numeric_signal(S.trim_lead(F.col("clause_text"))).alias("numeric"))


@query(rf"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, regexp_matches({_LEAD}, '(?i)(?:^|[^0-9A-Za-z_])\d[\d\s.,]*\s*(?:(?:{S.UNITS})(?:$|[^0-9A-Za-z_])|(?:{S.SIGNS})[0-9A-Za-z_])') AS monetary FROM clauses")
def q_monetary_signal(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", S.monetary_signal(S.trim_lead(F.col("clause_text"))).alias("monetary"))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, (CASE WHEN length(clause_text) < 48 THEN -1 WHEN length(clause_text) <= 180 THEN 2 WHEN length(clause_text) <= 260 THEN 1 ELSE 0 END)::INT AS focus FROM clauses")
def q_excerpt_focus(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", S.excerpt_focus(F.col("clause_text")).alias("focus"))


@query()
def q_excerpt_short(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", deep.excerpt(F.col("clause_text"), 60).alias("excerpt"))


def _pieces_cte(name: str, pattern: str) -> str:
    return f"""{name}_raw AS (
  SELECT contract_id, role, counterparty_role, list_filter(list_transform(regexp_split_to_array(replace(document_text, chr(13), ''), '{pattern}'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM filled
), {name}_all AS (
  SELECT contract_id, role, counterparty_role, unnest(parts) AS x, (generate_subscripts(parts, 1) - 1)::INT AS i FROM {name}_raw
), {name} AS MATERIALIZED (
  SELECT contract_id, role, counterparty_role, min(i)::INT AS pos, substr(arg_min(x, i), 1, 240) AS piece FROM {name}_all GROUP BY contract_id, role, counterparty_role, lower(x)
)"""


LINES_CTE = TEXTS_CTE + ", " + _pieces_cte("lines", r"[\n;]")
STATEMENTS_CTE = TEXTS_CTE + ", " + _pieces_cte("stmts", r"[\n.;]+")


@query(f"WITH {STATEMENTS_CTE} SELECT contract_id, pos, piece FROM stmts")
def q_statements(spark, sf):
    return segmentation.statements(segmentation.with_text(T.contracts(spark, sf)).select("contract_id", "document_text"))


@query(f"WITH {LINES_CTE} SELECT contract_id, pos, piece FROM lines")
def q_candidate_lines(spark, sf):
    return segmentation.candidate_lines(segmentation.with_text(T.contracts(spark, sf)).select("contract_id", "document_text"))
