"""One report per request, whatever is wrong with it: errors are columns, and failed rows get a report that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import payload
from ..functions.binding import bound
from ..sources import rules as R
from . import report as P
from . import segmentation

RISK = "struct<risk_id:string,group_id:string,severity:string,clause_ref:string,occurrences:bigint,title:string,description:string,recommendation:string>"
REPORT = f"struct<state:string,error:string,summary:string,risks:array<{RISK}>>"


def _request(requests: DataFrame, most_text: int, most_payload: int) -> Column:
    """language, text, error and warnings of a request as a struct. Every step that can fail is guarded, and its outcome is a value of the row."""
    got = payload.request_text(F.col("document_text"), F.col("document_base64"), most_text, most_payload)
    mime = F.lower(F.trim("mime_type"))
    language = L.locale_precedence(F.col("language_raw"), F.col("locale_raw"))

    def of(r: Column) -> Column:
        g = r["got"]
        fine = g["error"].isNull()
        empty = fine & (F.btrim(g["text"], F.lit(segmentation.BLANK)) == "")
        short = fine & (r["mime"] == "application/pdf") & (F.length(g["text"]) < R.SHORT_PDF_CHARS)
        warnings = F.array_compact(F.array(g["warning"], F.when(empty, "empty_text"), F.when(short, "limited_pdf_text"), F.when(r["mime"] == "application/msword", "legacy_document")))
        text = F.when(empty, L.localize_text(L.text_map(R.PLACEHOLDER), r["language"])).otherwise(g["text"])
        return F.struct(r["language"].alias("language"), text.alias("text"), g["error"].alias("error"), warnings.alias("warnings"))

    return bound(F.struct(got.alias("got"), mime.alias("mime"), language.alias("language")), of)


def read_requests(requests: DataFrame, most_text: int = R.MAX_TEXT_CHARS, most_payload: int = R.MAX_BASE64_CHARS) -> DataFrame:
    """requests (document_text, document_base64, mime_type, language_raw, locale_raw, …) with language, text, error and warnings: a broken request stops neither the others nor the job."""
    return requests.select(*requests.columns, _request(requests, most_text, most_payload).alias("_r")).select(*requests.columns, "_r.*")


def warning_text(warnings: Column, language: Column) -> Column:
    """The sentences of warnings, or of errors, one after the other."""
    return F.array_join(F.filter(F.transform(warnings, lambda w: L.said(R.NOTICES, w, language)), lambda s: s.isNotNull()), " ")


def _risks(clauses: Column, language: Column) -> Column:
    """Risks of the rules in the form of a report."""
    unknown = L.said({"unknown": R.UNKNOWN_CLAUSE}, F.lit("unknown"), language)

    def one(r: Column) -> Column:
        rule = F.coalesce(r["rule_id"], F.lit("none"))
        return F.struct(r["risk_id"], rule, F.when(r["severity"] == "critical", "high").otherwise(r["severity"]), F.coalesce(r["clause_id"], unknown), F.lit(1).cast("bigint"),
                        L.said(R.RULE_TITLE, rule, language), L.said(R.RULE_NOTE, rule, language), L.said(R.MITIGATION, rule, language)).cast(RISK)

    return F.transform(P.row_risks(clauses), one)


def safe_report(requests: DataFrame, key: str, most_text: int = R.MAX_TEXT_CHARS, most_payload: int = R.MAX_BASE64_CHARS) -> DataFrame:
    """(key, language, state, error, warnings, summary, risks) for every request, exactly one row each.

    analyzed: the rules' risks. fallback: the request could not be read, or nothing of it is a clause; error says why, and the one risk
    asks for a review by hand. Failed rows take a branch of their own, in which the analysis has no part; nothing is shuffled, and requests are read once.
    """
    words = lambda table: lambda language: L.said({"it": table}, F.lit("it"), language)

    def good(r: Column) -> Column:
        notes = warning_text(r["warnings"], r["language"])
        return F.struct(F.lit("analyzed"), F.lit(None).cast("string"), F.concat_ws(" ", words(R.ANALYZED)(r["language"]), F.nullif(notes, F.lit(""))), _risks(r["clauses"], r["language"])).cast(REPORT)

    def failed(r: Column) -> Column:
        error, language = F.coalesce(r["error"], F.lit("no_clauses")), r["language"]
        details = F.concat_ws(" ", words(R.SAFE_MODE)(language), warning_text(F.concat(F.array(error), r["warnings"]), language))
        risk = lambda d: F.struct(F.lit("risk-1"), F.lit("analysis-safe-mode"), F.lit("medium"), F.lit("overview"), F.greatest(F.size(r["warnings"]), F.lit(1)).cast("bigint"),
                                  words(R.REVIEW_TITLE)(language), d, words(R.REVIEW_ADVICE)(language)).cast(RISK)
        return bound(details, lambda d: F.struct(F.lit("fallback"), error, d, F.array(risk(d))).cast(REPORT))

    def of(r: Column) -> Column:
        clauses = F.when(r["error"].isNull(), segmentation.clause_array(r["text"]))
        whole = bound(clauses, lambda c: F.struct(r["language"].alias("language"), r["error"].alias("error"), r["warnings"].alias("warnings"), c.alias("clauses")))
        report = lambda x: F.when(x["error"].isNull() & (F.size(x["clauses"]) > 0), good(x)).otherwise(failed(x))
        return F.struct(r["language"].alias("language"), r["warnings"].alias("warnings"), bound(whole, report).alias("report"))

    out = requests.select(key, bound(_request(requests, most_text, most_payload), of).alias("_r"))
    return out.select(key, "_r.language", "_r.report.state", "_r.report.error", "_r.warnings", "_r.report.summary", "_r.report.risks")
