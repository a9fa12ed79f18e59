"""Column functions for languages, labels and request checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import rules as R


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def normalize_language(raw: Column) -> Column:
    """A supported code in lower case without blanks, else the default."""
    code = F.lower(F.trim(raw))
    return F.when(code.isin(*R.LANGUAGES), code).otherwise(F.lit(R.DEFAULT_LANGUAGE))


def locale_precedence(language: Column, locale: Column) -> Column:
    """Locale before language before default; a locale that isn't supported still wins, as the default."""
    return F.when(locale.isNotNull(), normalize_language(locale)).otherwise(normalize_language(language))


def localize_text(by_language: Column, language: Column) -> Column:
    return F.coalesce(F.element_at(by_language, language), F.element_at(by_language, F.lit(R.DEFAULT_LANGUAGE)), F.get(F.map_values(by_language), F.lit(0)), F.lit(""))


def text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def said(table: dict[str, dict[str, str]], code: Column, language: Column) -> Column:
    """The words of a table of wording by code and language."""
    words = text_map({f"{k}:{x}": t for k, by in table.items() for x, t in by.items()})
    return F.element_at(words, F.concat_ws(":", code, language))


def severity_label(language: Column, severity: Column) -> Column:
    flat = {f"{x}:{s}": t for x, by in R.SEVERITY_LABEL.items() for s, t in by.items()}
    return F.coalesce(lookup(flat, F.concat_ws(":", language, severity)), severity)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """{name} becomes its value; names that aren't given become empty."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.regexp_replace(template, r"\{\w+\}", "")


def reject_reason(size: Column, mime: Column) -> Column:
    return (
        F.when(size.isNull() | (size <= 0), "missing_file").when(size > R.MAX_UPLOAD_BYTES, "too_large").when(~F.coalesce(mime.isin(*R.ACCEPTED_MIMES), F.lit(False)), "mime_not_allowed")
    )


def execution_plan(mime: Column, has_text: Column) -> Column:
    """How a request runs: a known MIME type decides, else whether text came with it."""
    override = lookup(R.MIME_MODES, F.lower(F.trim(mime)))
    mode = F.coalesce(override, F.when(has_text, "local_first").otherwise("server_assist"))
    policy = F.when(override.isNotNull(), F.concat(F.lit("mime_type:"), F.lower(F.trim(mime)))).when(has_text, "document_text").otherwise("document_base64")
    return F.struct(mode.alias("mode"), (mode == "local_first").alias("offline_capable"), (mode == "server_assist").alias("network_required"), policy.alias("policy_source"))


def extractor(mime: Column, name: Column) -> Column:
    """Which extractor a document goes to; the order of the tests matters."""
    m, n = F.coalesce(F.lower(F.trim(mime)), F.lit("")), F.coalesce(F.lower(name), F.lit(""))
    return (
        F.when((m == "text/plain") | n.endswith(".txt"), "txt")
        .when((m == R.ACCEPTED_MIMES[1]) | n.endswith(".docx"), "docx")
        .when((m == "text/html") | n.endswith(".html") | n.endswith(".htm"), "html")
        .when((m == "application/msword") | n.endswith(".doc"), "doc")
        .when((m == "application/pdf") | n.endswith(".pdf"), "pdf")
        .otherwise("fallback")
    )


def type_label(language: Column, mime: Column) -> Column:
    kind = F.coalesce(lookup(R.TYPE_OF_MIME, mime), F.lit("other"))
    return lookup({f"{x}:{k}": t for x, by in R.TYPE_LABEL.items() for k, t in by.items()}, F.concat_ws(":", language, kind))


def length_error(text: Column, payload: Column) -> Column:
    """What is too long of a request's text and its base64 form, if anything."""
    return F.when(F.length(text) > R.MAX_TEXT_CHARS, "text_too_long").when(F.length(payload) > R.MAX_BASE64_CHARS, "payload_too_long")
