"""Payloads to text, with what went wrong as a value: no step of it can end a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

# Fixed value: the sign that stands for bytes that are no UTF-8.
REPLACEMENT = "�"
BASE64 = r"^[0-9A-Za-z+/]*={0,2}$"
DECODED = "struct<text:string,error:string,warning:string>"


def _outcome(text=None, error=None, warning=None) -> Column:
    cell = lambda v: F.lit(v) if v is None or isinstance(v, str) else v
    return F.struct(cell(text).cast("string").alias("text"), cell(error).cast("string").alias("error"), cell(warning).cast("string").alias("warning"))


def decoded(payload: Column) -> Column:
    """Base64, white space around it and missing padding forgiven, as UTF-8: a struct of text, error and warning.

    What isn't base64 is an error without text. Bytes that aren't UTF-8 are dropped, and a warning says so; a
    replacement sign that the text had itself stays where all bytes are valid, and goes with them else.
    """

    def of(p: Column) -> Column:
        padded = F.concat(p, F.repeat(F.lit("="), F.pmod(-F.length(p), F.lit(4)).cast("int")))
        shaped = F.regexp_like(p, F.lit(BASE64)) & (F.pmod(F.length(F.rtrim(p, F.lit("="))), F.lit(4)) != 1)
        raw = bound(F.when(shaped, F.try_to_binary(padded, F.lit("base64"))), text)
        return F.coalesce(raw, _outcome(error="invalid_base64"))

    def text(b: Column) -> Column:
        as_text = b.cast("string")
        good = F.is_valid_utf8(as_text)
        rest = F.replace(F.make_valid_utf8(as_text), F.lit(REPLACEMENT), F.lit(""))
        return F.when(b.isNotNull(), F.when(good, _outcome(as_text)).otherwise(_outcome(rest, warning="invalid_utf8")))

    return bound(F.btrim(payload, F.lit(" \t\r\n")), of)


def request_text(document_text: Column, payload: Column, most_text: int, most_payload: int) -> Column:
    """The text of a request, which is given as such or as a payload: a struct of text, error and warning. Neither, or too much of either, is an error; nothing else reads on from there."""
    given = F.when(F.length(document_text) > most_text, _outcome(error="text_too_long")).otherwise(_outcome(document_text))
    sent = F.when(F.length(payload) > most_payload, _outcome(error="payload_too_long")).otherwise(decoded(payload))
    return F.when(document_text.isNotNull(), given).when(payload.isNotNull(), sent).otherwise(_outcome(error="missing_payload"))
