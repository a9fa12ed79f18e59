"""Repair of damaged text, over text that is damaged on purpose: SQL states what was there before, or the same rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair
from ..operators import repair as O
from ..sources import tables as T
from ..sources.deep_pack import SEGMENT_WORDS
from .deep_queries import lit
from .registry import query

WORD = "0-9A-Za-zА-Яа-яЁё"
# Words and what they look like without their spaces, by line number.
RUNS = ("срок поставки товара", "договор поставки", "оплата услуг по договор", "стороны и исполнитель", "цена работ и услуг", "неизвестноеслово и", "договор")


def _runs(spaced: bool) -> str:
    return "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN {lit(r if spaced else r.replace(' ', ''))}" for i, r in enumerate(RUNS)) + " END"


_KNOWN = " ".join(f"WHEN {i + 1} THEN {lit(r if i < 5 else r.replace(' ', ''))}" for i, r in enumerate(RUNS))


@query(f"SELECT contract_id, string_agg(clause_text, chr(10) || chr(10) ORDER BY ln, pk, sk) AS value FROM ({T.DEEP_CLAUSE_SQL}) GROUP BY contract_id")
def q_mojibake_repair(spark, sf):
    # UTF-8 read as code page 1251, and put right again
    wrong = F.translate(F.decode(F.encode("document_text", "UTF-8"), "ISO-8859-1"), repair.BYTES, repair.CP1251)
    return O.mojibake_repaired(T.deep_contracts(spark, sf).select("contract_id", wrong.alias("value")), "value")


@query(f"SELECT l_orderkey, l_linenumber, 'Пункт: ' || CASE l_linenumber {_KNOWN} END AS value FROM lineitem")
def q_respace_words(spark, sf):
    runs = T.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"'Пункт: ' || {_runs(False)} AS value")
    return O.respaced(runs, "value", list(SEGMENT_WORDS))


_SPLIT = "replace(text, ' th', '-' || chr(10) || 'th')"


@query(rf"SELECT doc_id, regexp_replace({_SPLIT}, '([{WORD}])-\s*\n\s*([{WORD}])', '\1\2', 'g') || chr(10) || 'на договор 5' AS value FROM documents")
def q_layout_repair(spark, sf):
    t = F.expr(f"{_SPLIT} || chr(10) || 'на д о г о в о р 5'")
    return T.table(spark, sf, "documents").select("doc_id", repair.layout_repair(t).alias("value"))


@query()
def q_trim_noise_lines(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", repair.trim_noise_lines(F.col("text")).alias("value"))
