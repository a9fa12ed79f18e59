"""Ranking, roll-ups, fallbacks, and one nested report per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.binding import bound
from ..sources import rules as R
from ..sources import tables as T
from . import matching as M
from . import segmentation


def occurrences(matches: DataFrame, key: str) -> DataFrame:
    refs = F.array_join(F.transform(F.array_sort(F.collect_set("clause_index")), lambda i: (i + 1).cast("string")), ", ")
    return matches.groupBy(key, "rule_id", "severity").agg(F.count("*").alias("occurrences"), refs.alias("refs"))


def elevate_severity(severity: Column, n: Column) -> Column:
    return F.when((n >= 2) & (severity == "low"), "medium").when((n >= 2) & (severity == "medium"), "high").otherwise(severity)


def best_type(text: Column, detectors: dict[str, list[str]]) -> Column:
    """The detector with most markers in text, the first of equals; unknown without any."""
    scored = F.array(*[F.struct(M.marker_hits(text, m).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("k")) for i, (k, m) in enumerate(detectors.items())])
    # what stands for none beats those without a marker
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(1).alias("rank"), F.lit("unknown").alias("k")))
    return F.array_max(F.concat(scored, none))["k"]


def rank_risks(matches: DataFrame, key: str) -> DataFrame:
    """Risks of a document by severity, then clause, then rule order; risk_id is their number."""
    order = W.partitionBy(key).orderBy(F.desc(L.lookup(R.SEVERITY_RANK, F.col("severity"))), "clause_index", "rule_index")
    return matches.withColumn("n", F.row_number().over(order)).withColumn("risk_id", F.concat(F.lit("risk-"), F.col("n").cast("string")))


def with_fallback_risk(docs: DataFrame, risks: DataFrame, key: str) -> DataFrame:
    """risks, and one low risk without a clause for each document (with language) that has none; all with title and mitigation in the document's language."""
    rows = docs.select(key, "language").join(risks.select(key, "risk_id", "clause_id", "rule_id", "severity").hint("merge"), key, "left")
    rule = F.coalesce("rule_id", F.lit("none"))
    words = lambda table: L.said(table, rule, F.col("language"))
    return rows.select(key, F.coalesce("risk_id", F.lit("risk-1")).alias("risk_id"), "clause_id", "rule_id", F.coalesce("severity", F.lit("low")).alias("severity"),
                       words(R.RULE_TITLE).alias("title"), words(R.MITIGATION).alias("mitigation"))


def with_fallback_dispute(clauses: DataFrame, disputes: DataFrame, key: str) -> DataFrame:
    """disputes, and for each document without any its first clause, at low confidence."""
    rest = clauses.where("clause_index = 0").join(disputes.select(key).distinct().hint("shuffle_hash"), key, "left_anti")
    first = rest.select(key, "clause_id", F.lit(None).cast("string").alias("dispute_id"), F.lit(0.35).alias("confidence"), F.substring("clause_text", 1, 300).alias("excerpt"))
    return disputes.select(key, "clause_id", "dispute_id", "confidence", "excerpt").unionByName(first)


def lines(spark, sf) -> DataFrame:
    docs = segmentation.with_text(T.contracts(spark, sf)).select("contract_id", "role", "counterparty_role", "document_text")
    return segmentation.candidate_lines(docs)


def two_tier_topk(pieces: DataFrame, sections: DataFrame, key: str, terms: Column, most: int = 5) -> DataFrame:
    """(key, section, n, piece): pieces with a marker of the section, those that name a term first, capped.

    terms is an array of names. Where it is empty every piece counts as naming one, and the
    second round lists the same pieces once more.
    """
    low = F.lower("piece")
    named = F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: F.coalesce(t, F.lit("")) != "")
    hits = M.contains_join(pieces.withColumns({"_low": low, "_terms": named}), sections, "_low", "marker")
    hits = hits.select(key, "section", "pos", "piece", F.when(F.size("_terms") == 0, F.array(F.lit(0), F.lit(1))).when(F.exists("_terms", lambda t: F.contains(F.col("_low"), t)), F.array(F.lit(0))).otherwise(F.array(F.lit(1))).alias("_tiers")).distinct()
    tiered = hits.select(key, "section", "pos", "piece", F.explode("_tiers").alias("tier"))
    n = F.row_number().over(W.partitionBy(key, "section").orderBy("tier", "pos"))
    return tiered.withColumn("n", n).where(F.col("n") <= most)


def actor_topk(pieces: DataFrame, sections: DataFrame, key: str, actor: str | None, most: int = 2) -> DataFrame:
    """(key, section, n, piece): the first pieces with a marker of the section that name the actor, if there is one to name."""
    hits = M.contains_join(pieces.withColumn("_low", F.lower("piece")), sections, "_low", "marker")
    if actor:
        hits = hits.where(F.contains("_low", F.lower(F.trim(actor))))
    hits = hits.select(key, "section", "pos", "piece").distinct()
    return hits.withColumn("n", F.row_number().over(W.partitionBy(key, "section").orderBy("pos"))).where(F.col("n") <= most)


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def section_items(lines: Column, section: str, terms: Column, most: int = 5) -> Column:
    """Lines (x, and l in small letters) with a marker of the section, those that name a term first, capped; the same twice where there is no term; a fallback where none is found."""
    marked = F.filter(lines, lambda x: _any(x["l"], R.SECTIONS[section]))

    def ordered(s: Column) -> Column:
        names = lambda x: F.exists(s["t"], lambda t: F.contains(x["l"], t))
        first = F.when(F.size(s["t"]) == 0, s["x"]).otherwise(F.filter(s["x"], names))
        rest = F.when(F.size(s["t"]) == 0, s["x"]).otherwise(F.filter(s["x"], lambda x: ~names(x)))
        return F.transform(F.slice(F.concat(first, rest), 1, most), lambda x: x["x"])

    found = bound(F.struct(marked.alias("x"), terms.alias("t")), ordered)
    return bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(f"none: {section}"))))


def summary_sections(docs: DataFrame) -> DataFrame:
    """docs (role, counterparty_role, document_text) with role_summary: the items of every section, worked out within the row."""
    named = lambda *c: F.filter(F.transform(F.array(*c), lambda t: F.lower(F.trim(t))), lambda t: F.coalesce(t, F.lit("")) != "")

    def sections(d: Column) -> Column:
        return F.create_map(*[x for s in R.SECTIONS for x in (F.lit(s), section_items(d["lines"], s, d["own" if s in ("must_do", "deadlines") else "both"]))])

    lines = F.transform(segmentation.line_array(F.col("document_text")), lambda x: F.struct(x.alias("x"), F.lower(x).alias("l")))
    once = F.struct(lines.alias("lines"), named("role").alias("own"), named("role", "counterparty_role").alias("both"))
    # bound, so that the lines are cut once and not for each section
    return docs.withColumn("role_summary", bound(once, sections))


def role_summary(spark, sf) -> DataFrame:
    """(contract_id, section, items): the five sections of every contract, with a fallback where one is empty."""
    docs = segmentation.with_text(T.contracts(spark, sf)).select("contract_id", "role", "counterparty_role", "document_text")
    return summary_sections(docs).select("contract_id", F.explode("role_summary").alias("section", "items"))


def row_risks(clauses: Column) -> Column:
    """Risks of a document's clauses in rank order, each with its number; one low risk without a clause where there is none."""

    def of(c: Column, i: Column) -> Column:
        return bound(F.lower(c), lambda low: F.array_compact(F.array(*[
            F.when(_any(low, words), F.struct(F.lit(-R.SEVERITY_RANK[sev]).alias("rank"), i.alias("i"), F.lit(no).alias("no"), F.lit(sev).alias("severity"), F.lit(rule).alias("rule_id")))
            for no, (rule, sev, words) in enumerate(R.RULES)])))

    ranked = F.array_sort(F.flatten(F.transform(clauses, of)))
    rows = F.transform(ranked, lambda r, n: F.struct(
        F.concat(F.lit("risk-"), (n + 1).cast("string")).alias("risk_id"), r["severity"].alias("severity"), F.concat(F.lit("clause-"), (r["i"] + 1).cast("string")).alias("clause_id"), r["rule_id"].alias("rule_id")))
    none = F.array(F.struct(F.lit("risk-1").alias("risk_id"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("clause_id"), F.lit(None).cast("string").alias("rule_id")))
    return F.transform(F.array(F.array_sort(rows)), lambda x: F.when(F.size(x) > 0, x).otherwise(none))[0]


def row_disputes(clauses: Column) -> Column:
    """Disputes of a document's clauses; the first clause, at low confidence, where there is none."""

    def one(c: Column, i: Column, dispute: Column, confidence: Column) -> Column:
        return F.struct(F.concat(F.lit("clause-"), (i + 1).cast("string")).alias("clause_id"), dispute.alias("dispute_id"), confidence.alias("confidence"), F.substring(c, 1, 300).alias("excerpt"))

    def of(c: Column, i: Column) -> Column:
        return bound(F.lower(c), lambda low: F.array_compact(F.array(*[F.when(_any(low, words), one(c, i, F.lit(name), F.lit(conf))) for name, conf, words in R.DISPUTES])))

    found = F.array_sort(F.flatten(F.transform(clauses, of)))
    first = F.transform(F.slice(clauses, 1, 1), lambda c, i: one(c, i, F.lit(None).cast("string"), F.lit(0.35)))
    return F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(first))[0]


def analysis_output(spark, sf) -> DataFrame:
    """One nested row per contract: language, plan, counts, risks, disputes, sections.

    The pack is an array of literals, so that matches, ranks, fallbacks and sections are worked out within each
    contract's row: nothing is shuffled after the contracts are there.
    """
    docs = segmentation.with_text(T.contracts(spark, sf))
    plan = L.execution_plan(F.col("mime_type"), F.col("document_text").isNotNull()).alias("execution_plan")
    docs = summary_sections(docs).withColumn("_clauses", segmentation.clause_array(F.col("document_text")))
    return docs.where(F.size("_clauses") > 0).select(
        "contract_id", "language", "role", plan, F.size("_clauses").cast("long").alias("clauses"),
        row_risks(F.col("_clauses")).alias("risks"), row_disputes(F.col("_clauses")).alias("disputes"), "role_summary")


def candidates(clauses: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """One row per rule and clause with marker_hits (keywords found) and lexical (four a hit)."""
    hits = M.contains_join(clauses.withColumn("_low", F.lower("clause_text")), keywords, "_low", "keyword")
    found = hits.groupBy(key, "clause_index", "rule_id", "rule_index", "severity").agg(F.count("*").alias("marker_hits"))
    return found.withColumn("lexical", F.col("marker_hits") * 4)


def candidate_order(found: DataFrame, key: str) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.desc("lexical"), F.desc("marker_hits"), "clause_index", "rule_index")
    return found.withColumn("n", F.row_number().over(order))


def dispute_best(disputes: DataFrame, key: str) -> DataFrame:
    """The most confident dispute of each clause and excerpt, then the first of the pack."""
    best = F.min_by(F.struct("dispute_id", "confidence"), F.struct(-F.col("confidence"), F.col("dispute_index"))).alias("d")
    return disputes.groupBy(key, "clause_index", "excerpt").agg(best).select(key, "clause_index", "excerpt", "d.*")


def final_risk_order(found: DataFrame, key: str) -> DataFrame:
    """One row per rule of a document: severity raised by occurrences, then ordered by severity, occurrences, first appearance."""
    rolled = found.groupBy(key, "rule_id", "rule_index", "severity").agg(F.count("*").alias("occurrences"), F.min("clause_index").alias("first_clause"))
    shown = F.when(F.col("severity") == "critical", "high").otherwise(elevate_severity(F.col("severity"), F.col("occurrences")))
    rolled = rolled.withColumn("severity", shown)
    order = W.partitionBy(key).orderBy(L.lookup(R.UI_ORDER, F.col("severity")), F.desc("occurrences"), "first_clause", "rule_index")
    return rolled.withColumn("n", F.row_number().over(order)).select(key, "n", "rule_id", "severity", "occurrences")


def with_role_missing(risks: DataFrame, clauses: DataFrame, key: str) -> DataFrame:
    """risks with summary, and before them (n = 0) a medium one for each document in whose clauses the role isn't named: its summary says so, in the document's language (the default one where clauses have none)."""
    language = F.col("language") if "language" in clauses.columns else F.lit(R.DEFAULT_LANGUAGE)
    found = clauses.groupBy(key, language.alias("language"), "role").agg(F.bool_or(F.contains(F.lower("clause_text"), F.lower("role"))).alias("found"))
    says = F.concat(L.said(R.BRIEF, F.lit("role_missing"), F.col("language")), "role", F.lit("."))
    row = found.where(~F.col("found")).select(key, F.lit(0).alias("n"), F.lit("role_missing").alias("rule_id"), F.lit("medium").alias("severity"), F.lit(1).cast("long").alias("occurrences"), says.alias("summary"))
    return risks.withColumn("summary", F.lit(None).cast("string")).unionByName(row)


def brief(docs: DataFrame, clauses: DataFrame, disputes: DataFrame, sections: DataFrame) -> DataFrame:
    """(contract_id, language, brief), in the contract's language: an opening, then obligations, payment, deadlines, penalties and disputes as far as there are any.

    Every section lists its first two statements; obligations are those that name the
    role, else any; the counterparty's follow if it has one.
    """
    key = "contract_id"
    said = segmentation.statements(docs.select(key, "role", "counterparty_role", "document_text"))
    wanted = sections.where(F.col("section").isin("must_do", "payment_terms", "deadlines", "penalties"))
    hits = M.contains_join(said.withColumn("_low", F.lower("piece")), wanted, "_low", "marker").select(key, "role", "counterparty_role", "section", "pos", "piece", "_low").distinct()

    def first(when: Column) -> Column:
        held = F.slice(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "piece")))), 1, 2)
        return F.array_join(F.transform(held, lambda x: x["piece"]), "; ")

    must = F.col("section") == "must_do"
    got = hits.groupBy(key).agg(
        first(must & F.contains("_low", F.lower("role"))).alias("own"), first(must).alias("any"),
        first(must & F.contains("_low", F.lower("counterparty_role"))).alias("other"),
        *[first(F.col("section") == s).alias(s) for s in ("payment_terms", "deadlines", "penalties")])
    counts = clauses.groupBy(key).agg(F.count("*").alias("clauses"))
    open_ = disputes.groupBy(key).agg(F.count("*").alias("disputes"))
    all_ = docs.select(key, "role", "language").join(counts.hint("shuffle_hash"), key).join(got.hint("shuffle_hash"), key, "left").join(open_.hint("shuffle_hash"), key, "left")
    words = lambda part: L.said(R.BRIEF, F.lit(part), F.col("language"))
    line = lambda name: F.when(F.col(name) != "", F.concat(words(name), F.col(name), F.lit(".")))
    parts = [F.coalesce(line("own"), line("any")), *[line(x) for x in ("other", "payment_terms", "deadlines", "penalties")],
             F.when(F.col("disputes") > 0, F.concat(words("disputes"), F.col("disputes").cast("string"), F.lit(".")))]
    rest = F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), words("nothing"))
    return all_.select(key, "language", F.concat(words("for"), "role", words("with"), F.col("clauses").cast("string"), F.lit(". "), rest).alias("brief"))


def core_report(output: DataFrame) -> DataFrame:
    """analysis_output as the report a client gets: shown severities, titles, notes and advice, a wording for risks without a clause, dispute ids."""
    unknown = L.lookup(R.UNKNOWN_CLAUSE, F.col("language"))
    shown = lambda s: F.when(s == "critical", "high").otherwise(s)
    words = lambda table, r: L.said(table, F.coalesce(r["rule_id"], F.lit("none")), F.col("language"))
    risks = F.transform("risks", lambda r: F.struct(
        r["risk_id"].alias("risk_id"), F.coalesce(r["clause_id"], unknown).alias("clause_ref"), shown(r["severity"]).alias("severity"),
        words(R.RULE_TITLE, r).alias("title"), words(R.RULE_NOTE, r).alias("description"), words(R.MITIGATION, r).alias("recommendation")))
    ids = lambda d: F.concat_ws("_", F.col("contract_id").cast("string"), d["clause_id"])
    disputes = F.transform("disputes", lambda d: F.struct(ids(d).alias("dispute_id"), d["clause_id"].alias("clause_ref"), d["excerpt"].alias("fragment")))
    return output.select("contract_id", "language", "role", risks.alias("risks"), disputes.alias("disputes"), "role_summary")
