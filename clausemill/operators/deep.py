"""The deep analysis: fragments, candidates with context scores, thresholds, roles and their duties, one report per contract.

Everything up to the candidates happens within a clause, and is worked out once for each distinct clause and role. What ranks or groups is dealt by contract once: windows and
groupings by contract and rule use that partitioning again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import deep as D
from ..functions import shape
from ..functions import text as T
from ..functions.binding import bound, quoted
from ..sources.packs import STARTER, Pack
from ..sources.shared import written
from . import matching as M
from . import scoring, segmentation
from .joins import each_once, fits, put_back
from .report import elevate_severity

KEY = "contract_id"
OWN_REF = rf"^\s*({shape.NUMBER})[.)]?(?:\s|$)"
LABEL_REF = rf"(?iu)^\s*{shape.LABEL}\s+({shape.NUMBER})"
EVIDENCE = 6
MOST_DUTIES = 12
BLOCK_CHARS = 12000


# A clause is worked out once for each role it is read for.
UNIT = ["role", "clause_text"]


def clause_units(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, fragments) of contracts (contract_id, role, document_text): where each clause stands, and a row per fragment of each distinct one.

    Fragments have the clause's and their own search forms and the role's forms. A distinct clause stands as a contract of its own there, so that whatever goes by
    contract and clause goes by it; its clause_ref is null where it has no number of its own.
    """
    docs = contracts.select(KEY, "role", T.normalize_text(F.col("document_text")).alias("document_text"))
    places = written(segmentation.clauses_numbered(docs).select(KEY, "clause_index", *UNIT), "places")
    units = each_once(places, UNIT, "clauses")
    text = F.col("clause_text")
    clauses = units.select(
        F.col("_unit").alias(KEY), F.lit(0).alias("clause_index"), *UNIT, D.role_forms(F.col("role")).alias("roles"),
        shape.clause_ref(text, F.lit(None).cast("int")).alias("clause_ref"), T.normalize_text(text).alias("_clean"))
    clauses = clauses.withColumns({"clause_norm": T.search_form(F.col("_clean")), "_parts": D.clean_fragments(F.col("_clean"))}).drop("_clean")
    out = clauses.select("*", F.posexplode("_parts").alias("fragment_index", "fragment")).drop("_parts")
    return places, written(out.withColumns({"norm": T.search_text(F.col("fragment")), "excerpt": D.excerpt(F.col("fragment"), 220)}), "fragments")


def at_places(places: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of distinct clauses, with the columns named, at each place of their clause; one without a number is referred to by its place."""
    out = put_back(places, rows.select(*UNIT, *columns), UNIT)
    return out.withColumn("clause_ref", F.coalesce("clause_ref", (F.col("clause_index") + 1).cast("string"))) if "clause_ref" in columns else out


def by_clause(contracts: DataFrame, made: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    """made(fragments) of distinct clauses, put back to all of their places."""
    places, frags = clause_units(contracts)
    return at_places(places, made(frags), *columns)


def fragment_table(contracts: DataFrame) -> DataFrame:
    """A row per fragment of contracts (contract_id, role, document_text), with its clause, search forms and the role's forms."""
    return by_clause(contracts, lambda f: f, "roles", "clause_ref", "clause_norm", "fragment_index", "fragment", "norm", "excerpt")


def role_named(frags: DataFrame) -> DataFrame:
    """A row per clause with a fragment: c_role, how many of the role's forms it holds."""
    return frags.where("fragment_index = 0").withColumn("c_role", D.hits(F.col("clause_norm"), F.col("roles")))


def role_found(rows: DataFrame) -> DataFrame:
    """(contract_id, role_found): whether one of the contract's clauses names the role."""
    return rows.groupBy(KEY).agg(F.max(F.col("c_role") > 0).alias("role_found"))


def with_signals(frags: DataFrame, pack: Pack = STARTER) -> DataFrame:
    """Fragments with the numbers of phrases found (h, and ch for the clause), the role's hits, and who acts."""
    norm, clause, roles = F.col("norm"), F.col("clause_norm"), F.col("roles")
    return frags.withColumns({
        "h": D.signal_hits("norm", pack.signals), "ch": D.signal_hits("clause_norm", pack.signals),
        "f_role": D.hits(norm, roles), "c_role": D.hits(clause, roles),
        "f_subject": D.role_action_lead(norm, roles), "c_subject": D.role_action_lead(clause, roles),
        "num": shape.numeric_signal(F.col("excerpt")), "mon": shape.monetary_signal(F.col("excerpt")), "norm_mon": shape.monetary_signal(norm),
    })


def _matched(frags: DataFrame, rules: list[tuple[str, int, str | None, tuple[str, ...]]]) -> DataFrame:
    """A row per fragment and rule with a keyword, but for headings and references; a fragment's own number beats its clause's."""
    found = F.expr("array(" + ", ".join(
        f"named_struct('rule_id', {quoted(r)}, 'rule_index', {i}, 'severity', {'CAST(NULL AS STRING)' if s is None else quoted(s)}, "
        f"'marker_hits', {M.hits_sql('norm', k)}, 'keywords', array({', '.join(map(quoted, k))}))" for r, i, s, k in rules) + ")")
    rows = frags.where((F.col("excerpt") != "") & ~D.reference_like(F.col("norm")))
    rows = rows.select("*", F.explode(F.filter(found, lambda x: x["marker_hits"] > 0)).alias("m")).select("*", "m.*").drop("m")
    own = F.coalesce(F.nullif(F.regexp_extract("fragment", OWN_REF, 1), F.lit("")), F.nullif(F.regexp_extract("fragment", LABEL_REF, 1), F.lit("")))
    return rows.withColumns({"clause_ref": F.coalesce(own, "clause_ref"), "lexical": F.col("marker_hits") * 4})


def risk_matches(signals: DataFrame, pack: Pack = STARTER) -> DataFrame:
    """Fragments by rule before exclusions, with excluded, burden (on the other side) and beneficial as flags."""
    rows = _matched(signals, [(r["rule_id"], i, r["severity"], r["keywords"]) for i, r in enumerate(pack.rules)])
    rows = rows.withColumn("others", D.counterparty_terms(F.col("roles")))
    rows = rows.withColumns({
        "excluded": D.acceptance_excluded(F.col("rule_id"), F.col("fragment"), F.col("h"), F.col("ch")),
        "_good": D.benefits(F.col("rule_id"), F.col("norm"), F.col("roles"), F.col("others")),
    })
    return rows.select("*", "_good.*").drop("_good")


def risk_candidates(signals: DataFrame, pack: Pack = STARTER) -> DataFrame:
    return risk_matches(signals, pack).where(~F.col("excluded") & ~F.col("beneficial"))


def dispute_candidates(signals: DataFrame, pack: Pack = STARTER) -> DataFrame:
    return _matched(signals, [(r["rule_id"], i, None, r["keywords"]) for i, r in enumerate(pack.disputes)])


def reranked(rows: DataFrame, kind: str, pack: Pack = STARTER) -> DataFrame:
    """Candidates of a kind (rules, disputes) with contextual, total and passed: the scores, half the clause's (towards zero), and what stands near the keywords; near rules, the role as well."""
    acts, pairs = D.phrases(*pack.signals["role_action"]), [(0, 1, 96, 96), *([(2, 0, 88, 88)] if kind == "rules" else [])]
    rows = scoring.context_scores(rows, pack, kind)
    near = bound(D.reach_counts(F.col("norm"), F.array("keywords", acts, "roles"), pairs), lambda n: n[0] + 2 * n[1] if kind == "rules" else n[0])
    context = F.col("f_score") + (F.col("c_score") / 2).cast("int") + near + shape.excerpt_focus(F.col("excerpt"))
    rows = rows.withColumn("contextual", context.cast("int")).withColumn("total", (F.col("lexical") + F.col("contextual")).cast("int"))
    return scoring.passing(rows, pack, kind)


def ranking() -> tuple[Column, ...]:
    """The order of candidates within a contract."""
    return (F.desc("total"), F.desc("contextual"), F.desc("marker_hits"), F.col("clause_index"), F.col("fragment_index"), F.col("rule_index"))


def risk_matches_kept(candidates: DataFrame) -> DataFrame:
    """Candidates that pass, the first of equal (rule, clause, excerpt), in order (n) within a contract, with directed: whether the role leads or isn't named.

    Where some matches of a rule are directed, the others go.
    """
    rows = candidates.where("passed").repartition(KEY)
    first = F.row_number().over(W.partitionBy(KEY, "rule_id", "clause_ref", "excerpt").orderBy(*ranking()))
    rows = rows.withColumn("_first", first).where("_first = 1").drop("_first")
    rows = rows.withColumn("directed", (F.col("f_role") == 0) | F.col("f_subject"))
    rows = rows.withColumn("_some", F.max("directed").over(W.partitionBy(KEY, "rule_id"))).where("directed OR NOT _some").drop("_some")
    return rows.withColumn("n", F.row_number().over(W.partitionBy(KEY).orderBy(*ranking())))


def risk_items(kept: DataFrame) -> DataFrame:
    """(contract_id, risk_no, rule_id, severity, occurrences, clause_refs, evidence): a row per rule, severe and frequent ones first."""
    listed = F.array_sort(F.collect_list(F.struct("n", "clause_ref", "excerpt")))
    items = kept.groupBy(KEY, "rule_id", "severity").agg(F.count("*").alias("occurrences"), F.min("n").alias("first"), listed.alias("x"))
    items = items.withColumns({
        "severity": elevate_severity(F.col("severity"), F.col("occurrences")),
        "clause_refs": F.array_distinct(F.transform("x", lambda r: r["clause_ref"])),
        "evidence": F.slice(F.transform("x", lambda r: r["excerpt"]), 1, EVIDENCE),
    })
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    order = W.partitionBy(KEY).orderBy(rank.desc(), F.desc("occurrences"), "first")
    return items.withColumn("risk_no", F.row_number().over(order)).drop("x", "first")


def dispute_items(candidates: DataFrame) -> DataFrame:
    """(contract_id, n, clause_ref, excerpt, rule_id): the best dispute of each clause and excerpt, in order."""
    rows = candidates.where("passed").repartition(KEY)
    best = F.row_number().over(W.partitionBy(KEY, "clause_ref", "excerpt").orderBy(*ranking()))
    rows = rows.withColumn("_best", best).where("_best = 1")
    return rows.select(KEY, F.row_number().over(W.partitionBy(KEY).orderBy(*ranking())).alias("n"), "clause_ref", "excerpt", "rule_id")


def carried(signals: DataFrame) -> DataFrame:
    """Fragments with carry: whether a role lead before it in the clause still holds when the fragment begins.

    A lead sets it; another party's lead, a role that doesn't act, or a fragment that is no continuation resets it. The last such
    event before a fragment decides.
    """
    fragment, norm, roles = F.col("fragment"), F.col("norm"), F.col("roles")
    acts = F.col("f_subject")
    lead, foreign = D.role_lead_fragment(fragment, norm, roles, acts), D.foreign_role_lead(fragment, norm, roles, acts)
    rows = signals.withColumns({
        "lead": lead & (F.col("f_role") > 0), "foreign": foreign, "listed": D.continuation_like(fragment, norm), "line": D.summary_item(fragment),
        "opening": F.col("f_subject") & F.regexp_like(fragment, F.lit(rf"(?iu)(?:{D.OBLIGED})\s*:\s*$")), "chars": F.length(fragment) + 1,
    })
    stop = F.col("foreign") | ((F.col("f_role") > 0) & ~F.col("f_subject")) | ~F.col("listed")
    event = F.when(F.col("lead"), True).when(stop, False)
    before = W.partitionBy(KEY, "clause_index").orderBy("fragment_index").rowsBetween(W.unboundedPreceding, -1)
    return rows.repartition(KEY).withColumn("carry", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)))


def role_obligations(rows: DataFrame) -> DataFrame:
    """carried fragments that oblige the role, with score and excerpt: the role acts, or a lead before it is carried on."""
    h = F.col("h")
    goes_on = F.col("carry") & ~F.col("foreign") & (F.col("f_role") == 0) & (h["exclude"] == 0) & F.col("listed")
    own = F.when((F.col("f_role") > 0) & F.col("f_subject"), F.col("f_role")).otherwise(goes_on.cast("int"))
    rows = rows.withColumns({"_on": goes_on.cast("int"), "_own": own, "item": D.summary_item(D.excerpt(F.col("fragment"), 520))})
    signals = h["obligations"] + h["payment"] + h["deadlines"] + F.col("_on")
    rows = rows.where((F.col("_own") > 0) & (signals > 0) & (h["exclude"] == 0) & (F.col("item") != ""))
    return rows.withColumn("score", F.col("_own") * 6 + h["obligations"] * 4 + (h["payment"] + h["deadlines"]) * 2 + F.col("_on") * 2)


def role_led_blocks(rows: DataFrame) -> DataFrame:
    """Fragments behind an opening of the role ("... shall:") up to the next party's lead or the next sibling number, BLOCK_CHARS at most.

    A block is a running number of openings within a contract; its first stop ends it.
    """
    at = W.partitionBy(KEY).orderBy("clause_index", "fragment_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("block", F.sum(F.col("opening").cast("int")).over(at))
    inside = W.partitionBy(KEY, "block").orderBy("clause_index", "fragment_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a numbered clause of its own is a sibling of the one that opened the block
    sibling = F.col("clause_index") > F.first("clause_index").over(inside)
    stops = ~F.col("opening") & (F.col("foreign") | sibling)
    rows = rows.withColumn("_stopped", F.max(stops).over(inside)).withColumn("_chars", F.sum("chars").over(inside))
    rows = rows.where((F.col("block") > 0) & ~F.col("opening") & ~F.col("_stopped") & (F.col("_chars") <= BLOCK_CHARS)).withColumn("item", F.col("line"))
    h = F.col("h")
    fits = (h["exclude"] == 0) & ((h["obligations"] > 0) | (h["payment"] > 0) | F.col("listed"))
    return rows.where((F.col("item") != "") & fits)


# What is needed of rows at their places: to rank candidates, to find blocks, to merge duties.
RANKED = ("fragment_index", "rule_id", "rule_index", "severity", "clause_ref", "excerpt", "marker_hits", "contextual", "total", "f_role", "f_subject", "passed")
BLOCKED = ("fragment_index", "h", "f_subject", "foreign", "listed", "line", "opening", "chars")
OWED = ("fragment_index", "f_subject", "score", "item")


def merged_obligations(blocks: DataFrame, own: DataFrame) -> DataFrame:
    """(contract_id, items): block items and those that the role opens, or without block items the best of its own; MOST_DUTIES at most."""
    most = MOST_DUTIES
    in_order = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col("item"), F.col("f_subject")))), lambda x: F.struct(x["item"].alias("item"), x["f_subject"].alias("opens")))
    led = blocks.groupBy(KEY).agg(in_order("clause_index", "fragment_index").alias("led"))
    best = own.groupBy(KEY).agg(in_order((-F.col("score")).alias("s"), "clause_index", "fragment_index").alias("own"))
    both = led.join(best.hint("shuffle_hash"), KEY, "full")
    plain = lambda c: T.unique_strings(F.transform(F.coalesce(c, F.array()), lambda x: x["item"]))
    kept = F.slice(F.coalesce("own", F.array().cast(both.schema["own"].dataType)), 1, most)
    explicit = T.unique_strings(F.transform(F.filter(kept, lambda x: x["opens"]), lambda x: x["item"]))
    led_items = F.slice(plain(F.col("led")), 1, most)
    own_items = T.unique_strings(F.transform(kept, lambda x: x["item"]))
    return both.select(KEY, F.slice(F.when(F.size(led_items) > 0, F.array_union(led_items, explicit)).otherwise(own_items), 1, most).alias("items"))


PARTS = ("risks", "disputes", "duties")


def deep_report(contracts: DataFrame, pack: Pack = STARTER, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """(contract_id, role_found, risks, disputes, duties): one row per contract, those without matches included. Parts that aren't asked for are neither worked out nor columns.

    Without a risk a contract has one of low severity; a role that no clause names gives a medium one before all others.
    """
    # all branches need the fragments: written once
    places, frags = clause_units(contracts)
    signals = written(with_signals(frags, pack), "signals")
    made = {"found": role_found(at_places(places, role_named(frags), "c_role"))}
    if "risks" in parts:
        risks = risk_items(risk_matches_kept(at_places(places, reranked(risk_candidates(signals, pack), "rules", pack).where("passed"), *RANKED)))
        made["risks"] = risks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("risk_no", "rule_id", "severity", "occurrences", "clause_refs", "evidence"))).alias("risks"))
    if "disputes" in parts:
        disputes = dispute_items(at_places(places, reranked(dispute_candidates(signals, pack), "disputes", pack).where("passed"), *RANKED))
        made["disputes"] = disputes.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("n", "clause_ref", "excerpt", "rule_id"))).alias("disputes"))
    if "duties" in parts:
        rows = written(carried(signals), "carried")
        made["duties"] = merged_obligations(role_led_blocks(at_places(places, rows, *BLOCKED)), at_places(places, role_obligations(rows), *OWED))
    out = contracts.select(KEY)
    for part in made.values():
        # all sides have one row per contract
        out = out.join(part.hint("shuffle_hash"), KEY, "left")
    item = "struct<risk_no:int,rule_id:string,severity:string,occurrences:bigint,clause_refs:array<string>,evidence:array<string>>"

    def single(no: int, rule: str, severity: str, ref: str) -> Column:
        return F.array(F.struct(F.lit(no), F.lit(rule), F.lit(severity), F.lit(1).cast("long"), F.array(F.lit(ref)), F.array().cast("array<string>")).cast(item))

    found_ = F.coalesce("role_found", F.lit(False))
    shown = {}
    if "risks" in parts:
        listed = F.coalesce("risks", single(1, "low-signal", "low", "overview"))
        shown["risks"] = F.when(found_, listed).otherwise(F.concat(single(0, "role-missing", "medium", "overview"), listed))
    if "disputes" in parts:
        shown["disputes"] = F.col("disputes")
    if "duties" in parts:
        shown["duties"] = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(KEY, found_.alias("role_found"), *[c.alias(n) for n, c in shown.items()])


def stretch_rows(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, units): the stretches (contract_id, part, stretch) of normalized texts, and the distinct ones with a number.

    Whether a text is clean is asked of its distinct stretches; only contracts with one that isn't are normalized as a whole.
    """
    text = F.col("document_text")
    cut = lambda docs, c: docs.select(KEY, F.posexplode(D.stretches(c)).alias("part", "stretch"))
    rows = written(cut(contracts, text), "stretches")
    units = each_once(rows, ["stretch"], "units")
    unclean = written(units.where(T.unclean(F.col("stretch"))).select("stretch"), "unclean")
    if unclean.isEmpty():
        return rows, units
    changed = written(put_back(rows, unclean, ["stretch"]).select(F.col(KEY).alias("_changed")).distinct(), "changed")
    side = changed.hint("broadcast" if fits(changed) else "merge")
    same = F.col(KEY).eqNullSafe(F.col("_changed"))
    again = cut(contracts.join(side, same, "left_semi"), T.normalize_twice(text))
    rows = written(rows.join(side, same, "left_anti").unionByName(again), "stretches")
    return rows, each_once(rows, ["stretch"], "units")


def candidate_lines(units: DataFrame) -> DataFrame:
    """(stretch, clause, at, id, same, line) of numbered stretches: the excerpts of their fragments (clause 0) and of those of their clauses (from 1 on).

    The first of those that read the same stands for all of a stretch; same is one number for lines that read the same in any stretch.
    """
    stretch = F.col("stretch")
    # a stretch that is one clause has no other fragments
    clauses = F.filter(F.transform(segmentation.numbered_array(stretch), T.normalize_text), lambda c: c != stretch)
    sources = units.select("_unit", "stretch", F.posexplode(F.concat(F.array(stretch), clauses)).alias("clause", "source"))
    pieces = sources.select("_unit", "stretch", "clause", F.posexplode(D.broken(F.col("source"))).alias("at", "fragment"))
    lines = written(pieces.withColumn("line", D.excerpt(F.col("fragment"), 240)).drop("fragment"), "excerpts").where("line <> ''")
    first = F.row_number().over(W.partitionBy("_unit", "k").orderBy("clause", "at"))
    lines = lines.withColumn("k", T.search_text(F.col("line"))).withColumn("_first", first).where("_first = 1")
    lines = written(lines.drop("_unit", "_first").withColumn("id", F.monotonically_increasing_id()), "lines")
    return written(put_back(lines, each_once(lines, ["k"], "readings").withColumnRenamed("_unit", "same"), ["k"]), "candidates")


def candidate_excerpts(contracts: DataFrame) -> DataFrame:
    """(contract_id, n, line): excerpts of the fragments of the text, then of those of its clauses, the first of those that read the same.

    Each distinct stretch of a text is worked out once; what is dealt by contract are numbers, the lines are put in their place last.
    """
    rows, units = stretch_rows(contracts)
    lines = candidate_lines(units)
    placed = put_back(rows, lines.drop("line"), ["stretch"]).repartition(KEY)
    order = (F.col("clause") > 0, "part", "clause", "at")
    first = placed.withColumn("_first", F.row_number().over(W.partitionBy(KEY, "same").orderBy(*order))).where("_first = 1")
    numbered = first.select(KEY, "id", F.row_number().over(W.partitionBy(KEY).orderBy(*order)).alias("n"))
    return put_back(numbered, lines.select("id", "line"), ["id"]).select(KEY, "n", "line")
