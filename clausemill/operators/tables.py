"""Jobs over log and registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def illegal_transitions(log: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(event_id, from_status, to_status) of steps that aren't allowed."""
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    before = F.lag("status").over(W.partitionBy("job_id").orderBy("ts", "event_id"))
    steps = log.select("event_id", before.alias("from_status"), F.col("status").alias("to_status"))
    return steps.where(F.col("from_status").isNotNull() & ~F.concat_ws(">", "from_status", "to_status").isin(pairs))


def current_status(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def stuck_jobs(log: DataFrame, now: str, seconds: int = 120) -> DataFrame:
    """Jobs whose latest state is pending, and older than the limit."""
    limit = F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {seconds} SECONDS")
    return current_status(log).where(F.col("status").isin("queued", "preprocessing", "analyzing") & (F.col("ts") < limit))


def violations(table: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how often each check is false. A check that is null counts as met."""
    return table.agg(*[F.count(F.when(~ok, 1)).alias(name) for name, ok in checks.items()])


def orphans(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(fk, orphans) for each (child, child key, parent, parent key) of the tables; null keys are no orphans.

    Each table is read once and gives its keys with what they are, all of them are counted by key in one grouping, after counts within the tasks, and a key
    that no parent has is an orphan wherever it was found. Keys are compared as text.
    """
    parents = list(dict.fromkeys((p, pk) for _, _, p, pk in keys))
    cell = lambda at, column, fk: F.struct(F.lit(at).alias("at"), F.col(column).cast("string").alias("k"), F.lit(fk).alias("fk"))
    every = None
    for name, table in tables.items():
        held = [cell(parents.index((name, pk)), pk, -1) for p, pk in parents if p == name]
        held += [cell(parents.index((p, pk)), ck, i) for i, (c, ck, p, pk) in enumerate(keys) if c == name]
        if held:
            rows = table.select(F.explode(F.array(*held)).alias("x")).select("x.*").where("k IS NOT NULL")
            every = rows if every is None else every.unionByName(rows)
    found = every.groupBy("at", "k").agg(F.max(F.col("fk") == -1).alias("known"), *[F.count(F.when(F.col("fk") == i, 1)).alias(f"n{i}") for i in range(len(keys))])
    sums = found.where(~F.col("known")).agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(keys))])
    told = ", ".join(f"'{c}.{ck}', n{i}" for i, (c, ck, *_) in enumerate(keys))
    return sums.selectExpr(f"stack({len(keys)}, {told}) AS (fk, orphans)")


ROWS_A_TASK = 500_000


def duplicates(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often. Keys are dealt to as many tasks as the table's rows ask for, so that a task holds no more of them when there are more rows."""
    keys = table.select(*key)
    dealt = keys.repartition(-(-keys.count() // ROWS_A_TASK) or 1, *key)
    return dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def many_defaults(table: DataFrame, user: str, is_default: Column) -> DataFrame:
    return table.where(is_default).groupBy(F.col(user).alias("user_id")).agg(F.count("*").alias("defaults")).where("defaults > 1")


def default_language(catalog: DataFrame) -> DataFrame:
    """(scope, code, error): each scope's active default, else its first active code, else an error."""
    active = F.when(F.col("is_active"), F.struct((~F.col("is_default")).alias("last"), F.col("code")))
    best = catalog.groupBy("scope").agg(F.min(active).alias("m"))
    return best.select("scope", F.col("m.code").alias("code"), F.when(F.col("m").isNull(), "no active language").alias("error"))


def set_default(catalog: DataFrame, code: str) -> DataFrame:
    """catalog with code as the only default of each scope in which it is active; other scopes stay."""
    can = F.max(F.col("is_active") & (F.col("code") == code)).over(W.partitionBy("scope"))
    return catalog.withColumn("is_default", F.when(F.coalesce(can, F.lit(False)), F.col("code") == code).otherwise(F.col("is_default")))


def supported_sync(catalog: DataFrame, configured: str) -> DataFrame:
    """(scope, supported, drifted, elected): active codes, whether they differ from the configured list, and the default after re-election."""
    active = lambda cond: F.when(F.col("is_active") & cond, F.col("code"))
    per = catalog.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list(active(F.lit(True)))), ",").alias("supported"), F.min(active(F.col("is_default"))).alias("held"), F.min(active(F.lit(True))).alias("first"))
    return per.select("scope", "supported", (F.col("supported") != configured).alias("drifted"), F.coalesce("held", "first").alias("elected"))


def typed_config(config: DataFrame, required) -> DataFrame:
    """(scope, config_key, value, error) for each required key of each scope: its value by its declared type, or what is wrong with it."""
    wanted = F.array(*[F.struct(F.lit(k).alias("config_key"), F.lit(t).alias("value_type")) for k, t in required])
    asked = config.select("scope").distinct().select("scope", F.inline(wanted))
    both = asked.join(config.select("scope", "config_key", "value_type", "value_json").hint("shuffle_hash"), ["scope", "config_key", "value_type"], "left")
    number = F.col("value_json").rlike("^[0-9]+$")
    value = F.when(F.col("value_type") == "string", F.get_json_object(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "$.v")).when(number, F.col("value_json"))
    error = F.when(F.col("value_json").isNull(), "missing").when((F.col("value_type") == "integer") & ~number, "not an integer")
    return both.select("scope", "config_key", value.alias("value"), error.alias("error"))


def config_invariants(config: DataFrame, catalog: DataFrame, cap: int) -> DataFrame:
    """(scope, range_ok, target_ok, default_ok): priorities within 1 to 9 and in order, target within its cap, default language active."""
    number = lambda key: F.max(F.when(F.col("config_key") == key, F.expr("try_cast(value_json AS BIGINT)")))
    held = config.groupBy("scope").agg(
        number("jobs.min_priority").alias("lo"), number("jobs.max_priority").alias("hi"), number("quality.target").alias("target"),
        F.max(F.when(F.col("config_key") == "language.default", F.btrim("value_json", F.lit('"')))).alias("code"))
    active = catalog.where("is_active").select("scope", "code", F.lit(True).alias("on")).distinct()
    both = held.join(active.hint("shuffle_hash"), ["scope", "code"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return both.select("scope", yes((F.col("lo") >= 1) & (F.col("lo") <= F.col("hi")) & (F.col("hi") <= 9)).alias("range_ok"),
                       yes((F.col("target") > 0) & (F.col("target") <= cap)).alias("target_ok"), yes(F.col("on")).alias("default_ok"))


def cascaded(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of child whose parent stays."""
    return child.join(gone, key, "left_anti")


def nulled(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """child with its reference nulled where the parent goes."""
    marked = child.join(gone.select(key, F.lit(True).alias("_gone")), key, "left")
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def ranked_by_ranges(rows: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """rows with place, their number in the order of by, then ties, over the whole table.

    Rows are dealt by ranges of all these columns and written so; each range is numbered by itself, and the numbers of rows of the ranges
    before it, of which there are as many as partitions, are added. Rows that are equal in by alone are parted by ties.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *by, *ties).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*by, *ties))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_before", "_own", "_part")


def report_fetch(contracts: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """contracts with an array for each child table: its rows of that contract as structs of the listed columns, in their order; empty where there are none.

    Each child is gathered by key and joined by key: where all tables are bucketed by it alike, nothing is shuffled.
    """
    out = contracts
    for name, (child, columns) in children.items():
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows.hint("merge"), key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)))
    return out


def retained(table: DataFrame, at: str, now: str, days: int) -> DataFrame:
    return table.where(F.col(at) >= F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS"))


def remote_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(job_id, status): what a local job becomes after its remote state (remote_status, has_result) is seen; without one it stays."""
    seen = F.col("remote_status")
    status = (
        F.when(seen == "processing", "analyzing").when(seen == "failed", "failed")
        .when((seen == "completed") & F.col("has_result"), "report_ready").when(seen == "completed", "failed").otherwise(F.col("status"))
    )
    return local.join(remote, "job_id", "left").select("job_id", status.alias("status"))


def pack_violations(packs: DataFrame, languages: list[str], severities: list[str]) -> DataFrame:
    """(pack_id, violation) of packs (pack_id, rules, labels, modes, network_modes).

    Titles that lack a language, severities that aren't known or have no label, modes without a name, network modes that don't
    go to a server. Found within each pack's row.
    """
    rules = packs.select("*", F.explode("rules").alias("r"))
    missing = F.filter(F.array(*[F.lit(x) for x in languages]), lambda x: F.coalesce(F.element_at("r.title", x), F.lit("")) == "")
    sev = F.col("r.severity")
    found = F.concat(
        F.transform(missing, lambda x: F.concat(F.lit("title:"), x)),
        F.array_compact(F.array(
            F.when(~F.coalesce(sev.isin(severities), F.lit(False)), F.concat(F.lit("severity:"), F.coalesce(sev, F.lit("")))),
            F.when(F.element_at("labels", sev).isNull(), F.concat(F.lit("label:"), sev)))))
    modes = F.concat(
        F.transform(F.filter("modes", lambda m: F.trim(m) == ""), lambda m: F.lit("mode:empty")),
        F.transform(F.filter("network_modes", lambda m: m != "server_assist"), lambda m: F.concat(F.lit("network:"), m)))
    return rules.select("pack_id", F.explode(found).alias("violation")).unionByName(packs.select("pack_id", F.explode(modes).alias("violation")))


def job_times(log: DataFrame) -> DataFrame:
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("ts")))
    return log.groupBy("job_id").agg(at("uploaded").alias("created"), at("preprocessing").alias("started"), at("report_ready").alias("finished"))
