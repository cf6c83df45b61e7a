"""Ownership of names, event chains, and caveats of tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a verb does in a state.
MATRIX = (
    ("live", "stop", "proceed"), ("live", "release", "proceed"), ("live", "start", "idempotent"), ("live", "force-release", "proceed"), ("live", "claim", "refuse"),
    ("stopped", "stop", "idempotent"), ("stopped", "release", "proceed"), ("stopped", "start", "proceed"), ("stopped", "force-release", "proceed"), ("stopped", "claim", "refuse"),
    ("released", "stop", "refuse"), ("released", "release", "idempotent"), ("released", "start", "reroute"), ("released", "force-release", "refuse"), ("released", "claim", "proceed"),
    ("readonly", "stop", "refuse"), ("readonly", "release", "refuse"), ("readonly", "start", "refuse"), ("readonly", "force-release", "refuse"), ("readonly", "claim", "refuse"),
)
RESULT = {"stop": "stopped", "release": "released", "start": "live", "force-release": "released", "claim": "live"}


def matrix(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{s}', '{v}', '{o}')" for s, v, o in MATRIX)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS m(state, verb, outcome)")


def transition(state: Column, verb: Column) -> Column:
    """What the verb does in the state; refuse for unknown ones."""
    found = F.create_map(*(F.lit(x) for s, v, o in MATRIX for x in (f"{s}/{v}", o)))
    return F.coalesce(F.try_element_at(found, F.concat(state, F.lit("/"), verb)), F.lit("refuse"))


def fold(verbs: DataFrame) -> DataFrame:
    """Each name's verbs in order of seq, from released without an owner: name, state, owner, counts by outcome.

    A verb other than claim and force-release by anyone but the owner is refused. A name's log is folded in the JVM.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "actor", "verb")))
    start = F.struct(F.lit("released").alias("state"), F.lit(None).cast("string").alias("owner"), *(F.lit(0).alias(n) for n in ("n_proceed", "n_idempotent", "n_reroute", "n_refuse")))
    after = F.create_map(*(F.lit(x) for pair in RESULT.items() for x in pair))

    def step(acc: Column, v: Column) -> Column:
        outcome = transition(acc["state"], v["verb"])
        foreign = ~v["verb"].isin("claim", "force-release") & acc["owner"].isNotNull() & (acc["owner"] != v["actor"])
        outcome = F.when((outcome == "proceed") & foreign, "refuse").otherwise(outcome)
        state = F.when(outcome == "proceed", F.element_at(after, v["verb"])).otherwise(acc["state"])
        owner = F.when(outcome != "proceed", acc["owner"]).when(v["verb"] == "claim", v["actor"]).when(v["verb"].isin("release", "force-release"), F.lit(None).cast("string")).otherwise(acc["owner"])
        counts = [(acc[f"n_{o}"] + (outcome == o).cast("int")).alias(f"n_{o}") for o in ("proceed", "idempotent", "reroute", "refuse")]
        return F.struct(state.alias("state"), owner.alias("owner"), *counts)

    return verbs.groupBy("name").agg(F.aggregate(ordered, start, step).alias("r")).select("name", "r.*")


def event_gaps(events: DataFrame) -> DataFrame:
    """name, event_ulid and gap: whether the back-link isn't the event before it."""
    before = F.lag("event_ulid").over(Window.partitionBy("name").orderBy("event_ulid"))
    return events.select("name", "event_ulid", (~before.eqNullSafe(F.col("prev_event_ulid"))).alias("gap"))


def recent(events: DataFrame, n: int = 16) -> DataFrame:
    """The newest n events of each name, with their age rank; each task passes on n of a name at most."""
    newest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("event_ulid")))
    return events.withColumn("rank", newest).where(F.col("rank") <= n).select("name", "event_ulid", "kind", "rank")


def chain(events: DataFrame, n: int = 16) -> DataFrame:
    """The walk over back-links from each name's newest event, n events at most: name, event_ulid, step."""
    step = events.groupBy("name").agg(F.max_by(F.struct("event_ulid", "prev_event_ulid"), "event_ulid").alias("e")).select("name", "e.*", F.lit(0).alias("step"))
    links, out = events.select("name", "event_ulid", F.col("prev_event_ulid").alias("next")), [step]
    for i in range(1, n):
        step = step.select("name", F.col("prev_event_ulid").alias("event_ulid")).join(links, ["name", "event_ulid"]).select("name", "event_ulid", F.col("next").alias("prev_event_ulid"), F.lit(i).alias("step"))
        out.append(step)
    return reduce(DataFrame.unionByName, out).select("name", "event_ulid", "step")


def resolve_caveats(caveats: DataFrame, names: list[str]) -> DataFrame:
    """token_id, and for each name its value, and its resolution: absent, value or unsatisfiable (values that differ)."""
    aggs = []
    for n in names:
        own = F.when(F.col("name") == n, F.col("value"))
        low, high = F.min(own), F.max(own)
        aggs += [F.when(low.isNull(), "absent").when(low == high, "value").otherwise("unsatisfiable").alias(f"{n}_is"), F.when(low == high, low).alias(n)]
    return caveats.groupBy("token_id").agg(*aggs)


def not_after(caveats: DataFrame, name: str = "exp") -> DataFrame:
    """The least time of a token's expiry caveats; values that are no plain number are ignored."""
    return caveats.where(F.col("name") == name).groupBy("token_id").agg(F.min(F.when(F.col("value").rlike(r"\A\+?[0-9]+\z"), F.expr("try_cast(value AS BIGINT)"))).alias("not_after"))


def authorize(caveats: DataFrame, audience: str, role: str, now: int, requested: int, most: int) -> DataFrame:
    """token_id, outcome (the first check that fails, or ok) and ttl (null unless ok)."""
    rows = resolve_caveats(caveats, ["aud", "role"]).join(not_after(caveats), "token_id", "left")
    left = F.least(F.lit(requested), F.lit(most), F.col("not_after") - now)
    outcome = F.when(~(F.col("aud").eqNullSafe(F.lit(audience))), "wrong_audience").when(F.col("role_is") == "absent", "no_role").when(~(F.col("role").eqNullSafe(F.lit(role))), "wrong_role").when(F.col("not_after") <= now, "expired").otherwise("ok")
    return rows.select("token_id", outcome.alias("outcome"), F.when(outcome == "ok", left).cast("long").alias("ttl"))
