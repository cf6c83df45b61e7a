"""URL filters as a sort-merge range join, in DataFrame operations only.

Canonical key of a host: its labels reversed, each followed by a dot. A rule's host and all its subdomains are then one
interval of keys, and the intervals nest or are disjoint. A sorted sweep over keys holds, at each place, the stack of
active nested rule hosts. Where a host has several paths, a second sweep over (host, path) does the same for path prefixes,
so a stack is never longer than a host has labels or a path has rules that are prefixes of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import nested, staged, unnested

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased) and path (then up to `?`, `#` or the end).

    Both are empty if the url is null or has no `://`.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER), path


def canonical(host: Column) -> Column:
    """Labels reversed, each followed by a dot; the empty host has the key `.`."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, keep: list[Column], url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """`keep` columns, host, path, rule (host and path of the rule; null without one) and verdict for every page row. A kept
    column with one of these names is left out. No pages give no rows; without rules every url has the default.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's; of those
    that fit, the longest (host and path together) wins, of equally long ones the one with the longer host, and of several
    verdicts for one rule `block`. Rules with a null host or path are ignored.
    The empty host of a rule fits only urls without a host. Without a rule, the verdict is `default`.

    Pages are dealt over `salts` sweeps at random (their rows in order, so one hot host is spread over all of them), and each
    sweep merges its share of the pages with all rules by sorting, so neither side has to fit in memory.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    kept = pages.select(nested(keep), host.alias("_host"), path.alias("_path"))
    # row numbers are written down: counted anew after a lost executor they might name other rows
    urls = staged(kept.withColumn("_row", F.monotonically_increasing_id()), "urls").withColumn("_salt", (F.col("_row") % salts).cast("int"))
    urls = urls.withColumn("_key", canonical(F.col("_host")))

    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    known = known.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max(F.coalesce("verdict", F.lit(default)) == "block").alias("blocks"))
    known = known.select("host", "path", F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"), canonical(F.col("host")).alias("key"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    # first sweep: the innermost rule host that opened last, with the stack of rule hosts that it is nested in
    hosts = known.select("key").distinct()
    labels = F.split(F.col("key"), r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    outer = hosts.select("key", F.explode(prefixes).alias("outer"))
    stacks = outer.join(hosts.select(F.col("key").alias("outer")), "outer").groupBy("key").agg(F.collect_list("outer").alias("stack"))
    opened = stacks.select(F.col("key").alias("_key"), "stack", every.alias("_salt"))
    sweep = Window.partitionBy("_salt").orderBy("_key", "_is_url").rowsBetween(Window.unboundedPreceding, 0)
    merged = urls.withColumn("_is_url", F.lit(1)).unionByName(opened.withColumn("_is_url", F.lit(0)), allowMissingColumns=True)
    at_urls = merged.withColumn("_stack", F.last("stack", ignorenulls=True).over(sweep)).where("_is_url = 1").drop("stack", "_is_url")
    active = F.filter(F.coalesce("_stack", F.array().cast("array<string>")), lambda k: F.col("_key").startswith(k))
    at_urls = at_urls.withColumn("_active", active).drop("_stack")

    # second sweep: among the paths of each active host, the rule path that opened last and the stack it is nested in
    by_host = Window.partitionBy("key")
    paths = known.withColumn("sizes", F.collect_set(F.length("path")).over(by_host))
    shorter = paths.select("key", "path", F.explode(F.expr("filter(sizes, n -> n <= length(path))")).alias("n"))
    shorter = shorter.select("key", "path", F.expr("left(path, n)").alias("outer"))
    entry = F.struct(F.col("outer"), F.col("verdict"), F.col("host"))
    stacked = shorter.join(known.select("key", F.col("path").alias("outer"), "verdict", "host"), ["key", "outer"]).groupBy("key", "path").agg(F.collect_list(entry).alias("entries"))
    starts = stacked.select(F.col("key").alias("_at"), F.col("path").alias("_path"), "entries", every.alias("_salt"))
    asked = at_urls.where(F.size("_active") > 0).select("_row", "_salt", "_path", F.explode("_active").alias("_at"))
    along = Window.partitionBy("_salt", "_at").orderBy("_path", "_is_url").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.withColumn("_is_url", F.lit(1)).unionByName(starts.withColumn("_is_url", F.lit(0)), allowMissingColumns=True)
    hit = both.withColumn("_entries", F.last("entries", ignorenulls=True).over(along)).where("_is_url = 1")
    fits = F.filter("_entries", lambda e: F.col("_path").startswith(e["outer"]))
    longest = F.array_max(F.transform(fits, lambda e: F.struct(F.length(e["host"]) + F.length(e["outer"]), F.length(e["host"]).alias("h"), F.concat(e["host"], e["outer"]).alias("rule"), e["verdict"].alias("verdict"))))
    best = hit.select("_row", longest.alias("_best")).where("_best is not null").groupBy("_row").agg(F.max("_best").alias("_best"))

    out = at_urls.join(best, "_row", "left")
    out = out.select("_kept", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
    return unnested(out, ["host", "path", "rule", "verdict"])
