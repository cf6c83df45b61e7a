"""Records and tokens: reading them strictly, checking who may do what, and what a recovery makes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.lineage import MOST_DEPTH

# Fixed values of the text form of a segment head.
SECTIONS = ("added", "superseded", "tombstoned")


def parse_heads(bodies: DataFrame) -> DataFrame:
    """Strict reading of head texts (id, body): id, section, entry and error. A body with an unknown line, a section twice, or a
    section missing gives one row with the error alone. `anchor: x` stands on a line; the other sections begin with
    `name:` and have an indented entry a line. A body is one row's text; its lines are told apart in the JVM."""
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("at", "line")).where("line <> ''")
    header = F.regexp_extract("line", r"^(added|superseded|tombstoned):$", 1)
    marked = lines.withColumn("section", F.when(header != "", header).when(F.col("line").startswith("anchor: "), "anchor"))
    order = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumns({"inside": F.last("section", ignorenulls=True).over(order), "is_entry": F.col("section").isNull()})
    bad = F.col("is_entry") & (~F.col("line").startswith("  ") | F.col("inside").isNull() | (F.col("inside") == "anchor"))
    found = rows.groupBy("id").agg(F.count_if(bad).alias("unknown"), *(F.count_if(F.col("section") == s).alias(s) for s in ("anchor", *SECTIONS)))
    error = F.when(F.col("unknown") > 0, "unknown line")
    for s in ("anchor", *SECTIONS):
        error = error.when(F.col(s) > 1, "duplicate section")
    for s in ("anchor", *SECTIONS):
        error = error.when(F.col(s) == 0, f"missing section {s}")
    judged = bodies.select("id").join(found, "id", "left").select("id", F.when(F.col("unknown").isNull(), "missing section anchor").otherwise(error).alias("error"))
    entries = rows.where(F.col("is_entry") | (F.col("section") == "anchor")).select("id", F.col("inside").alias("section"), F.regexp_replace("line", "^(  |anchor: )", "").alias("entry"))
    good = entries.join(judged.where("error IS NULL").select("id"), "id", "left_semi").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(judged.where("error IS NOT NULL").select("id", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("entry"), "error"))


def read_status(version: Column, current: int, at_ms: Column | None = None, id_ms: Column | None = None) -> Column:
    """ok, unsupported_version or timestamp_mismatch of a record; a null version counts as 0."""
    out = F.when(F.coalesce(version, F.lit(0)) != current, "unsupported_version")
    return (out.when(~at_ms.eqNullSafe(id_ms), "timestamp_mismatch") if at_ms is not None else out).otherwise("ok")


def ascending(ids: Column) -> Column:
    """Whether an array of ids is strictly ascending, as a manifest's must be."""
    return ids == F.array_sort(F.array_distinct(ids))


def before_first_bad(rows: DataFrame, key: str, order: str, bad: Column) -> DataFrame:
    """The rows of each key before its first bad one: what a scan of a file accepts."""
    first = rows.groupBy(key).agg(F.min(F.when(bad, F.col(order))).alias("first_bad"))
    return rows.join(first, key).where(F.col("first_bad").isNull() | (F.col(order) < F.col("first_bad"))).drop("first_bad")


def ancestry_errors(lineage: DataFrame) -> DataFrame:
    """volume_id, met_again: volumes whose chain of parents comes back to a volume that it has passed, and that volume. Chains of over
    MOST_DEPTH steps without a return are refused with ValueError."""
    edges = lineage.select(F.col("child_id").alias("layer"), "parent_id")
    step = lineage.select("child_id").union(lineage.select("parent_id")).distinct().select(F.col("child_id").alias("volume_id"), F.col("child_id").alias("layer"), F.array("child_id").alias("path"))
    out = []
    for _ in range(MOST_DEPTH):
        step = step.join(edges, "layer").select("volume_id", F.col("parent_id").alias("layer"), "path")
        if step.isEmpty():
            break
        out.append(step.where(F.array_contains("path", F.col("layer"))).select("volume_id", F.col("layer").alias("met_again")))
        step = step.where(~F.array_contains("path", F.col("layer"))).withColumn("path", F.concat("path", F.array("layer")))
    else:
        raise ValueError("an ancestry is too deep")
    return reduce(DataFrame.unionByName, out) if out else step.select("volume_id", F.col("layer").alias("met_again"))


def extent_sources(layers: DataFrame, sources: DataFrame) -> DataFrame:
    """volume_id, source_id, snapshot: the extent sources of a volume and all its ancestors, each at the latest snapshot that any
    of them names. layers: see lineage.layers; sources: volume_id, source_id, snapshot."""
    named = sources.select(F.col("volume_id").alias("layer_volume_id"), "source_id", "snapshot")
    return layers.join(named, "layer_volume_id").groupBy("volume_id", "source_id").agg(F.max("snapshot").alias("snapshot"))


def missing_in_ancestors(layers: DataFrame, manifests: DataFrame, present: DataFrame) -> DataFrame:
    """volume_id, layer_volume_id, segment_id: segments that the manifest an ancestor was branched at lists and its index lacks."""
    listed = manifests.select(F.col("volume_id").alias("layer_volume_id"), F.col("snap_id").alias("cutoff"), "segment_id")
    there = present.select(F.col("volume_id").alias("layer_volume_id"), "segment_id").distinct()
    return layers.where("depth > 0").join(listed, ["layer_volume_id", "cutoff"]).join(there, ["layer_volume_id", "segment_id"], "left_anti").select("volume_id", "layer_volume_id", "segment_id")


def first_refusal(caveats: DataFrame, checks: dict[str, Column], needed: list[tuple[str, str]], key: str = "token_id") -> DataFrame:
    """key and outcome: the reason of the first caveat (by pos) that fails, else of the first needed name that is missing, else ok.
    checks: by name the reason column, null where the caveat holds; a caveat of no known name fails with `unknown caveat`."""
    reason = F.lit("unknown caveat")
    for name, check in checks.items():
        reason = F.when(F.col("name") == name, check).otherwise(reason)
    first = F.min(F.when(reason.isNotNull(), F.struct("pos", reason.alias("reason")))).alias("first")
    rows = caveats.groupBy(key).agg(first, *(F.max(F.col("name") == n).alias(f"has_{n}") for n, _ in needed))
    outcome = F.when(F.col("first").isNotNull(), F.col("first.reason"))
    for n, missing in needed:
        outcome = outcome.when(~F.col(f"has_{n}"), missing)
    return rows.select(key, outcome.otherwise("ok").alias("outcome"))


def admit(requests: DataFrame, names: DataFrame, lineage: DataFrame, now: int, window_s: int = 60) -> DataFrame:
    """request_id and outcome: the first step that a peer's request fails (stale, bad_signature, not_current_claimer,
    outside_lineage), or ok. names: name, state, owner; lineage: the volumes that this peer can show a chain for."""
    records = names.select("name", "state", "owner")
    rows = requests.join(records, "name", "left").join(lineage.select("volume_id", F.lit(True).alias("served")).distinct(), "volume_id", "left")
    claims = F.coalesce(F.col("state").isin("live", "stopped") & (F.col("owner") == F.col("coordinator")), F.lit(False))
    outcome = F.when(F.abs(F.col("issued") - now) > window_s, "stale").when(~F.col("signed"), "bad_signature").when(~claims, "not_current_claimer").when(F.col("served").isNull(), "outside_lineage").otherwise("ok")
    return rows.select("request_id", outcome.alias("outcome"))


def signature_status(signature: Column, key: Column, expected: Column) -> Column:
    """valid, invalid, missing or key_unavailable; without a key nothing else is looked at."""
    return F.when(key.isNull(), "key_unavailable").when(signature.isNull(), "missing").when(signature == expected, "valid").otherwise("invalid")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with each `{{name}}` replaced; null if a value is missing or a name is not among the values."""
    out, missing = template, F.lit(False)
    for name, value in values.items():
        mark = "{{" + name + "}}"
        missing = missing | (F.contains(template, F.lit(mark)) & value.isNull())
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    return F.when(~missing & ~F.contains(out, F.lit("{{")), out)


def put_if(objects: DataFrame, puts: DataFrame) -> DataFrame:
    """key, seq and outcome of conditional writes: without an expected version the key must be new, else it must have that version.
    Of the puts of a key the first one (by seq) that meets what stands there is written; the others find it changed."""
    rows = puts.join(objects.select("key", "version"), "key", "left")
    fits = F.when(F.col("expects").isNull(), F.col("version").isNull()).otherwise(F.coalesce(F.col("expects") == F.col("version"), F.lit(False)))
    first = F.min(F.when(F.col("fits"), F.col("seq"))).over(Window.partitionBy("key"))
    rows = rows.withColumn("fits", fits).withColumn("first", first)
    outcome = F.when(F.col("fits") & (F.col("seq") == F.col("first")), "written").when(F.col("expects").isNull(), "already_exists").otherwise("precondition_failed")
    return rows.select("key", "seq", outcome.alias("outcome"))


def serve(ranges: DataFrame, missing: DataFrame) -> DataFrame:
    """What a peer answers to byte ranges (request_id, segment, first, last) of bodies, by the first missing stretch (segment,
    gap_start, gap_end) that meets the range: status 200, 206 or 404, bytes served by the peer and left for the store. Segments
    have a bounded number of gaps."""
    rows = ranges.join(missing, "segment", "left")
    meets = (F.col("gap_start") <= F.col("last")) & (F.col("gap_end") > F.col("first"))
    rows = rows.groupBy("request_id", "first", "last").agg(F.min(F.when(meets, F.greatest(F.col("gap_start") - F.col("first"), F.lit(0)))).alias("until"))
    size = F.col("last") - F.col("first") + 1
    covered = F.coalesce("until", size)
    status = F.when(covered == 0, 404).when(covered == size, 200).otherwise(206)
    return rows.select("request_id", status.alias("status"), covered.alias("from_peer"), (size - covered).alias("from_store"))
