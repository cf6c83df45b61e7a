"""Column expressions of the engine: kinds, sizes, names, tags, ownership and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
INLINE_BYTES, BLOCK_BYTES = 256, 4096
FRESH_S, RETENTION_S = 60, 600
UNKNOWN_OWNER = "<unknown>"
RESERVED_NAMES = ("status", "attach")
UNITS = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def has_body(kind: Column) -> Column:
    return kind.isin("data", "inline", "canonical_data", "canonical_inline")


def claims_blocks(kind: Column) -> Column:
    return ~kind.isin("canonical_data", "canonical_inline")


def body_kind(stored_length: Column) -> Column:
    return F.when(stored_length < INLINE_BYTES, "inline").otherwise("data")


def valid_write(size: Column, most: int = 1 << 25) -> Column:
    return (size > 0) & (size % BLOCK_BYTES == 0) & (size <= most)


def size_literal(text: Column) -> Column:
    """Bytes of `4G`, `4GB`, `512 M` or a plain number, blanks around it or not; null for anything else and beyond 63 bits."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^\+?([0-9]+)\s*(?:([KMGT])B?)?$", i)
    factor = F.lit(1).cast("decimal(20,0)")
    for u, n in UNITS.items():
        factor = F.when(part(2) == u, F.lit(n).cast("decimal(20,0)")).otherwise(factor)
    return F.when(part(1) != "", (part(1).try_cast("decimal(18,0)") * factor).try_cast("long"))


def valid_name(name: Column) -> Column:
    """Letters and digits of ASCII, dots, underscores and hyphens, at least one; not a reserved word."""
    return F.coalesce(name.rlike(r"\A[a-zA-Z0-9._-]+\z") & ~name.isin(*RESERVED_NAMES), F.lit(False))


def ownership(state: Column, owner: Column, me: Column) -> Column:
    """Where a name stands for this coordinator: absent (no record: a null state), mine, other, released or readonly. Of a live or
    stopped name the owner counts, and a null owner is someone unknown."""
    held = F.when(owner == me, "mine").otherwise("other")
    return F.when(state.isNull(), "absent").when(state.isin("live", "stopped"), held).otherwise(state)


def owner_name(state: Column, owner: Column) -> Column:
    """The owner of a live or stopped name, a stand-in where none is recorded; null for other states."""
    return F.when(state.isin("live", "stopped"), F.coalesce(owner, F.lit(UNKNOWN_OWNER)))


def eligibility(state: Column, owner: Column, me: Column) -> Column:
    """Whether a name may be claimed: owned, foreign, released-claimable or readonly."""
    held = F.when(owner == me, "owned").otherwise("foreign")
    return F.when(state.isin("live", "stopped"), held).when(state == "released", "released-claimable").otherwise(state)


def role(position: Column) -> Column:
    """none, owner or observer, by the position of ownership()."""
    return F.when(position == "absent", "none").when(position == "mine", "owner").otherwise("observer")


def marker_action(state: Column, owner: Column, me: Column, stopped: Column, released: Column) -> Column:
    """What brings a volume's local markers in line with its record: comma-joined steps, empty for none. Nothing is done for names
    of others, but a released name has no owner and counts everywhere."""
    steps = lambda *pairs: F.concat_ws(",", *(F.when(when, step) for when, step in pairs))
    found = F.when(state == "live", steps((stopped, "remove stopped"), (released, "remove released")))
    found = found.when(state == "stopped", steps((~stopped, "write stopped"), (released, "remove released")))
    found = found.when(state == "released", steps((~released, "write released"), (stopped, "remove stopped")))
    return F.when((state == "released") | F.coalesce(owner == me, F.lit(False)), F.coalesce(found, F.lit(""))).otherwise("")


def size_text(size: Column) -> Column:
    """Bytes in the largest binary unit that they fill."""
    shown = lambda unit, digits: F.replace(F.format_number(size / unit, digits), F.lit(","), F.lit(""))
    return (
        F.when(size >= 1 << 30, F.concat(shown(1 << 30, 2), F.lit(" GiB")))
        .when(size >= 1 << 20, F.concat(shown(1 << 20, 1), F.lit(" MiB")))
        .when(size >= 1 << 10, F.concat(shown(1 << 10, 1), F.lit(" KiB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def snapshot_file(name: Column) -> tuple[Column, Column]:
    """Id and kind (stop or user) of a snapshot's file name; null for other names. Ids are 26 characters of Crockford's base 32."""
    part = lambda i: F.regexp_extract(name, r"\A([0-7][0-9A-HJKMNP-TV-Z]{25})(-stop)?\.manifest\z", i)
    known = part(1) != ""
    return F.when(known, part(1)), F.when(known, F.when(part(2) != "", "stop").otherwise("user"))


def fresh(issued: Column, now: Column) -> Column:
    return F.abs(issued - now) <= FRESH_S


def expired(since: Column, now: Column, retention: int = RETENTION_S) -> Column:
    return since + retention <= now


def lifecycle(markers: dict[str, Column]) -> Column:
    """The first marker present, in this order; stopped if none is."""
    out = F.lit("stopped")
    for name in reversed(("fetched", "released", "readonly", "stopped", "importing", "running")):
        if name in markers:
            out = F.when(markers[name], name).otherwise(out)
    return out


def segment_flags(wal_flags: Column) -> Column:
    """Segment bits for the log's bits (compressed 1 to 4, reference 2 to 8, zero 4 to 16)."""
    bit = lambda b, to: F.when(wal_flags.bitwiseAND(b) != 0, to).otherwise(0)
    return bit(1, 4) + bit(2, 8) + bit(4, 16)
