"""Unions, deduplication and merges of late or revised data, with an audit of every cell."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.checks import DataContractError, ensure_none, ensure_unique
from tidegrid.functions.scalars import same_cell
from tidegrid.functions.times import between_ts, instant
from tidegrid.operators.joins import missing_keys, new_rows, overlap_conflicts, stored_overlap
from tidegrid.operators.series import RESOLUTION_SECONDS
from tidegrid.session import checkpointed, written

REPAIRED, REVISED, PROTECTED = "repaired", "revised", "protected"


# --- unions -------------------------------------------------------------------

def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def union_strict(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of chunks; any key in more than one row is fatal."""
    return ensure_unique(union_all(frames), list(keys), "Chunks contain duplicate keys")


def union_last(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of chunks; the last chunk wins per key."""
    numbered = union_all([f.withColumn("_chunk", F.lit(i)) for i, f in enumerate(frames)])
    return newest_per(numbered, keys, [F.col("_chunk")]).drop("_chunk")


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of rows and columns, the columns of the first table first."""
    return a.unionByName(b, allowMissingColumns=True)


def newest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the largest order per key, by partial aggregation and no sort."""
    ranked = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("row")))
    return df.groupBy(*keys).agg(ranked.alias("_best")).select("_best.row.*")


def oldest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("row")))
    return df.groupBy(*keys).agg(ranked.alias("_best")).select("_best.row.*")


def vintage_conflicts(df: DataFrame, identity: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Identities whose rows disagree in some value; null counts as a value of its own."""
    facts, differs = [], F.lit(False)
    for c in values:
        facts += [F.min(c).alias(f"_low_{c}"), F.max(c).alias(f"_high_{c}"), F.count(c).alias(f"_n_{c}")]
        partly = (F.col(f"_n_{c}") > 0) & (F.col(f"_n_{c}") < F.col("rows"))
        differs = differs | F.coalesce(F.col(f"_low_{c}") != F.col(f"_high_{c}"), F.lit(False)) | partly
    return (
        df.groupBy(*identity).agg(F.count("*").alias("rows"), *facts).filter(differs).select(*identity, "rows")
    )


def dedupe_vintages(df: DataFrame, identity: Sequence[str], values: Sequence[str],
                    acquired: str = "acquired_at_utc", check: bool = True) -> DataFrame:
    """Equal rows of one identity collapse to the earliest acquisition; differing ones are fatal."""
    if check:
        ensure_none(vintage_conflicts(df, identity, values), "Conflicting values share one identity")
    rest = [F.col(c) for c in df.columns if c not in identity and c != acquired]
    return oldest_per(df, identity, [F.col(acquired), *rest])


# --- merges -------------------------------------------------------------------

class Merge(NamedTuple):
    data: DataFrame
    audit: DataFrame


def merge_strict(stored: DataFrame, incoming: DataFrame, keys: Sequence[str],
                 allow_column_union: bool = False, check: bool = True) -> DataFrame:
    """Stored rows plus unseen incoming rows; overlapping rows must be equal."""
    if not allow_column_union and set(stored.columns) != set(incoming.columns):
        raise DataContractError("Incoming schema does not match the stored schema")
    overlap = stored_overlap(stored, incoming, keys)
    if check:
        overlap = written(overlap)
        ensure_none(overlap_conflicts(overlap, incoming, keys), "Overlapping rows differ")
    return stored.unionByName(new_rows(overlap, incoming, keys), allowMissingColumns=True)


def _merged(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], ts: str, window) -> tuple:
    keys = list(keys)
    columns = [c for c in stored.columns if c not in keys]
    columns += [c for c in incoming.columns if c not in keys and c not in columns]
    types = {**dict(incoming.dtypes), **dict(stored.dtypes)}

    def side(df, name):
        cells = [(F.col(c) if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in columns]
        return df.select(*keys, F.struct(*cells).alias(name))

    joined = side(stored, "_old").join(side(incoming, "_new"), keys, "full_outer")
    overlap = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    inside = between_ts(ts, *window) if window else F.lit(False)
    cells, outcomes = [], []
    for c in columns:
        old, new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        differs = ~same_cell(old, new)
        outcome = (
            F.when(overlap & old.isNull() & new.isNotNull(), REPAIRED)
            .when(overlap & new.isNotNull() & differs & inside, REVISED)
            .when(overlap & new.isNotNull() & differs, PROTECTED)
        )
        value = F.when(F.col("_old").isNull() | outcome.isin(REPAIRED, REVISED), new).otherwise(old)
        cells.append(value.alias(c))
        outcomes.append(outcome.alias(c))
    frame = joined.select(
        *keys, *cells, F.struct(*outcomes).alias("_outcome"), F.col("_old").isNull().alias("_added")
    )
    return frame, columns


def merge_revisions(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *, ts: str = "ts",
                    window: tuple | None = None, retain: bool = False, cut: bool = False) -> Merge:
    """Merge cell by cell: null cells are filled, differing cells inside ``window``
    take the new value, outside it they keep the stored one, unseen keys are added.

    Only stored rows between the first and last time of the delivery are joined;
    a key twice in them, or in the delivery, is fatal. Without ``retain`` a
    differing cell outside the window is fatal. ``cut`` writes the joined rows
    once when both the data and the audit are used.
    """
    if window is not None and isinstance(window[0], str) and window[0] >= window[1]:
        raise DataContractError("The revision window must be positive")
    ensure_unique(incoming, list(keys), "The delivery repeats a key")
    touched = _delivered(incoming, ts)
    held, rest = stored.filter(touched), stored.filter(~touched)  # only the delivered range is joined
    ensure_unique(held, list(keys), "The stored table repeats a key")
    frame, columns = _merged(held, incoming, keys, ts, window)
    if cut or not retain:
        frame = checkpointed(frame)
    if not retain:
        conflict = F.array_contains(F.array(*[F.col(f"_outcome.{c}") for c in columns]), PROTECTED)
        ensure_none(frame.filter(conflict).select(*keys), "Conflicting stored value")
    data = frame.drop("_outcome", "_added").unionByName(rest, allowMissingColumns=True)
    return Merge(data, _audit(frame, columns, ts))


def _delivered(incoming: DataFrame, ts: str) -> Column:
    """Whether a time lies between the first and the last one of a delivery."""
    first, last = incoming.agg(*[F.unix_micros(f(ts).cast("timestamp")) for f in (F.min, F.max)]).first()
    if first is None:
        return F.lit(False)
    return F.coalesce(F.col(ts).between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))), F.lit(False))


def _audit(frame: DataFrame, columns: Sequence[str], ts: str) -> DataFrame:
    """Per column the repaired, revised and protected cells, with the protected time range.

    All counts come from one aggregation to one row; only that row is unpivoted.
    """
    aggregates = [F.count_if("_added").alias("_added")]
    for c in columns:
        outcome = F.col(f"_outcome.{c}")
        guarded = F.when(outcome == PROTECTED, F.col(ts))
        aggregates += [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(outcome == REPAIRED).alias("repaired"),
                F.count_if(outcome == REVISED).alias("revised"),
                F.count_if(outcome == PROTECTED).alias("protected"),
                F.min(guarded).alias("first_protected"), F.max(guarded).alias("last_protected"),
            ).alias(f"_c_{c}")
        ]
    one = frame.agg(*aggregates)
    return one.select(F.col("_added").alias("new_rows"), F.inline(F.array(*[f"_c_{c}" for c in columns])))


def merge_audit(audit: DataFrame) -> DataFrame:
    """One row: new rows, repaired, revised and protected cells, protected time range, changed."""
    total = audit.agg(
        F.max("new_rows").alias("new_rows"), F.sum("repaired").alias("repaired_cells"),
        F.sum("revised").alias("revised_cells"), F.sum("protected").alias("protected_conflicts"),
        F.min("first_protected").alias("first_protected"), F.max("last_protected").alias("last_protected"),
    )
    return total.withColumn(
        "changed", (F.col("new_rows") + F.col("repaired_cells") + F.col("revised_cells")) > 0
    )


def should_rebuild(audit: DataFrame, watermark_before, watermark_after, mode: str = "incremental") -> DataFrame:
    """Whether derived tables must be rebuilt after an incremental run."""
    after, before = instant(watermark_after), instant(watermark_before)
    advanced = after.isNotNull() & (before.isNull() | (after > before))
    return merge_audit(audit).select(
        "new_rows", "repaired_cells", "revised_cells", advanced.alias("watermark_advanced"),
        (F.col("changed") | advanced | F.lit(mode != "incremental")).alias("rebuild"),
    )


def label_conflicts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str],
                    label: str = "resolution") -> DataFrame:
    """Unknown resolution labels, and keys whose labels contradict each other."""
    def unknown(df, side):
        return df.filter(F.col(label).isNotNull() & ~F.col(label).isin(*RESOLUTION_SECONDS)).select(
            *keys, F.lit(f"unknown_{side}").alias("reason"))

    both = stored.select(*keys, F.col(label).alias("_old")).join(
        incoming.select(*keys, F.col(label).alias("_new")), list(keys))
    changed = both.filter(F.col("_old") != F.col("_new")).select(*keys, F.lit("label_conflict").alias("reason"))
    return unknown(stored, "stored").unionByName(unknown(incoming, "incoming")).unionByName(changed)


def merge_prices(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *, ts: str = "ts",
                 window: tuple, label: str = "resolution", check: bool = True, cut: bool = False) -> Merge:
    """As ``merge_revisions``; resolution labels may be filled but never changed."""
    if label in incoming.columns and label not in stored.columns:
        stored = stored.withColumn(label, F.lit(None).cast("string"))
    if check and label in stored.columns and label in incoming.columns:
        ensure_none(label_conflicts(stored, incoming, keys, label), "Resolution labels contradict")
    return merge_revisions(stored, incoming, keys, ts=ts, window=window, retain=True, cut=cut)


def repair_interval(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], start: str, end: str,
                    *, ts: str = "ts", check: bool = True) -> Merge:
    """Fill null cells of at most seven days: no new keys, no new columns, no changed value."""
    days = (_date(end) - _date(start)).total_seconds() / 86400
    if not 0 < days <= 7:
        raise DataContractError("A repair interval must be positive and at most seven days")
    inside = between_ts(ts, start, end)
    held, rest = stored.filter(inside), stored.filter(~inside)  # only the interval is joined
    known = [c for c in stored.columns if c in incoming.columns]
    usable = incoming.select(*known).join(held.select(*keys), list(keys), "left_semi")
    frame, columns = _merged(held, usable, keys, ts, None)
    if check:
        frame = checkpointed(frame)
        conflict = F.array_contains(F.array(*[F.col(f"_outcome.{c}") for c in columns]), PROTECTED)
        ensure_none(frame.filter(conflict).select(*keys), "A repair cannot change a stored value")
    data = rest.unionByName(frame.drop("_outcome", "_added"))
    return Merge(data, _audit(frame, columns, ts))


def _date(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def repair_violations(stored: DataFrame, incoming: DataFrame, allowed: DataFrame, expected: DataFrame,
                      keys: Sequence[str]) -> DataFrame:
    """What forbids a row repair: gaps in the delivery, changed overlap, keys not approved."""
    def tag(df, reason):
        return df.select(*keys, F.lit(reason).alias("reason"))

    gaps = tag(missing_keys(expected, incoming, keys), "delivery_incomplete")
    extra = tag(missing_keys(incoming, expected, keys), "delivery_outside_interval")
    changed = tag(overlap_conflicts(stored, incoming, keys), "stored_value_differs")
    unapproved = tag(missing_keys(new_rows(stored, incoming, keys), allowed, keys), "key_not_approved")
    return gaps.unionByName(extra).unionByName(changed).unionByName(unapproved)


def repair_rows(stored: DataFrame, incoming: DataFrame, allowed: DataFrame, expected: DataFrame,
                keys: Sequence[str], check: bool = True) -> DataFrame:
    """Add approved missing rows of a complete delivery; a second run adds nothing."""
    if check:
        ensure_none(repair_violations(stored, incoming, allowed, expected, keys), "Repair refused")
    added = new_rows(stored, incoming, keys).join(allowed.select(*keys), list(keys), "left_semi")
    return stored.unionByName(added)


