"""Bitemporal history of entity attributes by sweep-line (problem 6)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the result that one Arrow batch holds.
BATCH = 20_000


def _sweep(n_attributes: int):
    """The sweep over one partition, sorted by entity and recorded time; holds one entity's timeline at a time."""

    def emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, entity = None, [], None
        dates: list = []  # valid dates known so far, in order
        given: list[tuple] = []  # what was delivered for each date; None: not delivered
        held: list[tuple] = []  # state that holds from each date on, with nulls filled from the date before
        since: list = []  # recorded time from which the row of each date is believed

        def row(i: int, until) -> tuple:
            ends = dates[i + 1] if i + 1 < len(dates) else None
            starts = i == 0 or held[i] != held[i - 1]
            return (entity, dates[i], ends, since[i], until, *held[i], starts)

        def fill(i: int) -> tuple:
            before = held[i - 1] if i else (None,) * n_attributes
            return tuple(b if a is None else a for a, b in zip(given[i], before, strict=True))

        for batch in batches:
            if schema is None:
                e, d, r, *attrs = batch.schema
                schema = pa.schema(
                    [("entity", e.type), ("valid_from", d.type), ("valid_to", d.type), ("recorded_from", r.type), ("recorded_to", r.type)]
                    + [(f"v{i}", f.type) for i, f in enumerate(attrs)]
                    + [("starts_version", pa.bool_())]
                )
            for who, day, told, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if who != entity:
                    out += [row(i, None) for i in range(len(dates))]
                    entity, dates, given, held, since = who, [], [], [], []
                i = bisect_left(dates, day)
                new = tuple(values)
                if i < len(dates) and dates[i] == day:
                    if given[i] == new:
                        continue
                    given[i] = new
                else:
                    if i:  # the interval that held on this day ends earlier from now on
                        if since[i - 1] != told:
                            out.append(row(i - 1, told))
                        since[i - 1] = told
                    dates.insert(i, day)
                    given.insert(i, new)
                    held.insert(i, None)
                    since.insert(i, told)
                while i < len(dates) and (state := fill(i)) != held[i]:
                    if held[i] is not None and since[i] != told:
                        out.append(row(i, told))
                    held[i], since[i] = state, told
                    i += 1
                if len(out) >= BATCH:
                    yield emit(out, schema)
                    out = []
        if schema is not None:
            out += [row(i, None) for i in range(len(dates))]
            if out:
                yield emit(out, schema)

    return run


def bitemporal_ledger(rows: DataFrame, entity: str, valid: str, recorded: str, attributes: list[str], tie: str | None = None) -> DataFrame:
    """What was believed, when, about each entity's attributes in each period.

    Result: entity, valid_from, valid_to (exclusive, null: open), recorded_from, recorded_to (exclusive, null: still believed),
    the attributes, and starts_version, true where the attributes differ from the period before.

    Deliveries are swept in recorded order. One for a day inside a known period splits it: the old row is closed at the
    recorded time and its parts are entered anew, never overwritten. A null attribute was not delivered and keeps the last known
    value; of the deliveries for one entity and day the one recorded last counts (of equal times the one with the
    largest `tie`), and a correction reaches the later periods that had filled a null from it. Rows with a null entity or
    valid day are left out; a null recorded time is the earliest; repeated rows change nothing; an empty input gives an
    empty result; other columns are ignored. The still believed rows are those with recorded_to null.

    Deliveries that repeat the one before for the same entity and day are dropped before rows are placed by entity, so an entity
    with very many redeliveries sends only its changes to one task; that task streams them in order and holds
    no more than the entity's distinct days.
    """
    order = [F.col("recorded").asc_nulls_first()] + ([F.col("tie")] if tie else [])
    values = [f"v{i}" for i in range(len(attributes))]
    told = rows.where(F.col(entity).isNotNull() & F.col(valid).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(valid).alias("valid"), F.col(recorded).alias("recorded"), *[F.col(a).alias(v) for a, v in zip(attributes, values, strict=True)], *([F.col(tie).alias("tie")] if tie else [])
    )
    same_day = Window.partitionBy("entity", "valid").orderBy(*order)
    state = F.struct(*values)
    changes = told.withColumn("before", F.lag(state).over(same_day)).where(F.col("before").isNull() | ~F.col("before").eqNullSafe(state))
    ordered = changes.repartition("entity").sortWithinPartitions("entity", *order, "valid").select("entity", "valid", "recorded", *values)
    kinds = dict(ordered.dtypes)
    schema = f"entity {kinds['entity']}, valid_from {kinds['valid']}, valid_to {kinds['valid']}, recorded_from {kinds['recorded']}, recorded_to {kinds['recorded']}, " + "".join(f"{v} {kinds[v]}, " for v in values) + "starts_version boolean"
    ledger = ordered.mapInArrow(_sweep(len(attributes)), schema)
    return ledger.withColumnsRenamed({"entity": entity} | dict(zip(values, attributes, strict=True)))


def comparable(column: str) -> F.Column:
    """Text without outer blanks and case, runs of white space as one blank; blank text is null."""
    c = F.lower(F.trim(F.regexp_replace(F.col(column), r"(?U)\s+", " ")))
    return F.when(c != "", c)


def vendor_ledger(snapshots: DataFrame) -> DataFrame:
    """The ledger of vendor_snapshots, its values brought into comparable form; bank numbers have four digits again."""
    bank = comparable("bank_account_last4")
    rows = snapshots.select(
        "vendor_id", "snapshot_date", "loaded_at", "snapshot_id",
        comparable("address").alias("address"), F.when(F.length(bank) < 4, F.lpad(bank, 4, "0")).otherwise(bank).alias("bank_account_last4"), comparable("contact_person").alias("contact_person"),
    )
    return bitemporal_ledger(rows, "vendor_id", "snapshot_date", "loaded_at", ["address", "bank_account_last4", "contact_person"], "snapshot_id")
