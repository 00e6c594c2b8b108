"""Trailing windows, neighbours and as-of lookups that survive hot keys.

A window partitioned by account puts one account into one task, and a sliding RANGE
frame re-reads its whole frame for every row. Neither holds when one account owns a
third of all rows, so everything here is built from two parts:

* **Fragments.** ``find_hot`` counts rows per key. Keys with more than ``hot_rows`` rows
  are cut into equal-width time fragments; every other key stays one fragment, and when
  no key is hot the plan has no fragment logic at all. What a fragment needs from the
  fragments before it (a total, the last row) is computed on the small per-fragment
  table and travels as one extra *carry* row, so no join back is needed. Only this path
  reads its input twice, so only there the input is written to the checkpoint folder.
* **Growing frames.** A trailing window is a running total in which each row enters at
  ``t`` and leaves at ``t + w``. Running totals only grow, which Spark evaluates in one
  pass per fragment, for any number of windows over one sort.

Times are integer microseconds; totals are integers (money in 1/10000), so that results
do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import cut

HOT_ROWS = 1_000_000
FRAGMENT_ROWS = 200_000
BROADCAST_KEYS = 1_000_000
MONEY_SCALE = 10_000
FIRST = -(2**62)


def money_units(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * MONEY_SCALE).cast("long")


def find_hot(
    df: DataFrame, keys: list[str], t: str, hot_rows: int = HOT_ROWS, fragment_rows: int = FRAGMENT_ROWS
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and the fragment width for each, or None.

    Runs one counting job. There can be at most ``rows / hot_rows`` such keys, a million
    in 10^12 rows; ``_fragmented`` counts them before it broadcasts.
    """
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    width = F.ceil((F.col("_hi") - F.col("_lo") + 1) * F.lit(float(fragment_rows)) / F.col("_n"))
    hot = stats.filter(F.col("_n") > hot_rows).select(
        *keys, "_lo", F.greatest(F.lit(1), width).cast("long").alias("_width")
    )
    return None if hot.isEmpty() else cut(hot)


def _fragmented(rows: DataFrame, hot: DataFrame | None, t: str) -> DataFrame:
    if hot is None:
        return rows
    keys = [c for c in hot.columns if c not in ("_lo", "_width")]
    side = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    return (
        rows.join(side, keys, "left")
        .withColumn("_hot", F.col("_width").isNotNull())
        .withColumn("_frag", F.coalesce(F.floor((F.col(t) - F.col("_lo")) / F.col("_width")), F.lit(0)))
        .drop("_lo", "_width")
    )


def _resolve(events: DataFrame, keys: list[str], t: str, hot: DataFrame | str | None):
    """The hot keys, the rows to read, and the partition columns."""
    hot = find_hot(events, keys, t) if isinstance(hot, str) else hot
    return (None, events, list(keys)) if hot is None else (hot, cut(events), [*keys, "_frag"])


def trailing(
    events: DataFrame,
    keys: list[str],
    t: str,
    measures: Mapping[str, Column],
    windows: Mapping[str, int],
    *,
    order: str | None = None,
    counted: str | None = None,
    open_windows: Mapping[str, int] | None = None,
    hot: DataFrame | str | None = "auto",
) -> DataFrame:
    """Add ``<measure>_<window>``: the sum of an integer measure over ``[t - w, t]``.

    ``windows`` maps a label to seconds (closed at both ends); ``open_windows`` leave out
    events exactly ``w`` old. Rows with the same ``t`` see each other. With ``order`` (a
    unique id) the previous time of the key is added as ``prev_t``; with the boolean column
    ``counted`` only rows where it holds are previous ones.
    """
    hot, events, part = _resolve(events, keys, t, hot)
    spans = {k: (int(v * 1_000_000) + 1) for k, v in windows.items()}
    spans |= {k: int(v * 1_000_000) for k, v in (open_windows or {}).items()}
    shifts = sorted(set(spans.values()))
    payload = [c for c in events.columns if c not in keys]
    enters = F.col("_shift") == 0
    deltas = [(f"{m}_{w}", c, span) for m, c in measures.items() for w, span in spans.items()]
    moved = (
        events.select("*", *[c.cast("long").alias(f"_m_{m}") for m, c in measures.items()])
        .withColumn("_shift", F.explode(F.array(*[F.lit(s).cast("long") for s in [0, *shifts]])))
        .select(
            *keys,
            (F.col(t) + F.col("_shift")).alias("_t"),
            enters.alias("_own"),
            *[F.when(enters, F.col(c)).alias(c) for c in payload],
            *[
                F.when(enters, F.col(f"_m_{m}"))
                .when(F.col("_shift") == spans[w], -F.col(f"_m_{m}"))
                .otherwise(F.lit(0).cast("long"))
                .alias(f"{m}_{w}")
                for m in measures
                for w in spans
            ],
        )
    )
    rows = _fragmented(moved, hot, "_t")
    sums = [name for name, _, _ in deltas]
    if hot is not None:
        rows = rows.unionByName(_totals_before(rows, keys, sums, t if order else None, counted), allowMissingColumns=True)
    within = Window.partitionBy(*part)
    if order:
        before = within.orderBy("_t", order).rowsBetween(Window.unboundedPreceding, -1)
        seen = F.when(F.col("_own") & F.col(counted) if counted else F.col("_own"), F.col(t))
        seen = seen if hot is None else F.coalesce(seen, F.col("_carry_t"))
        rows = rows.withColumn("prev_t", F.last(seen, ignorenulls=True).over(before))
    upto = within.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        *keys, *payload, "_own", *([F.col("prev_t")] if order else []), *[F.sum(s).over(upto).alias(s) for s in sums]
    )
    return rows.filter("_own").drop("_own")


def _totals_before(rows: DataFrame, keys: list[str], sums: list[str], t: str | None, counted: str | None = None) -> DataFrame:
    """One carry row per fragment of a hot key: totals (and last time) of all earlier fragments."""
    aggs = [F.sum(s).alias(s) for s in sums]
    if t:
        aggs.append(F.max(F.when(F.col("_own") & F.col(counted) if counted else F.col("_own"), F.col(t))).alias("_carry_t"))
    table = rows.filter("_hot").groupBy(*keys, "_frag").agg(*aggs)
    earlier = Window.partitionBy(*keys).orderBy("_frag").rowsBetween(Window.unboundedPreceding, -1)
    out = [*keys, "_frag", F.lit(FIRST).cast("long").alias("_t"), F.lit(False).alias("_own"), F.lit(True).alias("_hot")]
    out += [F.coalesce(F.sum(s).over(earlier), F.lit(0).cast("long")).alias(s) for s in sums]
    if t:
        out.append(F.max("_carry_t").over(earlier).alias("_carry_t"))
    return table.select(*out)


RUNNING = {"sum": F.sum, "min": F.min, "max": F.max}


def running(rows: DataFrame, keys: list[str], t: str, measures: Mapping[str, tuple[str, Column]], *, hot: DataFrame | str | None = "auto") -> DataFrame:
    """Add each measure, a (``sum``, ``min`` or ``max``, column) pair, over all rows of the key up to and including time ``t``.

    Nulls are left out. Earlier fragments of a hot key arrive as one carry row a fragment.
    """
    hot, rows, part = _resolve(rows, keys, t, hot)
    payload = rows.columns
    valued = _fragmented(rows.select("*", *[c.alias(f"_v_{m}") for m, (_, c) in measures.items()]).withColumn("_own", F.lit(True)), hot, t)
    if hot is not None:
        earlier = Window.partitionBy(*keys).orderBy("_frag").rowsBetween(Window.unboundedPreceding, -1)
        table = valued.filter("_hot").groupBy(*keys, "_frag").agg(*[RUNNING[how](f"_v_{m}").alias(f"_v_{m}") for m, (how, _) in measures.items()])
        carried = table.select(*keys, "_frag", F.lit(FIRST).cast("long").alias(t), F.lit(False).alias("_own"), *[RUNNING[how](f"_v_{m}").over(earlier).alias(f"_v_{m}") for m, (how, _) in measures.items()])
        valued = valued.unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy(*part).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return valued.select("_own", *payload, *[RUNNING[how](f"_v_{m}").over(upto).alias(m) for m, (how, _) in measures.items()]).filter("_own").drop("_own")


def neighbours(
    df: DataFrame, keys: list[str], t: str, order: str, cols: list[str], *, hot: DataFrame | str | None = "auto"
) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for each column, by ``(t, order)`` within the key."""
    hot, df, part = _resolve(df, keys, t, hot)
    w = Window.partitionBy(*part).orderBy(t, order)
    near = [F.lag(c).over(w).alias(f"prev_{c}") for c in cols] + [F.lead(c).over(w).alias(f"next_{c}") for c in cols]
    if hot is None:
        return df.select("*", *near)
    rows = _fragmented(df, hot, t).withColumn("_carry", F.lit(False))
    frags = Window.partitionBy(*keys).orderBy("_frag")
    whole, rank = F.struct(*dict.fromkeys([t, order, *cols])), F.struct(t, order)
    ends = (
        rows.filter("_hot")
        .groupBy(*keys, "_frag")
        .agg(F.max_by(whole, rank).alias("_last"), F.min_by(whole, rank).alias("_first"))
        .select(*keys, F.lead("_frag").over(frags).alias("_next"), F.lag("_frag").over(frags).alias("_prev"), "_last", "_first")
    )
    towards = lambda frag, row: F.struct(F.col(frag).alias("_frag"), F.col(row).alias("_row"))
    carried = (
        ends.select(*keys, F.inline(F.array(towards("_next", "_last"), towards("_prev", "_first"))))
        .filter(F.col("_frag").isNotNull())
        .select(*keys, "_frag", F.lit(True).alias("_carry"), "_row.*")
    )
    rows = rows.unionByName(carried, allowMissingColumns=True).select("*", *near)
    return rows.filter(~F.col("_carry")).drop("_carry", "_frag", "_hot")


def trailing_distinct(
    events: DataFrame,
    keys: list[str],
    member: str,
    t: str,
    order: str,
    seconds: int,
    name: str,
    *,
    hot: DataFrame | str | None = "auto",
) -> DataFrame:
    """Add ``<name>``: distinct members among the key's events in ``[t - w, t]``, and
    ``<name>_before``: the same count without the row itself.

    A member is present from an event until ``w`` after its last one, so the distinct
    count is a running total of arrivals and departures: no set is ever collected. Null
    members are not counted.
    """
    hot, events, part = _resolve(events, keys, t, hot)
    span = int(seconds * 1_000_000)
    near = neighbours(events, [*keys, member], t, order, [t], hot=hot)
    lonely_before = F.col(f"prev_{t}").isNull() | (F.col(f"prev_{t}") < F.col(t) - span)
    last_seen = F.col(f"next_{t}").isNull() | (F.col(f"next_{t}") > F.col(t) + span)
    alone = lonely_before & (F.col(f"next_{t}").isNull() | (F.col(f"next_{t}") > F.col(t)))
    named = F.col(member).isNotNull()
    payload = [c for c in events.columns if c not in keys]
    moved = (
        near.withColumn("_arrive", (named & lonely_before).cast("long"))
        .withColumn("_depart", (named & last_seen).cast("long"))
        .withColumn("_alone", (named & alone).cast("long"))
        .withColumn("_own", F.explode(F.when(F.col("_depart") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
        .select(
            *keys,
            F.when(F.col("_own"), F.col(t)).otherwise(F.col(t) + span + 1).alias("_t"),
            "_own",
            *[F.when(F.col("_own"), F.col(c)).alias(c) for c in payload],
            "_alone",
            F.when(F.col("_own"), F.col("_arrive")).otherwise(-F.col("_depart")).alias(name),
        )
    )
    rows = _fragmented(moved if hot is None else cut(moved), hot, "_t")
    if hot is not None:
        rows = rows.unionByName(_totals_before(rows, keys, [name], None), allowMissingColumns=True)
    upto = Window.partitionBy(*part).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*keys, *payload, "_own", "_alone", F.sum(name).over(upto).alias(name)).filter("_own")
    return rows.withColumn(f"{name}_before", F.col(name) - F.col("_alone")).drop("_own", "_alone")


def next_match(
    rows: DataFrame, keys: list[str], t: str, order: str, is_probe: Column, match: Column, *, hot: DataFrame | str | None = "auto"
) -> DataFrame:
    """For probe rows, add ``_match``: the first row at or after ``t`` with a non-null ``match`` struct.

    ``match`` must start with ``(t, order)``; among equal times the smallest order wins.
    """
    hot, rows, part = _resolve(rows, keys, t, hot)
    r = _fragmented(rows.withColumn("_found", match).withColumn("_probe", is_probe), hot, t)
    if hot is not None:
        later = Window.partitionBy(*keys).orderBy(F.desc("_frag")).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            r.filter("_hot")
            .groupBy(*keys, "_frag")
            .agg(F.min("_found").alias("_found"))
            .select(*keys, "_frag", F.last("_found", ignorenulls=True).over(later).alias("_found"))
            .filter(F.col("_found").isNotNull())
            .select(*keys, "_frag", F.col(f"_found.{t}").alias(t), F.col(f"_found.{order}").alias(order), "_found", F.lit(False).alias("_probe"))
        )
        r = r.unionByName(carried, allowMissingColumns=True)
    # Later rows come first, so the frame only grows; the smallest struct in it is the nearest match.
    back = Window.partitionBy(*part).orderBy(F.desc(t)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("_match", F.min("_found").over(back))
    return r.filter("_probe").drop("_found", "_probe", "_frag", "_hot")
