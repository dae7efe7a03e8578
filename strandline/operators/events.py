"""Ordered logs: streaks, gaps, runs, sessions, transitions, current rows, merged ranges and greedy folds."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tables import cut

#: Rows of a group that one task folds in order; larger groups are cut by range blocks.
ROWS_OF_A_FOLD = 1 << 20


def ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def next_edges(df: DataFrame, by: list[str], order: list[str], ident: str) -> DataFrame:
    """(from_id, to_id) of consecutive rows."""
    w = ordered(by, order)
    return df.select(F.col(ident).alias("from_id"), F.lead(ident).over(w).alias("to_id")).where("to_id is not null")


def streaks(df: DataFrame, by: list[str], order: list[str], broken: Column) -> DataFrame:
    """Adds streak: how many rows in a row, up to this one, have not been broken (0 where this row breaks it)."""
    w = ordered(by, order)
    d = df.withColumn("_run", F.sum(broken.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("streak", F.sum((~broken).cast("bigint")).over(inside)).drop("_run")


def sessions_by_marker(df: DataFrame, by: list[str], order: list[str], marker: Column) -> DataFrame:
    """Adds session: the number of markers before this row; the marker closes its session."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("session", F.coalesce(F.sum(marker.cast("bigint")).over(w), F.lit(0)).cast("bigint"))


def valid_prefix(df: DataFrame, by: list[str], order: list[str], ok: Column) -> DataFrame:
    """The rows before the first that is not ok."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_ok", F.min(ok.cast("int")).over(w)).where("_ok = 1").drop("_ok")


def occurrence(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ordinal: how many rows with the same key came before."""
    return df.withColumn("ordinal", (F.row_number().over(ordered(by, order)) - 1).cast("bigint"))


def feed_faults(df: DataFrame, by: str, seq: str, payload: Column) -> DataFrame:
    """(by, seq, fault): gap where the sequence before is missing, conflict where one sequence has several payloads."""
    each = df.groupBy(by, seq).agg(F.count_distinct(payload).alias("_n"))
    w = Window.partitionBy(by).orderBy(seq)
    each = each.withColumn("_gap", F.col(seq) - F.lag(seq).over(w) > 1)
    faults = F.array_compact(F.array(F.when(F.col("_gap"), "gap"), F.when(F.col("_n") > 1, "conflict")))
    return each.select(by, seq, F.explode(faults).alias("fault"))


def idempotent(df: DataFrame, key: list[str], order: list[str], payload: Column) -> DataFrame:
    """One row by key, the first, with how many came and whether a later one had another payload."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    d = df.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(first.alias("_r"), F.count("*").alias("deliveries"), (F.count_distinct(payload) > 1).alias("conflict"))
    return d.select("_r.*", "deliveries", "conflict")


def bad_transitions(df: DataFrame, by: list[str], order: list[str], status: str, allowed: DataFrame) -> DataFrame:
    """Rows whose status may not follow the one before; allowed has (old, new)."""
    d = df.withColumn("old", F.lag(status).over(ordered(by, order))).where("old is not null")
    return d.join(allowed.select("old", F.col("new").alias(status)), ["old", status], "left_anti")


def current_rows(df: DataFrame, by: list[str], at: list[str], arrival: list[str]) -> DataFrame:
    """Adds is_current (the newest row by time) and late (a newer one had already arrived)."""
    newest = df.groupBy(*by).agg(F.max(F.struct(*at)).alias("_newest"))
    w = ordered(by, arrival).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("late", F.coalesce(F.max(F.struct(*at)).over(w) > F.struct(*at), F.lit(False)))
    return d.join(newest, by).withColumn("is_current", F.struct(*at) == F.col("_newest")).drop("_newest")


def supersession(df: DataFrame, by: list[str], order: list[str], ident: str) -> DataFrame:
    """Adds superseded_by: the row that replaced this one; null for the current row."""
    return df.withColumn("superseded_by", F.lead(ident).over(ordered(by, order)))


def merge_ranges(df: DataFrame, by: list[str], start: str, end: str, touching: int = 1) -> DataFrame:
    """(by, start, end, members): ranges merged where one starts at most touching units after those before it end."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", F.coalesce((F.col(start) > reach + touching).cast("int"), F.lit(0)))
    d = d.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_group")


def islands(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, first, last) of runs of consecutive numbers; repeated numbers count once."""
    d = df.select(*by, number).distinct()
    d = d.withColumn("_g", F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number)))
    return d.groupBy(*by, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")


def running_offsets(df: DataFrame, by: list[str], order: list[str], size: Column, gap: int) -> DataFrame:
    """Adds start and end of each piece when pieces stand one after another, gap units apart."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("start", F.coalesce(F.sum(size + gap).over(w), F.lit(0)).cast("bigint"))
    return d.withColumn("end", (F.col("start") + size).cast("bigint"))


def positions(df: DataFrame, by: list[str], order: list, size: Column | None = None) -> DataFrame:
    """Adds _pos (1, 2, ... in order within by) and, with size, _size and its running sum _end as exact decimals.

    Rows are dealt by ranges of (by, order), so a large group lies in many blocks; each block is numbered by itself and
    starts after what the blocks of its group before it hold.
    """
    exact = (F.lit(0) if size is None else size).cast("decimal(28,10)")
    d = cut(df.withColumn("_size", exact).repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id()), "blocks")
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b")).agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_base", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_pos", F.row_number().over(inside)).withColumn("_end", F.sum("_size").over(inside)).join(held, same)
    d = d.withColumn("_pos", F.col("_pos") + F.col("_before")).withColumn("_end", (F.col("_end") + F.col("_base")).cast("decimal(38,10)"))
    return d.drop("_block", "_b", "_n", "_s", "_before", "_base", *[f"_k{i}" for i in range(len(by))], *(["_size", "_end"] if size is None else []))


def range_chunks(df: DataFrame, by: list[str], order: list[str], size: str, limit: float) -> DataFrame:
    """Adds chunk: rows in order share a chunk until the next would take it over the limit. Groups may be too large for a
    task; sizes are not negative (ten decimals count), groups not null.

    Groups are counted first. One that a task can read in order is folded there, so its rows move once; the others are cut by blocks.
    """
    large = cut(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS_OF_A_FOLD).select(*by), "large")
    if large.isEmpty():
        return _folded_chunks(df, by, order, size, limit)
    rest = _folded_chunks(df.join(large, by, "left_anti"), by, order, size, limit)
    return rest.unionByName(_block_chunks(df.join(large, by, "left_semi"), by, order, size, limit))


def _folded_chunks(df: DataFrame, by: list[str], order: list[str], size: str, limit: float) -> DataFrame:
    """range_chunks where each group is read in order by one task; a running sum and a number are all that is kept, over Arrow batches."""
    most, columns = Decimal(str(limit)).quantize(Decimal("1e-10"), ROUND_HALF_UP), [*by, "_size"]

    def run(batches):
        now, used, chunk = None, Decimal(0), 0
        for b in batches:
            out = []
            for *key, s in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]):
                s = s or Decimal(0)
                if key != now:
                    now, used, chunk = key, s, 0
                elif used + s > most:
                    used, chunk = s, chunk + 1
                else:
                    used += s
                out.append(chunk)
            kept = b.drop_columns("_size")
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], names=[*kept.schema.names, "chunk"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    d = df.repartition(*by).sortWithinPartitions(*by, *order).withColumn("_size", F.col(size).cast("decimal(28,10)"))
    return d.mapInArrow(run, f"{schema}, chunk int")


def _block_chunks(df: DataFrame, by: list[str], order: list[str], size: str, limit: float) -> DataFrame:
    """range_chunks of groups of any size.

    A row's running sum and its place come from range blocks. Were it a chunk's first row, the next chunk would start after
    the last row whose sum is at most its own start plus the limit; that row is in the limit-wide cell of this bound or in
    the one before, so a window holds one cell's rows. The starts that count are reached from the group's first row by
    doubled pointers: as many rounds as the logarithm of the largest number of chunks.
    """
    most = F.lit(limit).cast("decimal(28,10)")
    d = cut(positions(df, by, order, F.col(size)), "rows")
    groups = cut(d.groupBy(*by).agg(F.count("*").alias("_rows"), F.max("_end").alias("_total")), "groups")
    big = d.join(groups.where(F.col("_total") > most), by).select(*by, "_pos", "_end", (F.col("_end") - F.col("_size")).cast("decimal(38,10)").alias("_start"))
    points = big.select(*by, F.floor(F.col("_end") / most).alias("_cell"), F.col("_end").alias("_at"), F.lit(0).alias("_kind"), "_pos", F.col("_pos").alias("_last"))
    bounds = big.select(*by, (F.floor(F.col("_start") / most) + 1).alias("_cell"), (F.col("_start") + most).cast("decimal(38,10)").alias("_at"), F.lit(1).alias("_kind"), "_pos", F.lit(None).cast("bigint").alias("_last"))
    w = Window.partitionBy(*by, "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(bounds).withColumn("_in", F.max("_last").over(w)).where("_kind = 1")
    low = points.groupBy(*by, (F.col("_cell") + 1).alias("_cell")).agg(F.max("_pos").alias("_low"))
    after = met.join(low, [*by, "_cell"], "left").select(*by, "_pos", (F.greatest("_pos", "_in", "_low") + 1).alias("_next"))
    after = cut(after.join(groups, by).where("_next <= _rows").select(*by, "_pos", "_next"), "jump")

    jumps = [after]
    while not jumps[-1].isEmpty():
        far = jumps[-1].select(*by, F.col("_pos").alias("_next"), F.col("_next").alias("_far"))
        jumps.append(cut(jumps[-1].join(far, [*by, "_next"]).select(*by, "_pos", F.col("_far").alias("_next")), "jump"))
    starts = groups.select(*by, F.lit(1).cast("bigint").alias("_pos"), F.lit(0).cast("bigint").alias("chunk"))
    for k in reversed(range(len(jumps) - 1)):
        more = starts.join(jumps[k], [*by, "_pos"]).select(*by, F.col("_next").alias("_pos"), (F.col("chunk") + (1 << k)).alias("chunk"))
        starts = cut(starts.union(more), "starts")
    span = starts.join(after, [*by, "_pos"], "left").join(groups, by)
    span = span.select(*by, F.explode(F.sequence("_pos", F.coalesce(F.col("_next") - 1, F.col("_rows")))).alias("_pos"), F.col("chunk").cast("int").alias("chunk"))
    return d.join(span, [*by, "_pos"]).drop("_pos", "_size", "_end")


def admit_within(df: DataFrame, by: list[str], order: list[str], size: str, limit: float) -> DataFrame:
    """Adds admitted: a row is admitted if it still fits beside those admitted before it; one that does not is skipped.

    Each row depends on all before it in its group, so a group is read in order by one task; a running sum is all that is
    kept, over Arrow batches.
    """

    def run(batches):
        now, used = None, 0.0
        for b in batches:
            out = []
            for *key, s in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in [*by, size]]):
                if key != now:
                    now, used = key, 0.0
                out.append(None if s is None else used + s <= limit)
                used += s if out[-1] else 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "admitted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{schema}, admitted boolean")
