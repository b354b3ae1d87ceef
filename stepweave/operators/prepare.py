"""From an event log to sequences: actors, times, sessions, metadata and statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .sequences import Sequences, to_wide
from .shared import few_rows, numbered, ranks, written

#: Directives of strptime and the letters of Spark's patterns for them: fixed values of the two formats.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%Z": "VV", "%%": "%"}


def spark_pattern(strptime: str) -> str:
    """The datetime pattern of Spark that reads what a strptime format reads."""
    out, plain, k = [], "", 0
    while k < len(strptime):
        step = strptime[k : k + 2]
        if step in DIRECTIVES:
            out += [f"'{plain}'" if plain.isalpha() else plain, DIRECTIVES[step]]
            plain, k = "", k + 2
        else:
            plain, k = plain + strptime[k], k + 1
    return "".join([*out, f"'{plain}'" if plain.isalpha() else plain])


def parsed_time(column: Column, custom_format: str | None = None, is_unix_time: bool = False, unix_time_unit: str = "seconds") -> Column:
    """Timestamps from text, from text in a strptime format, or from Unix time; an unknown unit counts as seconds."""
    if is_unix_time:
        unit = {"milliseconds": F.timestamp_millis, "ms": F.timestamp_millis, "microseconds": F.timestamp_micros, "us": F.timestamp_micros}.get(unix_time_unit)
        return unit(column.cast("long")) if unit else F.timestamp_seconds(column)
    if custom_format:
        return F.to_timestamp(column, spark_pattern(custom_format))
    return F.to_timestamp(column)


@dataclass(frozen=True)
class Prepared:
    """Sessions of an event log. long has all input columns and actor, session (from 1), session_id, raw_pos, state and,
    if there is a time, ts."""

    long: DataFrame
    action: str
    timed: bool

    @property
    def sequences(self) -> Sequences:
        return Sequences(self.long, ("actor", "session"))

    def sequence_data(self, width: int | None = None) -> DataFrame:
        return to_wide(Sequences(self.long, ("session_id",)), width)

    def time_data(self, width: int | None = None) -> DataFrame:
        return to_wide(Sequences(self.long, ("session_id",)), width, "time_", "ts")

    def meta_data(self, columns: list[str]) -> DataFrame:
        """The first value that isn't null of each column in each session."""
        firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("raw_pos"))).alias(c) for c in columns]
        return self.long.groupBy("actor", "session", "session_id").agg(*firsts).drop("actor", "session")

    def statistics(self) -> DataFrame:
        """One row: sessions, actors, events, distinct actions, and the longest and mean length."""
        by_session = self.long.groupBy("actor", "session").agg(F.count("*").alias("n"))
        lengths = by_session.agg(F.count("*").alias("n_sessions"), F.countDistinct("actor").alias("n_actors"), F.sum("n").alias("n_events"), F.max("n").alias("max_length"), F.avg("n").alias("mean_length"))
        actions = self.long.agg(F.countDistinct("state").alias("n_unique_actions"))
        return lengths.crossJoin(F.broadcast(actions))  # one row and one row

    def action_frequencies(self) -> DataFrame:
        return self.present().groupBy(F.col("state").alias("action")).agg(F.count("*").alias("n"))

    def present(self) -> DataFrame:
        return self.long.where("state is not null")


def prepare(
    events: DataFrame,
    action: str,
    actor: str | list[str] | None = None,
    time: str | None = None,
    order: str | None = None,
    tiebreak: tuple[str, ...] = (),
    time_threshold: float = 900,
    custom_format: str | None = None,
    is_unix_time: bool = False,
    unix_time_unit: str = "seconds",
) -> Prepared:
    """Sessions of the events of each actor.

    Events are ordered by `order` or else by time, then by the columns of tiebreak, which should make the order total. A
    gap of more than time_threshold seconds starts a session; one of exactly as much doesn't. Without a time each actor
    is one session, named by the actor's rank from 0, and without an actor all events are one actor's. Several actor columns are joined by `_`, nulls as
    text. Windows stay within (actor, session), so the events are dealt once, by actor. An actor of more than shared.HOT
    events, all of them if there is no actor, is dealt by ranges of its events instead.
    """
    if actor is None:
        who = F.lit("all")
    elif isinstance(actor, str):
        who = F.col(actor).cast("string")
    else:
        who = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in actor])
    rows = events.withColumn("actor", who).withColumn("state", F.col(action).cast("string"))
    if time is not None:
        kind = dict(events.dtypes)[time]
        ready = kind.startswith("timestamp") and not is_unix_time
        rows = rows.withColumn("ts", F.col(time) if ready else parsed_time(F.col(time), custom_format, is_unix_time, unix_time_unit))
    by = [order] if order is not None else ["ts"] if time is not None else []
    by += [c for c in tiebreak if c not in by]
    by = [F.col(c) for c in by] or [F.monotonically_increasing_id()]
    if time is None:
        rows = rows.withColumn("session", F.lit(1).cast("long"))
    hot = None if few_rows(events) else _hot_actors(rows)
    if hot is None:
        placed = _by_actor(rows, by, time_threshold if time is not None else None)
    else:
        cold = _by_actor(rows.join(hot, "actor", "left_anti"), by, time_threshold if time is not None else None)
        placed = cold.unionByName(_by_ranges(rows.join(hot, "actor", "left_semi"), by, time_threshold if time is not None else None))
    if time is None:
        placed, named = placed.join(ranks(rows, "actor", "__rank"), "actor", "left"), F.col("__rank")
    else:
        named = F.concat_ws("_", "actor", F.col("session").cast("string"))
    return Prepared(placed.withColumn("session_id", named).drop("__rank"), action, time is not None)


def _starts(before: Column, at: Column, threshold: float) -> Column:
    """1 if an event at `at` starts a session after one at `before`, null where there is none."""
    gap = F.timestamp_diff("MICROSECOND", before, at)
    return F.when(before.isNull() | (gap > int(threshold * 1_000_000)), 1).otherwise(0)


def _by_actor(rows: DataFrame, by: list[Column], threshold: float | None) -> DataFrame:
    """session, if there are times, and raw_pos, by windows over each actor."""
    in_actor = Window.partitionBy("actor").orderBy(*by)
    if threshold is not None:
        rows = rows.withColumn("__before", F.lag("ts").over(in_actor)).withColumn("__starts", _starts(F.col("__before"), F.col("ts"), threshold))
        rows = rows.withColumn("session", F.sum("__starts").over(in_actor.rowsBetween(Window.unboundedPreceding, 0))).drop("__before", "__starts")
    return rows.withColumn("raw_pos", F.row_number().over(Window.partitionBy("actor", "session").orderBy(*by)) - 1)


def _hot_actors(rows: DataFrame) -> DataFrame | None:
    """Actors with more than HOT events, if there are any: a row for HOT events at most. They are counted in each task first."""
    hot = written(rows.groupBy("actor").agg(F.count("*").alias("n")).where(F.col("n") > shared.HOT).select("actor"), "hot_actors")
    return None if hot.isEmpty() else hot


def _by_ranges(rows: DataFrame, by: list[Column], threshold: float | None) -> DataFrame:
    """_by_actor() by ranges of each actor's events: a scan of each range, then of what is known of the ranges, a row for
    each range of an actor, then the sum of both. No task has more than a range, however many events an actor has."""
    order = [f"__by{k}" for k in range(len(by))]
    ready = rows.select("*", *[c.alias(name) for name, c in zip(order, by)])
    ready = written(ready.repartitionByRange("actor", *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside, before = Window.partitionBy("actor", "__range").orderBy(*order), Window.partitionBy("actor").orderBy("__range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    ready = ready.withColumn("__k", F.row_number().over(inside) - 1)
    own = [F.count("*").alias("n")]
    if threshold is not None:
        ready = ready.withColumn("__before", F.lag("ts").over(inside))
        ready = ready.withColumn("__starts", F.when(F.col("__k") > 0, _starts(F.col("__before"), F.col("ts"), threshold)).otherwise(0))
        own += [F.min_by("ts", "__k").alias("first"), F.max_by("ts", "__k").alias("last"), F.sum("__starts").alias("starts"), F.max(F.when(F.col("__starts") == 1, F.col("__k"))).alias("last_start")]
    known = ready.groupBy("actor", "__range").agg(*own).withColumn("__rows", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if threshold is None:
        met = ready.join(known.select("actor", "__range", "__rows"), ["actor", "__range"])
        return met.withColumn("raw_pos", (F.col("__rows") + F.col("__k")).cast("int")).select(*rows.columns, "raw_pos")
    opens = _starts(F.lag("last").over(before), F.col("first"), threshold)
    known = known.withColumn("__opens", opens).withColumn("__all", F.col("starts") + F.col("__opens"))
    latest = F.col("__rows") + F.coalesce("last_start", F.when(F.col("__opens") == 1, F.lit(0)))
    known = known.withColumn("__sessions", F.coalesce(F.sum("__all").over(earlier), F.lit(0))).withColumn("__latest", latest)
    known = known.withColumn("__held", F.max("__latest").over(earlier))
    met = ready.join(known.select("actor", "__range", "__rows", "__opens", "__sessions", "__held"), ["actor", "__range"])
    met = met.withColumn("__starts", F.when(F.col("__k") == 0, F.col("__opens")).otherwise(F.col("__starts"))).withColumn("__at", F.col("__rows") + F.col("__k"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    session = F.col("__sessions") + F.sum("__starts").over(so_far)
    begun = F.coalesce(F.max(F.when(F.col("__starts") == 1, F.col("__at"))).over(so_far), F.col("__held"))
    return met.withColumn("session", session).withColumn("raw_pos", (F.col("__at") - begun).cast("int")).select(*rows.columns, "session", "raw_pos")


def checked_onehot(rows: DataFrame, columns: list[str]) -> None:
    """Raises ValueError for a missing column or a value other than 0 and 1."""
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.coalesce(F.col(c).isin(0, 1), F.lit(True))
    if not rows.where(bad).isEmpty():
        raise ValueError("one-hot columns hold values other than 0 and 1")


def onehot(rows: DataFrame, columns: list[str], order: list[str], actor: str | None = None, session: str | None = None, window_size: int = 1, window_type: str = "tumbling", aggregate: bool = False) -> tuple[Sequences, dict]:
    """Sequences from 0/1 columns in windows of rows, and what a windowed model needs to know of them.

    A sequence is a group of actor and session, places w * slots + t - 1 of slot t in window w. Tumbling windows hold
    window_size rows, side by side or, aggregated, merged by column. A sliding window at a row merges the L rows before
    it, L = m (m - 1) / 2 with m = max(window_size, 2); the first row of a group has none.
    """
    if window_type not in ("tumbling", "sliding"):
        raise ValueError(f"unknown window type: {window_type}")
    keys = [c for c in (actor, session) if c is not None]
    rows = rows.where(reduce(and_, [F.col(c).isNotNull() for c in keys])) if keys else rows.withColumn("seq_id", F.lit("all"))
    ids = tuple(keys) or ("seq_id",)
    n = len(columns)
    if few_rows(rows):
        rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*ids).orderBy(*order)) - 1)
    else:  # numbered by ranges: a key may have any number of rows
        rows = numbered(rows, (*ids, *order), ids).withColumnRenamed("idx", "__row").drop("total", "start")
    if window_type == "sliding":
        m = max(window_size, 2)
        reach = m * (m - 1) // 2
        # blocks of rows, each with the rows before it that its first ones reach back to
        size = max(shared.HOT // 16, reach, 1)
        block = F.floor(F.col("__row") / size).cast("long")
        tail = F.pmod(F.col("__row"), F.lit(size)) >= size - reach
        rows = rows.select(*ids, "__row", *columns, block.alias("__own"), F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))).alias("__block"))
        behind = Window.partitionBy(*ids, "__block").orderBy("__row").rowsBetween(-reach, 0)
        merged = [F.max(F.coalesce(F.col(c), F.lit(0))).over(behind).alias(c) for c in columns]
        rows = rows.select(*ids, (F.col("__row") - 1).alias("w"), "__row", "__own", "__block", *merged).where("__row > 0 and __own = __block")
        slots, offset = n, F.lit(0)
    elif aggregate:
        rows = rows.withColumn("w", F.floor(F.col("__row") / window_size)).groupBy(*ids, "w").agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns])
        slots, offset = n, F.lit(0)
    else:
        rows = rows.withColumn("w", F.floor(F.col("__row") / window_size)).withColumn("__in", F.pmod(F.col("__row"), F.lit(window_size)))
        slots, offset = n * window_size, F.col("__in") * n
    cells = F.posexplode(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in columns])).alias("__col", "state")
    long = rows.select(*ids, "w", offset.alias("__at"), cells)
    place = (F.col("w") * slots + F.col("__at") + F.col("__col")).cast("int")
    long = long.select(*ids, F.col("w").cast("int").alias("w"), (F.col("__at") + F.col("__col") + 1).cast("int").alias("t"), place.alias("raw_pos"), "state")
    return Sequences(long, ids), {"windowed": True, "window_size": 1 if aggregate else window_size, "window_span": n}
