"""Sequences in long form: one row for each place of each sequence."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written


@dataclass(frozen=True)
class Sequences:
    """frame has the columns of `groups`, those of `ids`, raw_pos (int) and state (string, null for a missing one).

    Two places matter: raw_pos, where holes break a neighbourhood, and the place among the states that are there, which
    positioned() adds as pos and where holes are bridged. ids may be several columns, so that a frame that is already
    dealt by the first of them (an actor) need not be dealt again.
    """

    frame: DataFrame
    ids: tuple[str, ...] = ("seq_id",)
    groups: tuple[str, ...] = ()

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.groups, *self.ids)

    def window(self, order: str = "raw_pos"):
        return Window.partitionBy(*self.keys).orderBy(order)

    def present(self) -> DataFrame:
        return self.frame.where("state is not null")

    def positioned(self) -> DataFrame:
        """The states that are there, with pos from 0."""
        return self.present().withColumn("pos", F.row_number().over(self.window()) - 1)

    def with_groups(self, *groups: str) -> Sequences:
        """The same with columns of the frame as groups."""
        return replace(self, groups=groups)

    def labels(self) -> DataFrame:
        """The distinct states, in one column `label`."""
        return self.present().select(F.col("state").alias("label")).distinct()

    def sizes(self) -> DataFrame:
        """Sequences by group."""
        return self.frame.select(*self.keys).distinct().groupBy(*self.groups).agg(F.count("*").alias("n_sequences"))


def from_wide(rows: DataFrame, columns: list[str], id: str, groups: tuple[str, ...] = (), missing: tuple[str, ...] = ()) -> Sequences:
    """One row a sequence, a state a column. NaN and the strings in `missing` count as missing."""
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("raw_pos", "state")
    long = rows.select(*groups, id, cells)
    gone = F.col("state").isin("NaN", *missing)
    return Sequences(long.withColumn("state", F.when(~gone, F.col("state"))), (id,), groups)


def from_frame(rows: DataFrame, missing: tuple[str, ...] = ()) -> Sequences:
    """A sequence a row and a place a column, in their order, whatever their names. Rows get numbers as their ids, which are
    written down with them, so that every pass over the sequences sees the same ones."""
    columns = [f"place_{k}" for k in range(len(rows.columns))]
    numbers = written(rows.toDF(*columns).withColumn("seq_id", F.monotonically_increasing_id()), "frame")
    return from_wide(numbers, columns, "seq_id", missing=missing)


def width_of(seqs: Sequences) -> int:
    """Places of the longest sequence, padding counted: one number of one pass."""
    return (seqs.frame.agg(F.max("raw_pos")).first()[0] or 0) + 1


def to_wide(seqs: Sequences, width: int | None = None, prefix: str = "action_", value: str = "state", position: str = "raw_pos") -> DataFrame:
    """One row a sequence, a column a place: as many as the longest sequence has, which takes a pass, or the first `width`."""
    if width is None:
        width = width_of(seqs)
    cells = [F.max(F.when(F.col(position) == k, F.col(value))).alias(f"{prefix}{k + 1}") for k in range(width)]
    return seqs.frame.groupBy(*seqs.keys).agg(*cells)


def glued(seqs: Sequences, number: str, k: int, width: int) -> Sequences:
    """k consecutive sequences, by a column that numbers them from 0, as one: the next one starts `width` places on."""
    place = (F.col("raw_pos") + F.pmod(F.col(number), F.lit(k)) * width).cast("int")
    return Sequences(seqs.frame.select(*seqs.groups, F.floor(F.col(number) / k).cast("long").alias("seq_id"), place.alias("raw_pos"), "state"), ("seq_id",), seqs.groups)


def bounded(seqs: Sequences, begin: str | None = None, end: str | None = None, width: int | None = None) -> Sequences:
    """Every sequence with a first state `begin` at place -1 and a last one `end` at place `width`, behind all padding.

    Without a width, the end stands behind the longest sequence.
    """
    frame = seqs.frame.select(*seqs.keys, "raw_pos", "state")
    each = frame.select(*seqs.keys).distinct()
    out = frame
    if begin is not None:
        out = out.unionByName(each.withColumn("raw_pos", F.lit(-1)).withColumn("state", F.lit(begin)))
    if end is not None:
        if width is None:
            longest = frame.agg((F.max("raw_pos") + 1).alias("raw_pos"))
            ends = each.crossJoin(F.broadcast(longest))  # one row, one number
        else:
            ends = each.withColumn("raw_pos", F.lit(width))
        out = out.unionByName(ends.withColumn("state", F.lit(end)).select(*frame.columns))
    return replace(seqs, frame=out)


def ordered_labels(labels: list[str], begin: str | None = None, end: str | None = None) -> list[str]:
    """Labels by code point; a begin state goes first and an end state last, unless the data have them anyway."""
    out = sorted(labels)
    if begin is not None and begin not in out:
        out.insert(0, begin)
    if end is not None and end not in out:
        out.append(end)
    return out
