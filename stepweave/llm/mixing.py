"""Mixing sources to target weights: pivotal dependent rounding over a reduction tree, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, fresh, table, written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of the mix against words of all sources, and copies of a document at most.
TOTAL, MOST = 1.5, 2
#: Fractional documents folded in one group of the reduction tree.
FAN = 64
#: Documents of each power of two of words that wait for the root.
RESERVE = 32
#: Keys of rows to take that are broadcast, at most (16 bytes each); more of them are joined by a shuffle of the texts.
TAKEN = 1_000_000
#: Copy probabilities this close to a whole number are whole.
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, nth: the words of every row, and its number among rows equal in the other three."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))))


def source_targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, target: the words each source gives to the mix.

    Sources in code point order, null last, get the weights in turn and share total times all words; a target stops at
    most times its source's words, and what is over goes to the others by weight until none is above. Sources are
    numbered within ranges of the sort and by range, so that no task holds all of them.
    """
    sums = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = sums.repartitionByRange(F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "sources")
    # one row a range, however many sources
    starts = ranged.groupBy("range").count().withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    named = written(ranged.join(starts, "range").withColumn("weight", turn).select("source", "source_size", "weight"), "weights")

    level = None
    cap = F.col("source_size") * float(most)
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap
        got = named.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.max(F.when(~full, F.col("source_size"))).alias("left"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not got["weight"] or not got["all"]:
            break
        now = (total * got["all"] - (got["full"] or 0.0)) / got["weight"]
        if level is not None and now <= level:
            break
        level = now
    target = F.least(cap, F.col("weight") * F.lit(float(level or 0.0)))
    return named.select("source", "source_size", target.alias("target"))


def _uniform(seed: int, *cols):
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _fold(level: int, seed: int):
    """One group's fractional items, in order, rounded by sequential pivotal steps.

    The carry is the item still fractional. It meets the next item: words go from one to the other, in a random
    direction and so that neither chance moves in expectation, until one of the two is whole. The words expected of the
    group never change.
    """
    item = "struct<doc_id: bigint, source: string, size: bigint, nth: int, p: double, taken: int>"

    def step(acc, x):
        a, b = acc["carry"], x
        sa, sb = a["size"].cast("double"), b["size"].cast("double")
        up = F.least((1 - a["p"]) * sa, b["p"] * sb)
        down = F.least(a["p"] * sa, (1 - b["p"]) * sb)
        rises = _uniform(seed + level, b["doc_id"], b["nth"], b["size"]) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        pa, pb = a["p"] + moved / sa, b["p"] - moved / sb
        # the one that reached its end is whole, whatever the last bits say
        a_ends = F.when(rises, (1 - a["p"]) * sa <= b["p"] * sb).otherwise(a["p"] * sa <= (1 - b["p"]) * sb)
        whole_a, whole_b = F.when(rises, 1).otherwise(0), F.when(rises, 0).otherwise(1)
        put = lambda i, p, taken: F.struct(i["doc_id"].alias("doc_id"), i["source"].alias("source"), i["size"].alias("size"), i["nth"].alias("nth"), p.cast("double").alias("p"), taken.cast("int").alias("taken"))
        gone = F.when(a_ends, put(a, whole_a, whole_a)).otherwise(put(b, whole_b, whole_b))
        carry = F.when(a_ends, put(b, pb, F.lit(None))).otherwise(put(a, pa, F.lit(None)))
        fresh = F.struct(b.cast(item).alias("carry"), acc["done"].alias("done"))
        return F.when(a.isNull(), fresh).otherwise(F.struct(carry.cast(item).alias("carry"), F.concat(acc["done"], F.array(gone.cast(item))).alias("done")))

    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("done"))
    return F.aggregate("items", start, step, lambda acc: F.concat(acc["done"], F.array(acc["carry"])))


def _settled(items, seed: int):
    """The items of a source's root, the one still fractional rounded by chance, and what that puts the source off its
    target made up: from large to small, an item whose words are no more than what is over or lacking is put out or in."""
    last, done = F.element_at(items, -1), F.slice(items, F.lit(1), F.size(items) - 1)
    size = last["size"].cast("double")
    took = (_uniform(seed + 300, last["doc_id"], last["nth"], last["size"]) < last["p"]).cast("int")
    ordered = F.array_sort(F.transform(done, lambda i: F.struct((-i["size"]).alias("large"), _uniform(seed + 500, i["doc_id"], i["nth"], i["size"]).alias("at"), i.alias("x"))))
    item = lambda i, taken: F.struct(i["doc_id"].alias("doc_id"), i["source"].alias("source"), i["size"].alias("size"), i["nth"].alias("nth"), taken.alias("taken"))
    kind = "array<struct<doc_id: bigint, source: string, size: bigint, nth: int, taken: int>>"

    def step(acc, o):
        x, over, words = o["x"], acc["over"], o["x"]["size"].cast("double")
        out, into = (x["taken"] == 1) & (words <= over), (x["taken"] == 0) & (words <= -over)
        taken = F.when(out, F.lit(0)).when(into, F.lit(1)).otherwise(x["taken"])
        moved = F.when(out, -words).when(into, words).otherwise(F.lit(0.0))
        return F.struct((over + moved).alias("over"), F.concat(acc["all"], F.array(item(x, taken)).cast(kind)).alias("all"))

    start = F.struct(((took - last["p"]) * size).alias("over"), F.array(item(last, took)).cast(kind).alias("all"))
    return F.aggregate(ordered, start, step, lambda acc: acc["all"])


def copies(items: DataFrame, targets: DataFrame, fan: int = FAN, reserve: int = RESERVE, seed: int = 4) -> DataFrame:
    """The items with source_size, target and copies: how often the mix takes each.

    A source's rate, target / source_size, is a whole number of copies of each document and a chance of one more.
    The chances are rounded in groups of about `fan` documents; what stays fractional of each group goes up the tree.
    At its root, the last of them meet about `reserve` documents of each power of two of words, larger ones first. The one
    still fractional at the end is rounded by chance, and documents of the root make up what that misses, as far as any is
    small enough: a source misses its target by about the words of its smallest documents.
    Level tables lie in the shared folder; a source of most rows is as many groups as its documents need.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS)
    chance = F.greatest(rate - whole, F.lit(0.0))
    same = F.col("i.source").eqNullSafe(F.col("t.source"))
    all_items = items.alias("i").join(targets.alias("t"), same).select("i.doc_id", "i.source", "i.size", "i.nth", "t.source_size", "t.target", whole.cast("int").alias("base"), chance.alias("p"))
    all_items = written(all_items, "items")

    key = ("doc_id", "nth", "size")
    left = all_items.where((F.col("p") > EPS) & (F.col("size") > 0)).withColumn("power", F.floor(F.log2("size")).cast("int"))
    shares = left.groupBy("source", "power").agg((F.lit(float(reserve)) / F.count("*")).alias("share")).select(F.col("source").alias("s"), F.col("power").alias("w"), "share")
    left = left.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("power") == F.col("w")))
    left = written(left.select("source", *key, "p", (_uniform(seed + 400, *map(F.col, key)) < F.col("share")).alias("kept")), "fractional")
    root, left = left.where("kept").drop("kept"), left.where("not kept").drop("kept")

    def folded(rows, level: int, order: list, *by: str, settle: bool = False):
        item = F.struct(*order, _uniform(seed + 200 + level, *map(F.col, key)).alias("at"), F.struct("doc_id", "source", "size", "nth", "p", F.lit(None).cast("int").alias("taken")).alias("x"))
        grouped = rows.groupBy("source", *by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("items"))
        found = grouped.select(_fold(level, seed).alias("found"))
        return found.select(F.explode(_settled(F.col("found"), seed) if settle else F.col("found")).alias("x")).select("x.*")

    done, level = [], 0
    while True:
        number = written(left.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.ceil(F.col("n") / fan).alias("groups")), "groups")
        if (number.agg(F.max("groups").alias("n")).first()["n"] or 0) <= 1:
            break
        dealt = left.join(number, F.col("source").eqNullSafe(F.col("s"))).withColumn("g", F.pmod(F.xxhash64(*key, F.lit(seed + 100 + level)), F.col("groups")))
        out = written(folded(dealt, level, [], "g"), "level")
        left = out.where("taken is null").select("source", *key, "p")
        done.append(out.where("taken is not null"))
        level += 1
    done.append(folded(root.unionByName(left), level, [(-F.col("size")).alias("large")], settle=True))
    rounded = reduce(DataFrame.unionByName, [x.select("source", *key, "taken") for x in done])
    on = F.col("i.source").eqNullSafe(F.col("d.source"))
    for c in key:
        on &= F.col(f"i.{c}").eqNullSafe(F.col(f"d.{c}"))
    met = all_items.alias("i").join(rounded.alias("d"), on, "left")
    return met.select("i.doc_id", "i.source", "i.size", "i.nth", "source_size", "target", (F.col("base") + F.coalesce("d.taken", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 4) -> DataFrame:
    """doc_id, source, size, nth, source_size, target, copies and taken of every row of docs.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. Rows that
    repeat a doc_id are rounded one by one, and nth numbers those that agree in source and size as well. Results depend
    on the rows and the seed only. An empty table gives an empty result; other columns are not read.
    """
    items = written(sizes(docs), "sizes")  # texts are read once
    chosen = copies(items, source_targets(items, weights, total, most), seed=seed)
    chosen = chosen.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    return chosen.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, seed: int = 4) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, all columns, whatever their names.

    Null and empty texts have no words and are never taken. Rows that repeat an id are told apart by their texts, and where
    those are equal too, by number: as many of them come as the mix takes, twice each at most. Null ids and sources are
    matched like others. An empty table gives an empty result. Rows are told apart by a key of their own, written once
    with them.
    """
    key = fresh(docs.columns, "row_key")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    chosen = mix(rows, seed=seed).where("copies > 0").select("doc_id", "source", "size", "nth", "copies")
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("order"), F.col(key).alias("row_key"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("order", "row_key")))
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "source", "size", "nth")])
    times = fresh([*docs.columns, key], "copies")
    taken = written(own.alias("r").join(chosen.alias("c"), on).select(F.col("r.row_key").alias(key), F.col("c.copies").cast("int").alias(times)), "taken")
    if taken.count() <= TAKEN:  # keys alone are shuffled, texts stay where they are read
        taken = F.broadcast(taken)
    found = rows.join(taken, key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return found.select(*map(column, docs.columns))


def op4_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by their sources' weights: nulls, empty texts and repeats as mix() says."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
