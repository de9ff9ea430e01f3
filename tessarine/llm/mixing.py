"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every row has a 60-bit hash: 40 bits of what it says, then 20 of its place, which only tell equal rows apart. A source takes whole rounds of itself while its target allows, and of the last round
the documents with the smallest hashes whose sizes fit. That threshold is found without sorting: sizes are summed by
source and the leading 12 bits of the hash, the running sum names the bucket in which the budget ends, and only that
bucket is summed again by the next 12 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessarine.llm._work import materialize

BITS, LEVELS = 12, 5
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLANKS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def spread_hash(doc_id: Column, text: Column) -> Column:
    """40 bits of the MD5 of id and text, nulls counting as empty, and 20 bits by the row's place."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    own = F.conv(F.substring(F.md5(said.cast("binary")), 1, 10), 16, 10).cast("long")
    return F.shiftleft(own, 20) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row per source.

    Sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 1.5 of all sizes. No target exceeds
    twice its source's size; the excess is shared again by weight. With sources ordered by size over weight, the ones
    that stop at their limit come first, so one running sum finds the level at which all others stand.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")))
    whole = Window.partitionBy()
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    limit = MOST * F.col("source_size")
    left = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.withColumn("level", left / weight).withColumn("open", limit > F.col("weight") * F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(whole)["level"]
    return levelled.select("source", "source_size", F.least(limit.cast("double"), F.coalesce(F.col("weight") * level, limit.cast("double"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): hashes below it fit the budget of their source, in hash order, and the next hash does not.

    ``sized``: source, size, h. ``budgets``: source, budget. A source whose documents all fit gets no row.
    """
    open_ = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.join(open_.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        summed = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("left").alias("left"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        ends = summed.withColumn("upto", F.sum("size").over(upto)).filter("upto > left")
        first = ends.withColumn("n", F.row_number().over(upto)).filter("n = 1")
        at = materialize(first.select("source", F.col("bucket").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("size"))).alias("left"), "low", "high"), "boundary")
        last = level == LEVELS - 1
        settled = at.filter(F.lit(last) | (F.col("low") == F.col("high"))).select("source", F.col("low").alias("below"))
        done = settled if done is None else done.unionByName(settled)
        open_ = at.filter("low < high").select("source", "left", "prefix")
        if last or open_.isEmpty():
            return done
    return done


def plan_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, text, source).

    Size is the number of words; a null text has none. Null is a source of its own. Repeated ids and null ids are rows
    like others; of equal rows as many are taken as fit. A source of empty texts has target 0. Hashes depend on id and
    text, but between equal rows, so reruns agree. No rows give no rows.
    """
    return _planned(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), spread_hash(F.col("doc_id"), F.col("text")).alias("h"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def _planned(sized: DataFrame) -> DataFrame:
    sized = materialize(sized, "sizes")
    goal = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("rounds", rounds.cast("long"))
    partial = goal.filter(F.col("rounds") < MOST).select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"))
    below = materialize(thresholds(sized, partial), "thresholds").select(F.col("source").alias("cut"), "below")
    plan = goal.join(below, F.col("source").eqNullSafe(F.col("cut")), "left").select(F.col("source").alias("of"), "source_size", "target", "rounds", "below")
    plan = materialize(plan, "plan")
    more = F.when((F.col("rounds") < MOST) & (F.col("below").isNull() | (F.col("h") < F.col("below"))) & (F.col("source_size") > 0), 1).otherwise(0)
    taken = sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    return taken.withColumn("taken", F.col("size") * (F.col("rounds") + more)).drop("of", "below", "rounds")


def mix_sources(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: not at all, once or twice. Rows without words stay once."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "source", n_words(F.col("text")).alias("size"), spread_hash(F.col("doc_id"), F.col("text")).alias("h"))
    planned = _planned(whole)
    times = F.when(F.col("size") == 0, 1).otherwise((F.col("taken") / F.col("size")).cast("int"))
    return planned.filter(times > 0).select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")
