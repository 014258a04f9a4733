"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies in a mix: what the source must contribute over
what it has, at most max_uses. Along an order of the source's documents the expected copies are summed up from one
random offset; a document is emitted once for each whole number that its own share of the sum crosses. So it comes
floor or ceil of the expected number of times, never more than max_uses, and any stretch of the order is represented
to within one copy. The order goes by size class and then by hash, which keeps the tokens close to the target too.

The prefix sums need no task that sees a whole source: documents are ranked inside (source, size class, salt) and the
counts of these cells are summed up. Sums are whole numbers in units of 2**-20 copies, exact at any size.
Defined cases: sources are compared trimmed and in lower case; a null source, a null or empty text or a size of 0
contributes nothing; targets of unknown sources are reported as reaching nothing; repeated rows are documents of
their own; ties in the order go by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.text import trimmed_lower
from vectide.session import durable

UNIT = 20
BROADCAST_ROWS = 10_000


def plan(sizes: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """(mix_id, source, wanted, available, max_uses, enough, step, offset): step and offset in units of 2**-20 copies.

    sizes: doc_id, source, n_tokens. One row per target; step is 0 for a source without documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    everything = sizes.agg(F.sum("n_tokens").alias("all_tokens"))
    goal = targets.select("mix_id", trimmed_lower(F.col("source")).alias("source"), "target_share", "max_uses", "size_ratio").where("source is not null")
    # one row joined: the sum over all sources
    joined = goal.join(per_source, "source", "left").join(F.broadcast(everything), how="left")
    wanted = F.coalesce(F.col("target_share") * F.col("size_ratio") * F.col("all_tokens"), F.lit(0.0))
    available = F.coalesce("available", F.lit(0))
    copies = F.least(wanted / F.nullif(available, F.lit(0)), F.col("max_uses").cast("double"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(1 << UNIT))
    return joined.select(
        "mix_id", "source", "target_share", "max_uses", wanted.alias("wanted"), available.alias("available"),
        (available * F.col("max_uses") >= wanted).alias("enough"), F.coalesce(F.round(copies * (1 << UNIT)), F.lit(0)).cast("long").alias("step"), offset.alias("offset"),
    )


def ranked(sizes: DataFrame, salts: int = 1024) -> DataFrame:
    """sizes with the rank of each document in its source's order, from 1."""
    cell = ["source", "size_class", "salt"]
    rows = sizes.withColumn("size_class", F.floor(F.log2("n_tokens") * 2).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id"))
    return rows.withColumn("inside", inside).join(starts, cell).withColumn("rank", F.col("start") + F.col("inside")).drop("start", "inside", "size_class")


def select(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, uses) of the documents that a mix uses."""
    docs = ranked(sizes)
    steps = planned.where("step > 0").select("mix_id", "source", "step", "offset")
    if steps.count() <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(steps), "source")
    else:
        spread = steps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(1023)))).withColumn("salt", F.col("salt").cast("int"))
        joined = docs.join(spread, ["source", "salt"])
    end = F.col("offset") + F.col("step") * F.col("rank")
    uses = F.shiftright(end, UNIT) - F.shiftright(end - F.col("step"), UNIT)
    return joined.select("mix_id", "source", "doc_id", "n_tokens", uses.alias("uses")).where("uses > 0")


def report(selected: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target what was wanted and reached: shares are of the tokens of the whole mix, deviation is of the wanted tokens."""
    reached = selected.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    both = planned.join(reached, ["mix_id", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    share = tokens / F.nullif(F.sum(tokens).over(Window.partitionBy("mix_id")), F.lit(0))
    return both.select("mix_id", "source", "target_share", "max_uses", "wanted", "available", "enough", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), share.alias("actual_share"),
                       (tokens / F.nullif("wanted", F.lit(0.0)) - 1).alias("deviation"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The selection and its report. sizes: doc_id, source, n_tokens."""
    rows = durable(sizes.select("doc_id", trimmed_lower(F.col("source")).alias("source"), "n_tokens").where("source is not null and n_tokens > 0"))
    planned = durable(plan(rows, targets, seed))
    selected = select(rows, planned)
    return selected, report(selected, planned)
