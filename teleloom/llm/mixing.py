"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.llm.common import broadcast_if_small, fresh, kept

# 52 bits of a digest make the uniform number, exactly as any other engine computes it.
HEX_DIGITS = 13
#: Largest mean of one Poisson draw. A larger rate is the sum of several equal draws, which is Poisson again, so that a
#: tiny source in a very large mix needs no long table.
DRAW_RATE = 512
#: Copies of one draw are numbered within so many; a table of a draw is shorter.
DRAW_COPIES = 1000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    seed = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(seed, 256), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(1 << 4 * HEX_DIGITS))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, source: str) -> DataFrame:
    """(source, rate): mean repetitions that give each source its share of ``total`` rows.

    Counts cover all rows. Without weights all sources weigh the same; a source missing in the weights, or
    with a weight of zero, gets none. Without a total, the mix has as many rows as the input.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        weighted = counts.withColumn("_w", F.lit(1.0))
    else:
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        weighted = counts.withColumn("_w", F.coalesce(F.element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0)) if pairs else F.lit(0.0))
    sums = weighted.agg(F.sum("_w").alias("_all_w"), F.sum("_n").alias("_all_n")).withColumn("_one", F.lit(1))
    goal = F.col("_all_n").cast("double") if total is None else F.lit(float(total))
    joined = weighted.withColumn("_one", F.lit(1)).join(F.broadcast(sums), "_one")  # one row
    return joined.where("_w > 0").select("_source", (F.col("_w") / F.col("_all_w") * goal / F.col("_n")).alias("_rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """(source, draws, cdf): how many draws a source's rows take, and the distribution function of one draw.

    The function goes up to where it is 1; ``DRAW_RATE`` bounds it to fewer than ``DRAW_COPIES`` entries.
    """
    rates = rates.withColumn("_draws", F.greatest(F.ceil(F.col("_rate") / DRAW_RATE), F.lit(1)).cast("int"))
    rates = rates.withColumn("_rate", F.col("_rate") / F.col("_draws"))
    top = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 24).cast("int")
    steps = rates.select("_source", "_draws", "_rate", F.explode(F.sequence(F.lit(0), top)).alias("_k"))
    ordered = Window.partitionBy("_source").orderBy("_k")
    # ln p(k) = -rate + k ln(rate) - ln k!
    log_factorial = F.sum(F.log(F.greatest(F.col("_k"), F.lit(1)).cast("double"))).over(ordered)
    steps = steps.withColumn("_p", F.exp(-F.col("_rate") + F.col("_k") * F.log("_rate") - log_factorial))
    steps = steps.withColumn("_c", F.sum("_p").over(ordered))
    return steps.groupBy("_source", "_draws").agg(F.sort_array(F.collect_list("_c")).alias("_cdf"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: str = "mix",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """The rows of all sources, each repeated by a Poisson count, in shuffled order.

    A row's count inverts the Poisson law of its source at a number hashed from (seed, key): the same on
    every run, no matter how rows are partitioned. Copies are numbered from 1 in ``copy``, and dealt
    and sorted by ``shuffle_key``, a hash of (seed, key, copy). A rate above ``DRAW_RATE`` is drawn in several parts,
    spread over the tasks; part ``i``, from 0, numbers its copies from ``i * DRAW_COPIES + 1``.

    A null source is a source of its own, without a weight if weights are given. A null key hashes as an
    empty one. Repeated rows get the same count each. Existing columns ``copy`` and ``shuffle_key`` are
    replaced, as the result must have one of each; columns of any other name pass. An empty table, or no weight above
    zero, gives no rows.
    """
    docs = docs.drop("copy", "shuffle_key")
    law = kept(poisson_table(repetition_rates(docs, weights, total, source)))
    many = not law.where("_draws > 1").isEmpty()
    own = {c: fresh(docs.columns, c) for c in ("_source", "_draws", "_cdf", "_part", "_count")}
    part, count = own["_part"], own["_count"]
    law = broadcast_if_small(law, 64 + 8 * F.size("_cdf")).withColumnsRenamed(own)
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if many:
        # One row may become a large share of the mix: its draws are dealt to all tasks before they are made.
        draws = law.select(own["_source"], own["_draws"])
        parts = docs.join(draws, F.col(source).eqNullSafe(F.col(own["_source"]))).withColumn(part, F.explode(F.sequence(F.lit(0), F.col(own["_draws"]) - 1)))
        docs = parts.drop(own["_source"], own["_draws"]).repartition(F.xxhash64(named, part))
        number = F.when(F.col(part) == 0, uniform(seed, named)).otherwise(uniform(seed, named, F.col(part).cast("string")))
        first = F.col(part) * DRAW_COPIES
    else:
        number, first = uniform(seed, named), F.lit(0)
    joined = docs.join(law, F.col(source).eqNullSafe(F.col(own["_source"])))
    # What a lambda takes from outside is computed for every entry; its own variables are not.
    drawn = joined.withColumn(count, F.get(F.transform(F.array(number), lambda u: F.size(F.filter(own["_cdf"], lambda c: c <= u))), F.lit(0)))
    copies = drawn.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(first + 1, first + F.col(count))))
    copies = copies.drop(*own.values())
    keyed = copies.withColumn("shuffle_key", F.substring(F.sha2(F.concat_ws(":", F.lit(seed), named, F.col("copy").cast("string")), 256), 1, 16))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
