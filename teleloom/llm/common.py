"""Helpers shared by the corpus operators: word rules, folders, sized broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.session import ensure_checkpoint_dir

# White space between words in every operator: the ASCII blanks only.
BLANKS = r"[\x20\x09-\x0D]+"
ARROW_BYTES = 8 << 20
#: A side is broadcast only if its measured rows, at the caller's bytes a row, stay below this.
BROADCAST_BYTES = 16 << 20
#: Upper bound of a broadcast row that holds one digest in hexadecimal digits, and a key.
DIGEST_BYTES = 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that very long texts do not meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def word_array(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def kept(frame: DataFrame) -> DataFrame:
    """The frame cut from its lineage in the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def broadcast_if_small(frame: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the (kept) frame's measured bytes fit; otherwise Spark shuffles both sides.

    ``row_bytes`` is an upper bound of every row's size, or a column that gives each row's own.
    """
    each = F.lit(row_bytes).cast("bigint") if isinstance(row_bytes, int) else row_bytes
    measured = frame.agg(F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(frame) if measured <= limit else frame


def fresh(columns: list[str], name: str) -> str:
    """The name, with leading underscores until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def marked(value: Column) -> Column:
    """A text that tells every value from every other and from null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def row_identity(key: Column, text: Column) -> Column:
    """128 bits that stand for a row's key and whole text; a null is a value of its own."""
    return F.md5(F.concat(marked(key), F.lit("\0"), marked(text)))


def without(docs: DataFrame, identity: Column, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The rows whose identity is not among ``gone``; of those whose identity is among ``repeated``, one each.

    Both are frames of one column of digests. Rows are shuffled with their texts only if some are repeated.
    """
    name = fresh(docs.columns, "identity")
    named = docs.withColumn(name, identity)
    left = named.join(broadcast_if_small(gone.toDF(name), DIGEST_BYTES), name, "left_anti")
    if repeated is not None and not repeated.isEmpty():
        some = broadcast_if_small(repeated.toDF(name), DIGEST_BYTES)
        left = left.join(some, name, "left_anti").unionByName(left.join(some, name, "left_semi").dropDuplicates([name]))
    return left.drop(name)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node with an edge.

    Alternating large-star and small-star rounds: every round joins nothing, it groups edges by node and
    hangs the neighbours below the smallest one. A node's neighbours are never gathered: the minimum is a
    plain aggregate that is joined back, so that Spark can split a node with very many edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = kept(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = None
    while True:
        # Large star: every larger neighbour of a node hangs below the node's smallest neighbour.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours hang below the smallest of these.
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = kept(small.where("u <> v").distinct())
        # Done when a round changes nothing: every node then hangs below its component's smallest node.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == total:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        pairs, total = after, state
