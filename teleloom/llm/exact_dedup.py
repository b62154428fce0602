"""Exact duplicates by a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import BLANKS, kept, marked, without

#: Runs at the leaves, and runs that one merge takes: partners of a round differ in one digit of their numbers.
RUNS = 256
FAN_IN = 16
#: A text's identity: its digest, and what every merge verifies beside it.
SAME = ["digest", "n_bytes", "proof"]
#: Slices of the digests; each slice of a run is sorted and merged by itself, so that no run is in one task.
SLICE_BITS = 16


def normalised(text: Column) -> Column:
    """The text with every series of ASCII blanks replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", runs: int = RUNS) -> DataFrame:
    """(key, run, digest, n_bytes, proof): the leaf run of a row depends on its key alone.

    ``proof`` is a second hash of another family. Equal digests count as equal texts only if the byte
    length and the proof agree too, which every merge verifies by having them in its key.
    """
    body = normalised(F.col(text))
    return docs.select(F.col(key), F.pmod(F.xxhash64(key), F.lit(runs)).cast("int").alias("run"), body.alias("body")).select(
        key,
        "run",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.octet_length("body").alias("n_bytes"),
        F.xxhash64("body").alias("proof"),
    )


def leaf_runs(rows: DataFrame, key: str) -> DataFrame:
    """Sorted leaf runs (run, slice, digest, n_bytes, proof, least, group_size), with one row for each text.

    ``least`` holds the smallest key that is not null. Being a struct, it makes Spark reduce rows by sorting: every
    task hands on a sorted run of its own, already without repeats, and the exchange brings the runs of a slice
    together. A text held by a third of all rows leaves each task as one row for each run.
    """
    named = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key")))
    part = F.conv(F.hex(F.substring("digest", 1, SLICE_BITS // 8)), 16, 10).cast("int")
    reduced = rows.withColumn("slice", part).groupBy("run", "slice", *SAME)
    return reduced.agg(F.min(named).alias("least"), F.count("*").alias("group_size"))


def merge_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` neighbouring runs become one, sorted and with one row for each text.

    Runs are exchanged by slice, ordered, and merged in that order by a sorted aggregate, without another exchange. Of
    the rows of a text, verified by digest, length and second hash, the smallest key and the sum of counts stay.
    """
    moved = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    ordered = moved.repartition("run", "slice").sortWithinPartitions("run", "slice", *SAME)
    return ordered.groupBy("run", "slice", *SAME).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))


def exact_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """Every row with its text's group: (key, keep_id, group_size, kept, text_sha256).

    The rows form ``runs`` leaf runs, sorted by digest and cut into slices of the digests. Each run is reduced to one row
    for each text with the smallest key and a count; in every round ``fan_in`` runs exchange their slices and are merged,
    until one run is left. The verdict then goes down to the leaf runs and from there to the rows, so that even a text
    held by a third of all rows is spread over the leaf runs in both directions.

    Null and empty texts are one text, texts of blanks only are another (one space). Ties keep the smallest
    key; rows that repeat a key all count and are all kept if the key is. Other columns are not
    read. An empty table gives no rows.
    """
    rows = kept(digests(docs, text, key, runs))
    leaves = leaf_runs(rows, key)
    level, left = leaves, runs
    while left > 1:
        level, left = merge_runs(level, fan_in), -(-left // fan_in)
    verdict = level.select(*SAME, F.col("least.key").alias("keep_id"), "group_size")
    down = leaves.select("run", *SAME).join(verdict, SAME)
    joined = rows.join(down, ["run", *SAME])
    return joined.select(
        key,
        "keep_id",
        "group_size",
        F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of equal texts one row stays, with all its columns: one with the smallest key.

    A row without a key stays only if no equal text has one. Of rows that repeat key and text one stays,
    whatever its other columns hold. A key that stands for several texts is no obstacle: each text is judged
    by itself. Null and empty texts are equal.
    """
    named = lambda k, digest: F.concat(F.lit("x"), digest, marked(k))
    judged = exact_duplicates(docs, text, key).where("not kept or group_size > 1")
    verdict = judged.select("kept", named(F.col(key), F.col("text_sha256")).alias("identity"))
    verdict = kept(verdict.groupBy("identity").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"))
    gone, repeated = verdict.where("not kept").select("identity"), verdict.where("kept").select("identity")
    return without(docs, named(docs[key], F.sha2(normalised(docs[text]), 256)), gone, repeated)
