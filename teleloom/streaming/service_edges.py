"""The service map kept up to date from a stream of spans: spans meet their parents, and minutes add up.

Child and parent meet in a stream-stream join, in either order of arrival. A span waits for its partner until the
watermark passes the latest time at which that may have started. Every match is handed on once, as a fact of its
minute, and micro-batches store the states of their facts under their batch id: a replayed batch replaces its own
rows, and a match that comes late adds to its minute. ``service_map.edges_from_states`` and the other readers merge them.

A call is left out if its parent started more than ``longest_s`` before it or more than ``skew_s`` after it, and if
either span came later than the watermark allows. The watermark goes by the called spans; without new ones nothing
is let go. The spans of a service count as its own without any waiting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from teleloom.functions.timing import unix_ns_to_timestamp
from teleloom.operators import service_map
from teleloom.operators.rollups import SERVICE_MAP_MINUTELY
from teleloom.operators.service_map import PARENT_KEY, START, Pair
from teleloom.sources import states

WATERMARK = "10 minutes"
LONGEST_S = 3600
SKEW_S = 60


def meeting(watermark: str = WATERMARK, longest_s: int = LONGEST_S, skew_s: int = SKEW_S) -> Pair:
    """A stand-in for ``service_map.by_key`` on streams."""

    def pair(child: DataFrame, parent: DataFrame) -> DataFrame:
        called = child.withColumn("_called", unix_ns_to_timestamp(F.col(START))).withWatermark("_called", watermark)
        calling = parent.select(*[F.col(c).alias(f"_{c}") for c in PARENT_KEY], "source", unix_ns_to_timestamp(F.col(START)).alias("_calling"))
        calling = calling.withWatermark("_calling", watermark)
        same = [F.col(c) == F.col(f"_{c}") for c in PARENT_KEY]
        near = [
            F.col("_calling") >= F.col("_called") - F.expr(f"INTERVAL {int(longest_s)} SECONDS"),
            F.col("_calling") <= F.col("_called") + F.expr(f"INTERVAL {int(skew_s)} SECONDS"),
        ]
        return called.join(calling, [*same, *near]).drop(*[f"_{c}" for c in PARENT_KEY], "_called", "_calling")

    return pair


def service_map_stream(
    spans: DataFrame,
    root: str,
    checkpoint: str,
    watermark: str = WATERMARK,
    longest_s: int = LONGEST_S,
    skew_s: int = SKEW_S,
    **trigger,
) -> StreamingQuery:
    """Store the minutely states of the service map below ``root``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    facts = service_map.calls(spans, pair=meeting(watermark, longest_s, skew_s))
    writer = facts.writeStream.foreachBatch(lambda df, batch_id: states.write_states(df, SERVICE_MAP_MINUTELY, root, batch_id))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
