"""Messages straight into the memory table, as they come: keyed state under a watermark, then an ordered merge.

A message waits in its conversation's state until the watermark has passed its time, so whatever order micro-batches bring, messages
leave in the conversation's order and once. The state remembers the keys of what has left (a message's normalized content, a
finding's category and start), which makes repeats of any kind no new findings, and it ends when a conversation has been
silent for `idle`: what is held at any time follows the conversations that are active, not all that ever were.

Messages of one conversation are taken to have times in the order of their numbers. A message later than `delay` behind the
newest one is not taken any more (Spark's rule for watermarks); ingest it by MemoryTable.merge, which has the same result. A
conversation that goes on after `idle` counts as a new one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.classify import findings
from ..functions.text import content_key, normalized, provenance
from ..operators.store import memory_rows
from ..sources.memory_table import MemoryTable

_FOUND = "array<struct<class_order:int,category:string,content:string,confidence:double,importance:double,status:string,key:string>>"
_OUT = "conversation_id string, project_id string, msg_index int, role string, ts timestamp, found string"


def released_messages(messages: DataFrame, delay: str = "1 hour", idle_seconds: int = 86400) -> DataFrame:
    """Findings of a stream of messages(conversation_id, project_id, msg_index, role, content, ts), each once and final: (…, found) a message."""
    keyed = F.transform(findings(F.col("content")), lambda f: F.struct(f["class_order"].alias("class_order"), f["category"].alias("category"), f["content"].alias("content"), f["confidence"].alias("confidence"),
                        f["importance"].alias("importance"), f["status"].alias("status"), F.left(normalized(f["content"]), F.lit(200)).alias("key")))
    light = messages.withWatermark("ts", delay).select("conversation_id", "project_id", "msg_index", "role", "ts", content_key(F.col("content")).alias("key"), F.to_json(keyed).alias("found"))

    def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "said": [], "found": [], "last": 0}
        if not state.hasTimedOut:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    at = int(row.ts.timestamp() * 1000)
                    held["waiting"].append([int(row.msg_index), at, row.project_id, row.role, row.key, row.found, row.ts.value])
                    held["last"] = max(held["last"], at)
        mark = state.getCurrentWatermarkMs()
        ready = sorted(w for w in held["waiting"] if w[1] <= mark)
        held["waiting"] = [w for w in held["waiting"] if w[1] > mark]
        said, known, out = set(held["said"]), set(held["found"]), []
        for index, _, project, role, content, found, ts in ready:
            if content in said:
                continue
            said.add(content)
            kept = [f for f in json.loads(found) if (name := f"{f['category']}:{f['key']}") not in known and not known.add(name)]
            if kept:
                out.append((key[0], project, index, role, pd.Timestamp(ts, unit="ns"), json.dumps(kept)))
        end = held["last"] + 1000 * idle_seconds
        if not held["waiting"] and mark >= end:
            state.remove()
        else:
            held["said"], held["found"] = sorted(said), sorted(known)
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(mark + 1, min([w[1] for w in held["waiting"]], default=end)))
        yield pd.DataFrame(out, columns=["conversation_id", "project_id", "msg_index", "role", "ts", "found"])

    return light.groupBy("conversation_id").applyInPandasWithState(release, _OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_memories(messages: DataFrame, table: MemoryTable, checkpoint: str, now: Column | None = None, delay: str = "1 hour", idle_seconds: int = 86400) -> StreamingQuery:
    """Merges a stream of messages(conversation_id, project_id, msg_index, role, content, ts) into the table.

    now: a memory's time of writing, its message's own time if not given; a micro-batch that runs again writes the same again.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("f", F.explode(F.from_json("found", _FOUND))).select("conversation_id", "project_id", "msg_index", "role", "ts", "f.*")
        rows = rows.withColumn("provenance", provenance(F.col("conversation_id"), F.col("msg_index")))
        rows = memory_rows(rows, also=("ts",)).persist()
        try:
            if not rows.isEmpty():
                table.merge(rows, F.col("ts") if now is None else now, ordered=True)
        finally:
            rows.unpersist()

    released = released_messages(messages, delay, idle_seconds)
    return released.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
