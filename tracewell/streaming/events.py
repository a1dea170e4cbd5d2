"""Runs as streams of events, folded back to one row per run, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import tumbling
from ..plans.scratch import Scratch, shared_folder

EVENT = "run_id bigint, seq bigint, event_type string, text string"
FOLDED = "run_id bigint, n_events bigint, n_approved bigint, n_rejected bigint, refused boolean, prose string, complete boolean"


def events_of(gated: DataFrame, runs: DataFrame) -> DataFrame:
    """The event table ``run_id, seq, event_type, text`` of ``runs(run_id, prose, refused)`` and their gated claims.

    Each run gives planned, one event per claim in order, its prose or its refusal, and done.
    """
    def one(kind: str, seq, text):
        return F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("event_type"), text.alias("text"))

    ends = runs.select("run_id", F.inline(F.array(one("planned", F.lit(0), F.lit(None).cast("string")), F.when(F.coalesce("refused", F.lit(False)), one("refused", F.lit(1 << 30), F.col("prose"))).otherwise(one("token", F.lit(1 << 30), F.col("prose"))), one("done", F.lit((1 << 30) + 1), F.lit(None).cast("string")))))
    claims = gated.select("run_id", (F.col("ord") + 1).alias("seq"), F.when(F.col("status") == "approved", "claim_approved").otherwise("claim_rejected").alias("event_type"), F.col("reason").alias("text"))
    return ends.unionByName(claims)


def folded(events: DataFrame) -> DataFrame:
    """One row per run (see ``FOLDED``); a run without its done event isn't complete. Text comes in event order."""
    words = F.array_sort(F.collect_list(F.when(F.col("event_type").isin("token", "refused"), F.struct("seq", "text"))))
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "claim_approved").alias("n_approved"),
        F.count_if(F.col("event_type") == "claim_rejected").alias("n_rejected"),
        F.bool_or(F.col("event_type") == "refused").alias("refused"),
        F.array_join(F.transform(words, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("prose"),
        F.bool_or(F.col("event_type") == "done").alias("complete"),
    )


def folded_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream: a run's row comes out with its done event, and its state is dropped.

    State is kept per run and holds counts and the texts so far, in event order. Events that come
    after done open a run of their own that never completes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ok, bad, refused, seqs, texts = state.get if state.exists else (0, 0, 0, False, [], [])
        seqs, texts, done = list(seqs), list(texts), False
        for b in batches:
            kinds = b["event_type"]
            n, ok, bad = n + len(b), ok + int((kinds == "claim_approved").sum()), bad + int((kinds == "claim_rejected").sum())
            refused, done = bool(refused or (kinds == "refused").any()), bool(done or (kinds == "done").any())
            spoken = b[kinds.isin(["token", "refused"])]
            seqs += [int(x) for x in spoken["seq"]]
            texts += [x if isinstance(x, str) else "" for x in spoken["text"]]
        if done:
            state.remove()
            prose = "".join(t for _, t in sorted(zip(seqs, texts, strict=True)))
            yield pd.DataFrame([(key[0], n, ok, bad, refused, prose, True)], columns=[c.split()[0] for c in FOLDED.split(", ")])
        else:
            state.update((n, ok, bad, refused, seqs, texts))

    kept = "n bigint, ok bigint, bad bigint, refused boolean, seqs array<bigint>, texts array<string>"
    return events.groupBy("run_id").applyInPandasWithState(step, FOLDED, kept, "append", GroupStateTimeout.NoTimeout)


def run_stream(events_path: str, scratch: Scratch, spark) -> DataFrame:
    """Reads what stands in ``events_path`` as a stream, folds it, and gives the written result."""
    source = spark.readStream.schema(EVENT).parquet(events_path)
    out = f"{scratch.root}/stream-out"
    q = folded_stream(source).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", f"{scratch.root}/stream-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(FOLDED).parquet(out)


def in_batches(rows: DataFrame, sink, spark, path: str) -> None:
    """Streams a folder of events to ``sink(rows, batch_id)``, a ``foreachBatch`` sink."""
    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{shared_folder(spark)}/{path}").trigger(availableNow=True).start()
    q.awaitTermination()


def frames(events: DataFrame) -> DataFrame:
    """Each event as a server-sent frame, in order: ``run_id, seq, frame``."""
    data = F.to_json(F.struct("run_id", "seq", "text"), {"ignoreNullFields": "false"})
    return events.select("run_id", "seq", F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))


def late_windows(arrivals: DataFrame, at: str, width: str, delay: str, by: list[str], value: str) -> DataFrame:
    """``ordered.tumbling`` over a stream: a window is given out once the watermark, ``delay`` behind the latest ``at``, has passed it.

    Events that come later than that are dropped; state is kept for open windows only.
    """
    return tumbling(arrivals.withWatermark(at, delay), at, width, by, value)
