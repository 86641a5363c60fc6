"""Jobs as streams of events: current state, reuse of running jobs, log lines from byte chunks, incremental recomputation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def state(events: DataFrame, job: str = "job_id", kind: str = "kind", order: Column | None = None, progress: str = "pct") -> DataFrame:
    """Per job the last kind, progress from 0 to 100, and the number of events: the same on a batch and, in complete mode, on a stream."""
    order = F.struct("ts") if order is None else order
    return events.groupBy(job).agg(
        F.max_by(kind, order).alias("state"), F.least(F.lit(100), F.greatest(F.lit(0), F.max(progress))).alias("progress"), F.count(F.lit(1)).alias("steps"),
    )


def running(states: DataFrame, by: list[str], job: str = "job_id") -> DataFrame:
    """For every key the running job that a new request joins."""
    return states.where("state = 'running'").groupBy(*by).agg(F.min(job).alias(job))


def lines(chunks: DataFrame, job: str = "job_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Stream of (job, seq, chunk) to stream of (job, line, pct): chunks are cut at CR or LF, a partial last line waits for the next chunk.

    Of the lines, those with a percentage or the word error are kept, and every sixth of the others.
    """
    kind = chunks.schema[job].dataType.simpleString()

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = held.get if held.exists else ("", 0)
        out = []
        for part in pd.concat(list(batches)).sort_values(seq)[chunk]:
            *whole, rest = (rest + part).replace("\r", "\n").split("\n")
            for line in whole:
                text = line.strip()
                if not text:
                    continue
                found = pd.Series([text]).str.extract(r"(\d{1,3})\s*%")[0][0]
                n += 1
                if isinstance(found, str) or "error" in text.lower() or n % 6 == 0:
                    out.append((key[0], text, min(100, int(found)) if isinstance(found, str) else None))
        held.update((rest, n))
        yield pd.DataFrame(out, columns=[job, "line", "pct"]).astype({"pct": "Int32"})

    return chunks.groupBy(job).applyInPandasWithState(run, f"`{job}` {kind}, line string, pct int", "rest string, n int", "append", GroupStateTimeout.NoTimeout)


def incremental(source: DataFrame, path: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]):
    """Work on new rows as they come and upsert the results by key into the table at path; each batch writes a new version and then names it.

    Started with availableNow: what there is, is worked on, and the query ends.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = work(batch.dropDuplicates(keys))
        target = f"{path}/v{number}"
        older = f"{path}/v{number - 1}"
        if number:
            base = spark.read.parquet(older)
            new = base.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(target)

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
