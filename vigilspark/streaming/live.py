"""Live mode: files of raw lines to typed rows, hourly counts behind a watermark, and figures with state: rows of a source,
the address that a pid had before, failed logins of an address."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilspark.functions.encode import failure_address
from vigilspark.operators.parse import ebpf


def kernel_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Rows of kernel-event text files as they land; the checkpoint of the query that reads them is the cursor."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    parsed = lines.select(F.col("value").alias("raw_line"), ebpf(F.col("value")).alias("p")).filter("p is not null")
    return parsed.select(F.col("p.ts").cast("timestamp").alias("timestamp"), "p.source", "p.event_type", "p.src_ip", "raw_line")


def hourly_counts(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour").alias("hour"), "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("hour.start").alias("hour"), "source", "n")


def running_counts(rows: DataFrame) -> DataFrame:
    """Rows of each source so far, with state kept by Spark across micro-batches."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(map(len, batches))
        state.update((n,))
        yield pd.DataFrame({"source": [key[0]], "n": [n]})

    return rows.groupBy("source").applyInPandasWithState(count, "source string, n long", "n long", "update", "NoTimeout")


#: State in RocksDB, which transformWithState needs, and no micro-batches without rows, which the forgetting of state by
#: processing time would ask for without end where a query is to stop by itself. To be set before a query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def use_state_store(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


class _Addresses(StatefulProcessor):
    """Of a (file, pid): the latest address and session. Forgotten keep_ms after they were last set."""

    def __init__(self, order: str, keep_ms: int) -> None:
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "src_ip string, session_id string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        known = self.latest.get() if self.latest.exists() else None
        ips, sessions, changed = pdf["src_ip"].tolist(), pdf["session_id"].tolist(), False
        for k, ip in enumerate(ips):
            if ip is not None:
                known, changed = (ip, sessions[k]), True
            elif known is not None:
                ips[k] = known[0]
                sessions[k] = known[1] if sessions[k] is None else sessions[k]
        if changed:
            self.latest.update(known)
        yield pdf.assign(src_ip=pd.Series(ips, dtype=object), session_id=pd.Series(sessions, dtype=object))

    def close(self) -> None:
        pass


def live_addresses(rows: DataFrame, file: str = "path", order: str = "line_no", keep_s: int = 7 * 86400) -> DataFrame:
    """enrich_by_pid() on a stream: rows without address take the latest address and session that their pid had before in
    the same file. Files come in order of their lines; a micro-batch may hold its lines in any order. Rows without a pid pass
    as they are. The memory of a pid lasts keep_s of processing time."""
    named = rows.filter("pid is not null")
    done = named.groupBy(file, "pid").transformWithStateInPandas(statefulProcessor=_Addresses(order, keep_s * 1000), outputStructType=rows.schema, outputMode="Append", timeMode="ProcessingTime")
    return done.unionByName(rows.filter("pid is null"))


class _Failures(StatefulProcessor):
    """Of an address: microseconds of its failures within the last seconds, oldest first."""

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "us long", 2 * self.span // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values("us", kind="stable").reset_index(drop=True)
        us = pdf["us"].to_numpy(dtype=np.int64)
        held = np.array([r[0] for r in self.times.get()] if self.times.exists() else [], dtype=np.int64)
        times = np.sort(np.concatenate((held, us)))
        yield pdf.assign(failures=np.searchsorted(times, us, side="right") - np.searchsorted(times, us - self.span, side="left"))
        self.times.put([(int(t),) for t in times[times >= times[-1] - self.span]])

    def close(self) -> None:
        pass


def live_failures(events: DataFrame, seconds: int = 300, threshold: int = 5) -> DataFrame:
    """failed_logins_within() on a stream whose micro-batches come in order of time: id, failed_ip, us, failures, action. A
    row that is late by more than the seconds counts what its address still has in memory."""
    found = F.filter(F.array(failure_address(F.col("raw_line"))), lambda ip: ip.isNotNull())
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("timestamp"))
    failed = events.filter("source = 'auth_log' and timestamp is not null").select("id", F.explode(found).alias("failed_ip"), us.alias("us"))
    schema = T.StructType([*failed.schema.fields, T.StructField("failures", T.LongType())])
    counted = failed.groupBy("failed_ip").transformWithStateInPandas(statefulProcessor=_Failures(seconds), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
    return counted.withColumn("action", F.when(F.col("failures") >= threshold, 3).when(F.col("failures") >= threshold // 2, 1).otherwise(0))
