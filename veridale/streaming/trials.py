"""Trials of rules as a stream: a rule is announced once, when it becomes eligible for promotion.

State by rule, in a store that spills to disk: its sums, whether it was announced, and a map of its projects, so that a
rule with any number of projects is counted exactly. Tests of a batch are taken in the order of time, one after the other, and a rule counts as
eligible as soon as after any of them it has MIN_PROJECTS projects and a share of false positives under MAX_RATE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import store

MIN_PROJECTS, MAX_RATE = 3, 0.10
ANNOUNCED = "rule_id string, at timestamp, hits long, false_positives long, projects long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trials(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "hits long, false_positives long, projects long, announced boolean")
        self.projects = handle.getMapState("projects", "project string", "tests long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits, false, projects, announced = self.sums.get() if self.sums.exists() else (0, 0, 0, False)
        tests = pd.concat(list(rows)).sort_values(["ts", "test_id"])
        for ts, project, h, f in zip(tests["ts"], tests["project"], tests["hits"], tests["false_positives"]):
            if announced:
                break
            hits, false = hits + int(h), false + int(f)
            known = self.projects.getValue((project,))[0] if self.projects.containsKey((project,)) else 0
            projects += not known
            self.projects.updateValue((project,), (known + 1,))
            if projects >= MIN_PROJECTS and false < MAX_RATE * hits or projects >= MIN_PROJECTS and hits == 0:
                announced = True
                yield pd.DataFrame({"rule_id": [key[0]], "at": [ts], "hits": [hits], "false_positives": [false], "projects": [projects]})
        if announced:  # nothing more is asked of its projects
            self.projects.clear()
        self.sums.update((hits, false, projects, announced))

    def close(self) -> None:
        pass


def announced(tests: DataFrame) -> DataFrame:
    """ANNOUNCED rows of a stream of tests (test_id, ts, rule_id, project, hits, false_positives); rows without a rule, project or time are left out."""
    sound = tests.where("rule_id is not null and project is not null and ts is not null").fillna(0, ["hits", "false_positives"])
    return sound.groupBy("rule_id").transformWithStateInPandas(Trials(), ANNOUNCED, "Append", "None")


def run(stream: DataFrame, folder: str) -> DataFrame:
    """All that has been announced, after what is there now has been taken in: each micro-batch is added once to the log in the folder."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ON_DISK)
    try:
        query = (
            announced(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: store.append(batch, f"{folder}/announced", str(number)) and None).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return store.read(spark, f"{folder}/announced", ANNOUNCED)
