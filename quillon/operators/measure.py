"""Where the time of a batch of answers goes: rows, bytes and time of each stage of one pass.

Each stage is written once, as a table that the next one reads, so no stage is run twice to be measured.
A listener hears of every finished execution and keeps those that wrote such a table; what it tells is
read from the plan that was run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from types import TracebackType

from py4j.java_gateway import JavaObject
from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import DataFrame, SparkSession

from quillon.sources.scratch import keep, paths


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """All nodes of a plan that was run; what was reused is counted where it was made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    elif kind == "CommandResultExec":
        yield from _nodes(plan.commandPhysicalPlan())
    elif kind != "ReusedExchangeExec":
        yield plan
        children = plan.children()
        for k in range(children.size()):
            yield from _nodes(children.apply(k))


def _metric(node: JavaObject, name: str) -> int:
    found = node.metrics().get(name)
    return int(found.get().value()) if found.isDefined() else 0


def _target(node: JavaObject) -> str | None:
    """The folder that a writing node writes."""
    if node.getClass().getSimpleName() != "DataWritingCommandExec":
        return None
    cmd = node.cmd()
    return str(cmd.outputPath().toString()) if cmd.getClass().getSimpleName() == "InsertIntoHadoopFsRelationCommand" else None


class Executions:
    """Writes that were finished while this was open, by the folder they wrote."""

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    def __init__(self, spark: SparkSession):
        self.spark, self.found = spark, {}

    def __enter__(self) -> Executions:
        ensure_callback_server_started(self.spark.sparkContext._gateway)
        self.spark._jsparkSession.listenerManager().register(self)
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.spark._jsparkSession.listenerManager().unregister(self)

    def onSuccess(self, name: str, execution: JavaObject, nanos: int) -> None:  # noqa: N802  the interface's name
        nodes = list(_nodes(execution.executedPlan()))
        written = [(t, n) for n in nodes if (t := _target(n))]
        if not written:
            return
        target, node = written[0]
        scans = [n for n in nodes if n.getClass().getSimpleName() == "FileSourceScanExec"]
        self.found[_plain(target)] = {
            "ms": nanos / 1e6, "rows_written": _metric(node, "numOutputRows"), "bytes_written": _metric(node, "numOutputBytes"),
            "rows_read": sum(_metric(n, "numOutputRows") for n in scans), "bytes_in_files": sum(_metric(n, "filesSize") for n in scans),
        }

    def onFailure(self, name: str, execution: JavaObject, error: JavaObject) -> None:  # noqa: N802  the interface's name
        pass

    def of(self, df: DataFrame) -> dict[str, float]:
        """What was measured when ``df``, a kept table, was written."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        (path,) = paths(df)
        return self.found[_plain(path)]


def _plain(path: str) -> str:
    return "/" + path.split("://")[-1].split(":", 1)[-1].strip("/")


def measured(spark: SparkSession, stages: dict[str, Callable[[DataFrame | None], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The last stage's table, and a row for each stage: stage, ms, rows and bytes written, rows read, bytes of the files read.

    A stage gets the table of the one before. A stage's own small tables, made on its way, count to
    the time but not to its rows.
    """
    table, rows = None, []
    with Executions(spark) as executions:
        for name, stage in stages.items():
            began = time.perf_counter()
            table = keep(stage(table), f"measured-{name}")
            total = (time.perf_counter() - began) * 1000
            own = executions.of(table)
            rows.append((name, total, own["ms"], own["rows_written"], own["bytes_written"], own["rows_read"], own["bytes_in_files"]))
    return table, spark.createDataFrame(rows, "stage string, ms double, write_ms double, rows_written long, bytes_written long, rows_read long, bytes_in_files long")
