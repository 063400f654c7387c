"""Window pipelines as streams (ST1-ST3, ST5-ST15, ST17, ST20). Event time is no part of them."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.control import MODES, should_stop


def source(spark: SparkSession, path: str, files: int = 1, name: str | None = None) -> DataFrame:
    """ST1, ST3: a stream over the Parquet files of a folder, at most `files` of them in a micro-batch."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(path)


class Run:
    """A started stream of steps; `stopped` tells whether a step ended it."""

    def __init__(self) -> None:
        self.stopped, self.query = threading.Event(), None

    def awaitTermination(self, timeout: float | None = None) -> bool:  # noqa: N802 - as StreamingQuery has it
        """Waits for the end; the error of a step is raised here, the stop that a step asked for is none."""
        try:
            ended = self.query.awaitTermination(timeout) if timeout else self.query.awaitTermination()
        except StreamingQueryException as error:
            if not self.stopped.is_set() or _StopRun.__name__ not in str(error):  # a failed sink or store is raised, stopped or not
                raise
            return True
        return bool(ended) if timeout else True

    def stop(self) -> None:
        self.query.stop()


class _StopRun(Exception):
    """Ends a query before a batch that comes after the stop; that batch stays unprocessed."""


def run(stream: DataFrame, step: Callable[[DataFrame, int], bool | None], checkpoint: str, once: bool = True) -> Run:
    """ST6, ST17, ST20: calls step(batch, number) for each micro-batch; False stops the query after that batch.

    The batch of the step that says False counts as processed, later ones do not and are there for the next run with the
    same checkpoint. Ends at the end of the input if `once`; an error in a step ends the query and is raised by
    awaitTermination.
    """
    out = Run()

    def each(batch: DataFrame, number: int) -> None:
        if out.stopped.is_set():
            raise _StopRun
        if step(batch, number) is False:
            out.stopped.set()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    out.query = (writer.trigger(availableNow=True) if once else writer).start()
    threading.Thread(target=lambda: (out.stopped.wait(), out.query.stop() if out.query.isActive and not once else None), daemon=True).start()
    return out


def keyed_sink(folder: str, column: str = "batch") -> Callable[[DataFrame, int], None]:
    """ST17: a sink that holds each batch under its number: a batch that is processed again replaces what it wrote before,
    so that every row is there exactly once, whatever was stopped, lost or repeated. Read the folder as Parquet."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{column}={number}")

    return write


#: Rows of the frames that generated pieces are gathered in.
PIECE_ROWS = 10_000


def _gathered(pieces: Iterator[pd.DataFrame | tuple], names: list[str], most: int = PIECE_ROWS) -> Iterator[pd.DataFrame]:
    """Frames of about `most` rows from frames and single rows (tuples in the order of names), in the order given."""
    rows: list[tuple] = []
    frames: list[pd.DataFrame] = []
    held = 0

    def turned():
        if rows:
            frames.append(pd.DataFrame(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))))
            rows.clear()

    for piece in pieces:
        if isinstance(piece, pd.DataFrame):
            if len(piece):
                turned()
                frames.append(piece[names])
                held += len(piece)
        else:
            rows.append(piece)
            held += 1
        if held >= most:
            turned()
            yield pd.concat(frames, ignore_index=True)
            frames, held = [], 0
    turned()
    if frames:
        yield pd.concat(frames, ignore_index=True)


def _made(rows: DataFrame, column: str, make: Callable[[int], Iterator[pd.DataFrame | tuple]], schema: str) -> DataFrame:
    names = T.StructType.fromDDL(schema).names

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _gathered((piece for batch in batches for number in batch[column].tolist() for piece in make(number)), names)

    return rows.select(column).mapInPandas(each, schema)


def generated_from(rows: DataFrame, column: str, make: Callable[[int], Iterator[pd.DataFrame | tuple]], schema: str) -> DataFrame:
    """ST2: what a generator gives for each number of a column, made in the tasks that hold the rows.

    make(number) yields frames, or rows as tuples in the order of schema; small pieces are gathered before they leave a task.
    """
    return _made(rows, column, make, schema)


def generated(spark: SparkSession, make: Callable[[int], Iterator[pd.DataFrame | tuple]], first: int, last: int, schema: str, parts: int = 8) -> DataFrame:
    """ST2: what a generator gives for the numbers first .. last - 1, made in `parts` tasks at a time. make(number) yields
    frames or rows, as in generated_from; a lost task makes its numbers again, so make must depend on its number alone."""
    return _made(spark.range(first, last, 1, parts), "id", make, schema)


def inference_steps(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """ST5: an endless stream of inference iterations: (iteration, phase); it ends only when it is stopped."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select((F.col("value") + 1).alias("iteration"), F.lit("inference").alias("phase"))


def stop_signals(losses: DataFrame, key: str, order: str, loss: str, patience: int, mode: str = "mean") -> DataFrame:
    """ST8-ST15: for a stream of losses, the last `patience` of each key as state, and whether they say stop by any mode.

    Rows of a micro-batch are taken in `order`. Output (update mode): key, n, stop; stop is null until the history is full
    and where the rule has nothing to compare.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    kind = losses.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        history = (history + rows[loss].tolist())[-patience:]
        state.update((history,))
        yield pd.DataFrame({key: [k[0]], "n": [len(history)], "history": [history if len(history) == patience else None]})

    kept = losses.select(key, order, loss).groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n int, history array<double>", "history array<double>", "update", GroupStateTimeout.NoTimeout)
    return kept.select(key, "n", F.when(F.col("history").isNotNull(), should_stop(F.col("history"), mode)).alias("stop"))


class Signals:
    """ST7, U13: named events with handlers, called in the order in which they were connected."""

    NAMES = ("graph_started", "session_started", "session_finished", "iteration_started", "iteration_finished")

    def __init__(self) -> None:
        self._handlers: dict[str, list[Callable]] = {n: [] for n in self.NAMES}

    def connect(self, name: str, handler: Callable) -> None:
        self._handlers[name].append(handler)

    def send(self, name: str, **what) -> None:
        for handler in self._handlers[name]:
            handler(**what)
