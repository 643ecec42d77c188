"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and text bytes that a Python worker holds at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a reused Python worker remembers, by the module whose operator it served.
_memories: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Tell that a module holds memory in this worker, and how to drop it."""
    _memories[module] = forget


#: glibc's call that hands freed memory back to the system, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand memory that is free in this worker back to the system: what one stage needed
    at its most would otherwise stand beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def serve(module: str) -> None:
    """A worker that turns to another operator drops what it held for the last one."""
    for other in [m for m in _memories if m != module]:
        _memories.pop(other)()
        gc.collect()
    give_back()


def quoted(name: str) -> Column:
    """A column by its name as it is, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long texts do not meet in one of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH_BYTES))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path under the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. A session on one machine without it (a test, the
    driver's local runs) gets a folder in its warehouse; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here,
    and a lost executor costs only the tasks that it ran."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch where its bytes exceed ``most``; a single larger row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def map_rows(
    df: DataFrame,
    columns: list[str],
    fn: Callable[..., dict[str, list]],
    schema: str | T.StructType,
    most: int = BATCH_BYTES,
) -> DataFrame:
    """``fn(*columns as lists) -> {output column: list}`` over bounded Arrow batches.

    Only ``columns`` are read, so extra columns, whatever their names, neither
    clash nor cost anything. The last of ``columns`` is the one whose bytes
    bound a batch (``most``).
    """
    small_batches(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct, timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve(fn.__module__)
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            sizes = [len(x) if isinstance(x, (str, bytes)) else 8 for x in lists[-1]]
            for a, b in slices(sizes, most):
                out = fn(*(x[a:b] for x in lists))
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
            del lists
        give_back()

    return df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, struct)


def rewrite_texts(docs: DataFrame, fn: Callable[[str | None], str | None], keep: Callable[[str | None], bool] | None = None, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The same columns with ``fn`` applied to the text, its size updated where there is
    such a column; rows whose new text ``keep`` refuses go. ``fn`` may return None for a null text."""
    others = [c for c in docs.columns if c != text_col]
    sized = size_col in others

    def run(*lists: list) -> dict[str, list]:
        cols, new = dict(zip([*others, text_col], lists)), [fn(t) for t in lists[-1]]
        at = [i for i, t in enumerate(new) if keep is None or keep(t)]
        out = {c: [x[i] for i in at] for c, x in cols.items()}
        out[text_col] = [new[i] for i in at]
        if sized:
            out[size_col] = [n if t is None else len(t) for n, t in zip(out[size_col], out[text_col])]
        return out

    schema = T.StructType([docs.schema[c] for c in [*others, text_col]])
    return map_rows(docs, [*others, text_col], run, schema).select(*map(quoted, docs.columns))


#: Bits of a filter of hashes, as a power of two (16 MB).
FILTER = 27


def filter_words(keys: DataFrame) -> np.ndarray:
    """A bit for each ``key``, from its upper bits: 2**FILTER bits at most reach the driver."""
    place = F.shiftrightunsigned("key", 64 - FILTER)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER}) & 63 as int))")
    bits = keys.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER - 6), np.uint64)
    if bits.num_rows:
        words[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return words


def holds(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = key >> np.uint64(64 - FILTER)
    return words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1) != 0
