"""Shared helpers: the shared work folder, stored tables, label splits, ASCII lower case."""

from __future__ import annotations

import string
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
# Session settings that hold for texts of any length, set where the session leaves them unset: rows and bytes of an Arrow batch, and
# rows that the Parquet reader decodes at once.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
BLOCK_BYTES = 16 << 20  # of a stored table's row groups, which a task holds while it writes them


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one on one machine where that is unset (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "folder" not in _OWN:
        _OWN["folder"] = tempfile.mkdtemp(prefix="spark-work-")
    return _OWN["folder"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and survives lost executors."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_apart(docs: DataFrame, names: list[str]) -> DataFrame:
    """All columns under private names, and ``names`` under their own beside them, so that no result column clashes with one."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)], *[F.col(f"`{n}`") for n in names])


def put_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that were set apart, under their names and in their order."""
    return df.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(columns)])


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a missing key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor).cast("int")


def map_texts(df: DataFrame, text: str, keep: list[str], added: str, build: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """The ``keep`` columns of every row beside columns computed from its text, a few megabytes of text at a time.

    ``build`` runs once in each task and gives a function from a list of texts to one list or array per column of the
    DDL string ``added``. A missing text is empty. SETTINGS bound what is held of the texts, which is several times over between
    Spark and Python.
    """
    for name, value in SETTINGS.items():
        if df.sparkSession.conf.get(name, None) is None:
            df.sparkSession.conf.set(name, value)
    fields = T._parse_datatype_string(added).fields
    passed = [f"_k{i}" for i in range(len(keep))]
    inner = df.select(*[F.col(c).alias(p) for c, p in zip(keep, passed, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([f for f in inner.schema if f.name != "_text"] + fields)
    names = [f.name for f in fields]
    types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = build()
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("_text")):
                texts = part.column("_text").to_pylist()
                columns = compute(texts)
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(p) for p in passed], *arrays], names=[*passed, *names])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(p).alias(c) for c, p in zip(keep, passed, strict=True)], *names)


MAX_WORDS_OF_BITS = 1 << 20


def marked(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str = "_maybe") -> DataFrame:
    """``df`` with a flag that is false only where the 64-bit ``key`` is not among ``wanted``.

    The wanted keys become one bit each in a table of at most MAX_WORDS_OF_BITS words (16 MB), whatever their number, which
    is broadcast: rows that cannot match need not be shuffled with their texts for a join that they would not survive.
    """
    words = min(MAX_WORDS_OF_BITS, max(64, wanted.count()))

    def place(k: Column) -> Column:
        return F.pmod(k, F.lit(words * 64))

    one = F.lit(1).cast("long")
    bits = wanted.select(place(wanted_key).alias("_at")).groupBy(F.floor(F.col("_at") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    placed = df.withColumn("_at", place(key)).withColumn("_word_of", F.floor(F.col("_at") / 64))
    joined = placed.join(F.broadcast(bits), F.col("_word_of") == F.col("_word"), "left")
    flag = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_at % 64 as int))").bitwiseAND(one) == 1, F.lit(False))
    return joined.withColumn(name, flag).drop("_at", "_word_of", "_word", "_bits")


def process_wide(key: str, build: Callable[[], object]):
    """An object that the tasks of one Python worker share, such as a bounded table of words already coded.

    A worker holds one such object at a time: another stage's object replaces it, so stages do not add up in memory.
    """
    state = sys.modules.setdefault("_task_state", types.ModuleType("_task_state"))
    if getattr(state, "key", None) != key:
        state.key = state.held = None
        state.held = build()
        state.key = key
    return state.held


def slices(batch: pa.RecordBatch, column: int, target: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``target`` bytes of the text column, or one row."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > target:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return plain[kind.simpleString()]
