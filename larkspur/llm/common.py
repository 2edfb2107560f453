"""Helpers shared by the operators: table access, staged tables, Arrow maps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch_path

# Bytes that separate words: \x20 and \x09-\x0D, exactly those of bytes.split().
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and
    read it back: later passes start from files that survive lost executors.
    Inside :func:`staging` the table goes when that ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path = path
    if _open:
        _open[-1].append(back)
    return back


_open: list[list[DataFrame]] = []


def discard(staged: DataFrame) -> None:
    """Delete a staged table after its last read."""
    jvm = staged.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(staged.staged_path)
    place.getFileSystem(staged.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def staging() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are staged inside are deleted at the end, except those that
    are staged with the yielded function: they hold the result."""
    tables: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(tables)

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept.append(stage(df, name))
        return kept[-1]

    try:
        yield keep
    finally:
        _open.pop()
        for table in tables:
            if not any(table is k for k in kept):
                discard(table)
        if _open:
            _open[-1].extend(kept)


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "string": T.StringType(), "binary": T.BinaryType(),
          "array<int>": T.ArrayType(T.IntegerType()), "array<long>": T.ArrayType(T.LongType())}


def schema(fields: str) -> T.StructType:
    """A schema of ``name type`` pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


def with_columns(df: DataFrame, added: T.StructType, compute: Callable[[pa.RecordBatch], list],
                 keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (``keep`` of them) and the ``added`` ones that
    ``compute`` derives from each Arrow batch. An input column named like an
    added one is replaced."""
    names = {f.name for f in added.fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    out = T.StructType(kept + list(added.fields))
    kept_names = [f.name for f in kept]
    types = arrow_types(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                got = [pa.array(c, t) if not isinstance(c, pa.Array) else c
                       for c, t in zip(compute(part), types, strict=True)]
                arrays = [part.column(part.schema.get_field_index(n)) for n in kept_names] + got
                yield pa.RecordBatch.from_arrays(arrays, names=kept_names + [f.name for f in added.fields])

    return df.mapInArrow(run, out)


# Rows of one step inside a task; bounds the Python objects alive at a time.
BATCH_ROWS = 512


def arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in schema.fields]


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Code points that the interpreter's Unicode tables do not know. Tables of
    the tokenizer libraries may be newer, so texts that hold one are looked at
    through the library."""
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    ends = [i for i, c in enumerate(unknown) if i + 1 == len(unknown) or unknown[i + 1] != c + 1]
    starts = [0] + [i + 1 for i in ends[:-1]]
    return re.compile("[" + "".join(f"\\U{unknown[a]:08x}-\\U{unknown[b]:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sha_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
