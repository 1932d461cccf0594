"""Helpers shared by the training-data operators: shared-folder tables, text batches, row passing."""
from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsignal.session import ensure_checkpoint_dir

#: bytes of text that one vectorised step inside a task handles at once
STEP_BYTES = 1 << 20


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the application's own folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder and read it again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n``."""
    return 1 << max(0, (int(-(-n // 1)) - 1).bit_length())


def fresh_names(taken: Iterable[str], wanted: Iterable[str]) -> dict[str, str]:
    """Column names for ``wanted`` that clash with none of ``taken`` (compared without case)."""
    seen, out = {c.lower() for c in taken}, {}
    for name in wanted:
        new = name
        while new.lower() in seen:
            new += "_"
        seen.add(new.lower())
        out[name] = new
    return out


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 byte strings, nulls kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a text column that hold about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield column.slice(start, stop - start)
        start = stop


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What ``make`` returns, remembered by the Python worker beyond the task; one thing at a time,
    so that the stages of a pipeline do not pile up in a worker's memory."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def append_columns(df: DataFrame, text: str, fields: list[tuple[str, str]],
                   score: Callable[[list], list[list]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns that ``score`` makes of a list of texts (UTF-8 bytes or None).

    ``score`` is called in tasks for about ``STEP_BYTES`` of text and returns one list per field.
    Rows and their other columns pass through as Arrow data, unchanged. The new columns' names
    must not clash (see ``fresh_names``).
    """
    extra = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields])
    passed = [i for i, c in enumerate(df.columns) if keep is None or c in keep]
    schema = T.StructType([df.schema.fields[i] for i in passed] + extra.fields)
    position = df.columns.index(text)
    kinds = [_arrow(f.dataType) for f in extra.fields]
    names = schema.names

    def run(batches):
        for batch in batches:
            parts: list[list] = [[] for _ in kinds]
            for texts in steps(batch.column(position)):
                for out, new in zip(parts, score(as_bytes(texts))):
                    out.extend(new)
            arrays = [pa.array(v, type=k) for v, k in zip(parts, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in passed), *arrays], names=names)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "binary": pa.binary(), "boolean": pa.bool_()}[kind.simpleString()]


def text_bytes(df: DataFrame, text: str) -> int:
    """Total UTF-8 bytes of a text column (one aggregate over the pruned column)."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def hash_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``key``: the same ones on every run.

    Rows are first cut to about 4 * n by their hash, so no task or driver merge grows with the table.
    """
    total, space = df.count(), 1 << 40
    h = F.pmod(F.xxhash64(key), F.lit(space))
    part = df.filter(h < int(space * 4 * n / total)) if total > 4 * n else df
    return part.orderBy(h, key).limit(n)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo ``n``: the fold of a row."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def stream_sha256(df: DataFrame, keys: list[str], order: list[str], piece: str, between: str, name: str) -> DataFrame:
    """``keys`` and the SHA-256 digest (hex) of each key's pieces in ``order``, joined by ``between``; null pieces are left out.

    A digest is a chain through all its bytes, so a key's pieces pass through one task, a piece at a time; cut long
    texts into pieces of about a megabyte.
    """
    out = T.StructType([df.schema[k] for k in keys] + [T.StructField(name, T.StringType())])
    kinds = [_arrow(df.schema[k].dataType) for k in keys] + [pa.string()]
    glue = between.encode()

    def run(batches):
        own, digest, empty, done = None, None, True, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            pieces = batch.column(len(keys))
            for row, key in enumerate(zip(*columns)):
                if key != own:
                    if digest is not None:
                        done.append((*own, digest.hexdigest()))
                    own, digest, empty = key, hashlib.sha256(), True
                text = pieces[row].as_py()
                if text is not None:
                    digest.update((b"" if empty else glue) + (text if isinstance(text, bytes) else text.encode()))
                    empty = False
            if len(done) > 1000:
                yield _rows_batch(done, kinds, out.names)
                done = []
        if digest is not None:
            done.append((*own, digest.hexdigest()))
        if done:
            yield _rows_batch(done, kinds, out.names)

    streams = df.select(*keys, piece, *order).repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return streams.select(*keys, piece).mapInArrow(run, out)


def _rows_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
