"""Token counts through a digest cache.

A document's key is the digest of its normalised content and of the tokenizer's version. Keys are
joined to the stored counts; one text of each distinct missing key is encoded, and the new counts
are appended to the cache, which is a folder of parquet files.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignal.llm.common import as_bytes, kept, materialize, shared_folder, steps

CACHE_SCHEMA = "digest string, version string, n_tokens long"
#: words whose counts a worker remembers, in two generations
MEMORY_WORDS = 400_000


def normalise(text: Column) -> Column:
    """Runs of ASCII white space become one blank; the tokenizer drops white space, so counts stay."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]


class Memory(dict):
    """A dict of bounded size: the older half goes when the newer one is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()


class WordCounter:
    """Token counts of texts for a tokenizer that drops white space and splits words there.

    Counts of words (runs without ASCII white space) add up to the text's, so each distinct word
    is encoded once and remembered.
    """

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark already runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(memory)

    def counts(self, texts: list[bytes | None]) -> list[int]:
        words: list[bytes] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            words += (t or b"").split()
            ends[i + 1] = len(words)
        if not words:
            return [0] * len(texts)
        memory, old = self.memory, self.memory.old
        n = np.fromiter(map(memory.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(n < 0)
        if len(missing):
            new = list({words[i] for i in missing.tolist()})
            unseen = [w for w in new if w not in old]
            memory.update((w, old[w]) for w in new if w in old)
            for a in range(0, len(unseen), 4096):
                part = unseen[a:a + 4096]
                coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                memory.update(zip(part, map(len, coded)))
            n[missing] = [memory[words[i]] for i in missing.tolist()]
            memory.turn()
        total = np.concatenate(([0], np.cumsum(n)))
        return (total[ends[1:]] - total[ends[:-1]]).tolist()


def word_counter(path: str) -> Callable[[list[bytes | None]], list[int]]:
    """The worker's counter for a vocabulary file; it outlives the task."""
    def count(texts: list[bytes | None]) -> list[int]:
        return kept(("words", path), lambda: WordCounter(path)).counts(texts)
    return count


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if the folder does not exist yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", cache: str | None = None,
                 counter: Callable[[str], Callable] = word_counter) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every document; the cache gains what it lacked.

    ``path`` is a tokenizers .json whose tokenizer drops white space; without begin, end or added
    special tokens. ``cache`` is a folder all executors share (a fresh one if None). Null and empty
    texts have 0 bytes and 0 tokens; equal texts and repeated rows are encoded once; a null doc_id
    stays null; an empty table gives no rows and appends nothing; other columns are not read. A
    count that two runs append at the same time is the same and is read once.
    """
    spark = docs.sparkSession
    cache, version = cache or shared_folder(spark, "token-cache"), tokenizer_version(path)
    raw = F.col(text).cast("string")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("n_bytes"), normalise(raw).alias("text"))
    base = base.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    keys = materialize(base.select("doc_id", "n_bytes", "digest"), "digests")
    stored = read_cache(spark, cache).filter(F.col("version") == version).select("digest", "n_tokens")
    missing = base.groupBy("digest").agg(F.first("text").alias("text")).join(stored, "digest", "left_anti")
    count = counter(path)

    def encode(batches):
        for batch in batches:
            n = [x for texts in steps(batch.column(1)) for x in count(as_bytes(texts))]
            yield pa.RecordBatch.from_pydict({"digest": batch.column(0), "version": pa.array([version] * len(n), pa.string()), "n_tokens": pa.array(n, pa.int64())})

    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # one row a digest, written, so that the join below is a plain one whose hot digests Spark splits
    counts = materialize(read_cache(spark, cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
