"""Language ID by compression: the language whose zstandard dictionary shrinks a text most.

Each language's raw-content dictionary is made of excerpts of a bounded sample of its labelled
documents. A text is cut into chunks; every chunk is compressed with every dictionary, and the
sizes are added up, so the dictionary counts in the whole of a long text. A narrow margin between
the smallest and the next size is a rejection.
"""
from __future__ import annotations

import math
import uuid

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.llm.common import append_columns, fresh_names, kept

#: ASCII letters lower-cased; other ASCII becomes a blank; bytes of other characters stay
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SAMPLE_DOCS = 240               # labelled documents a language's dictionary is made of
EXCERPT = 1000                  # characters of each
CHUNK = 1024
LEVEL = 6
MARGIN = 0.01                   # of the smallest size
SHARPNESS = 30.0


def fold(text: str) -> bytes:
    """Lower-case letters and single blanks, as UTF-8."""
    return b" ".join(text.lower().encode().translate(FOLD).split())


def learn(docs: DataFrame, learnable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """The dictionary of every language among the ``learnable`` rows.

    Uses at most ``sample_docs`` documents a language, the first by a hash of doc_id, and ``excerpt``
    characters from the middle of each (of rows that share a doc_id, the least excerpt). Rows with a null doc_id, text or lang are not learned from.
    """
    known = docs.filter(learnable & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang")).distinct() \
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample_docs).select("doc_id", "lang")
    body = F.col(text).cast("string")
    middle = F.substring(body, F.greatest(F.lit(1), ((F.length(body) - excerpt) / 2).cast("int")), F.lit(excerpt))
    rows = known.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), middle.alias("part")) \
        .join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("part").alias("part")).collect()   # languages * sample_docs
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.part)):
        parts.setdefault(r.lang, []).append(fold(r.part))
    return {k: b" ".join(dict.fromkeys(v)) for k, v in sorted(parts.items())}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, chunk: int = CHUNK):
        self.names, self.chunk = list(dictionaries), chunk
        self.coders = []
        for body in dictionaries.values():
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); und, 0 and False without a letter or without a language."""
        body = fold(text or "")
        if not body or not self.names or not (any(97 <= c <= 122 for c in body[:64]) or any(map(str.isalpha, text))):
            return "und", 0.0, False
        chunks = [body[i:i + self.chunk] for i in range(0, len(body), self.chunk)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rates = [s / sizes[best] - 1 for s in sizes]
        score = 1 / sum(math.exp(-min(SHARPNESS * r, 700)) for r in rates)
        margin = min((r for i, r in enumerate(rates) if i != best), default=1.0)
        return self.names[best], score, margin >= MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``lang_pred``, ``score`` and ``accepted`` of every whole text; the names used.

    Only the text counts. lang_pred is a learned language (the first by name of equal sizes), or und
    with score 0 where the text is null or has no letter, or nothing was learned; score is between 0
    and 1; accepted is false for und and where the margin is narrow. Repeated rows get equal results;
    an empty table gives no rows; clashing columns are renamed as the dict says.
    """
    names = fresh_names(docs.columns, ("lang_pred", "score", "accepted"))
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)     # languages * sample_docs * excerpt

    def score(texts):
        compressors = kept(("compressors", key), lambda: Compressors(sent.value))
        out = [compressors.classify(t.decode() if t is not None else None) for t in texts]
        return [list(c) for c in zip(*out)] if out else [[], [], []]
    return append_columns(docs, text, [(names["lang_pred"], "string"), (names["score"], "double"), (names["accepted"], "boolean")], score, keep), names
