"""Operator 3: language identification by compression.

Each language has a raw-content Zstandard dictionary of excerpts of its training texts.  A text, in
lower case and with everything but letters as spaces, is compressed in pieces with every
dictionary, and the language that makes it smallest is predicted.  A prediction whose margin over
the second language is narrow is rejected, unless the text is too short to tell.

Training takes at most SAMPLE documents of a language, those with the smallest hashes of their ids,
and EXCERPT characters of each, from a place given by the same hash; a dictionary holds at most DICT bytes, and all of them ALL bytes.
Prediction reads whole texts and needs no shuffle; the dictionaries are broadcast.

Null text, or text without a letter: ``und``, score 0, rejected.  Equal sizes: the language with
more training documents, then the smaller name.  With one language the score is 1; with none every
text is ``und``.  Repeated rows are each predicted.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import shared

#: Bounds of training: documents of a language, characters of each, bytes of a dictionary and of all.
SAMPLE, EXCERPT, DICT, ALL = 96, 1000, 64 << 10, 32 << 20
#: Bytes compressed at a time, and the compression level.
PIECE, LEVEL = 2048, 5
#: A text of SHORT bytes or more is rejected if the best size is within MARGIN of the second, relative to it.
MARGIN, SHORT = 0.003, 64

_SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_RUNS = re.compile(rb" +")
UNKNOWN = "und"


def normal(text: str | None) -> bytes:
    return _RUNS.sub(b" ", (text or "").lower().encode().translate(_SPACED))


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> list[tuple[str, bytes]]:
    """Dictionaries of the languages of *labelled*, the most frequent language first."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"), F.col(key).alias("key"))
    place = F.pmod(F.xxhash64(F.col("key").cast("string")), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    rows = rows.withColumn("text", F.substr("text", place, F.lit(EXCERPT)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.col("key").cast("string")), "key", "text")
    size = min(DICT, ALL // max(1, len(counts)))
    most = min(SAMPLE, max(1, 2 * size // EXCERPT))  # with very many languages fewer excerpts of each: all of them stay within a few ALL
    sample = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("lang", "text", "r").collect()
    texts: dict[str, bytes] = dict.fromkeys(counts, b"")
    for row in sorted(sample, key=lambda r: (r["lang"], r["r"])):
        texts[row["lang"]] += normal(row["text"])
    return [(name, texts[name][:size]) for name in sorted(counts, key=lambda k: (-counts[k], k))]


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, data in model:
        kind = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
        if kind is not None:
            kind.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def predict_one(model: tuple[tuple[str, bytes], ...], text: str) -> tuple[str, float, bool]:
    """Language, score and whether it is rejected, of a text with a letter."""
    data = normal(text)
    if not model:
        return UNKNOWN, 0.0, True
    sizes = []
    for rank, compressor in enumerate(_compressors(model)):
        sizes.append((sum(len(compressor.compress(data[at : at + PIECE])) for at in range(0, len(data), PIECE)), rank))
    sizes.sort()
    if len(sizes) == 1:
        return model[0][0], 1.0, False
    score = (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])
    return model[sizes[0][1]][0], score, score < MARGIN and len(data) >= SHORT


def predict(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score and lang_rejected to every row; columns of these names give way to them."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ADDED]
    return _predicted(docs, model, text).select(*kept, *ADDED)


def accepted(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """The rows whose prediction isn't rejected, with all their columns as they are, whatever their names."""
    return _predicted(docs, model, text).filter("not lang_rejected").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ADDED = ("lang_pred", "lang_score", "lang_rejected")


def _predicted(docs: DataFrame, model: list[tuple[str, bytes]], text: str) -> DataFrame:
    """Rows (row, ADDED): the caller's columns stay in a struct, so that no name can clash."""
    spark = docs.sparkSession
    shared.tune(spark)
    held = spark.sparkContext.broadcast(tuple(model))
    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"), letter.alias("letter"))
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")

    def run(batches):
        known = held.value
        for batch in batches:
            found = [predict_one(known, t) if letter else (UNKNOWN, 0.0, True) for t, letter in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            names, scores, rejected = zip(*found) if found else ((), (), ())
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def in_test(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo *folds*, is *fold*; a null id is in training."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
