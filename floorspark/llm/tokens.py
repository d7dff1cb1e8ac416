"""Token counts by way of a cache of content and tokenizer digests.

Texts are named by the digest of their content, tokenizers by the digest of
their file, library and options. Counts found in the cache are joined; of what
is missing each distinct text is encoded once and its count appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspark.plans.skew import lookup_join
from floorspark.session import stored

_CACHE = "content string, n_tokens long, tokenizer string"


def tokenizer_digest(model: bytes, kind: str) -> str:
    """Names the tokenizer: its file, the library that runs it, the options."""
    library = {"model": sentencepiece, "json": tokenizers}[kind]
    version = f"{library.__name__} {library.__version__}; no special tokens; whole text"
    return hashlib.sha256(version.encode() + b"\0" + model).hexdigest()


def content_digest(text: Column) -> Column:
    """Names a text: null and empty are the same content. Nothing else is
    normalised, because any other change could change the count."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _counter(model: bytes, kind: str):
    if kind == "model":
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda text: len(processor.encode(text, add_bos=False, add_eos=False))
    tokenizer = tokenizers.Tokenizer.from_str(model.decode("utf-8"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _encoded(model, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or _counter(model.value, kind)
            found = [count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found, pa.int64())], ["content", "n_tokens"])

    return run


def _cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of this tokenizer; two runs may have appended the same."""
    try:
        rows = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_file: str, cache: str, limit: int = 4096) -> DataFrame:
    """Token counts of whole texts, without begin, end or added special tokens.

    ``docs`` has doc_id and text; other columns are ignored. ``tokenizer_file``
    is a .model of sentencepiece or a .json of tokenizers, read on the driver and
    sent to the tasks. ``cache`` is a folder that all executors share; it is made
    if absent and grows by the counts of contents not met before.

    Returns one row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (more tokens than ``limit``). A null text counts as empty: no bytes, no
    tokens. Repeated rows and rows without doc_id are counted like others.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as file:
        model = file.read()
    kind = tokenizer_file.rpartition(".")[2]
    tokenizer = tokenizer_digest(model, kind)
    named = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        content_digest(F.col("text")).alias("content"),
    )
    keys = stored(named.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "contents")

    known = _cached(spark, cache, tokenizer)
    missing = keys.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(known, "content", "left_anti")
    # The rows of one doc_id of each missing content bring its text: no hot key, and
    # copies under other ids stay behind. Of repeated rows one is encoded; it is found
    # where the join left them, without another shuffle.
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("owner")
    chosen = missing.select("content", owner)
    texts = named.select("content", owner, "text").join(chosen, ["content", "owner"], "left_semi")
    texts = texts.dropDuplicates(["content", "owner"]).select("content", "text")
    counted = texts.mapInArrow(_encoded(spark.sparkContext.broadcast(model), kind), "content string, n_tokens long")
    counted.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)

    return lookup_join(keys, _cached(spark, cache, tokenizer), ["content"]).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
