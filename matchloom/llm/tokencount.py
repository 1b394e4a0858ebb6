"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer-version digest, n_tokens) in a folder that Spark can read. Each
run joins the distinct content digests of its input to the cache entries of the same tokenizer version, encodes only the
distinct contents that are missing, each of them once, appends their counts, and then looks every row's digest up in the
cache. Contents are normalised before the digest: null becomes the empty text. The tokenizer's version digest is the sha256
of its file, so another vocabulary never meets old counts; the file travels to the executors with the job and its digest is
checked there.

Missing digests are found among digests alone. While there are at most ``broadcast_digests`` of them (counted first) the scan
picks their texts where it stands; beyond that texts and digests meet by a join on the digest. Either way a task first drops
the copies that it holds itself, and what is left of a content is merged behind one exchange.

Appending is idempotent: a repeated or concurrent run may append the same pair twice, and reading takes one of them.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their row, also without an id; whole
texts are encoded, without truncation, padding, begin or end tokens; strings of special tokens inside a text are treated as
the library does by default; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable
from .common import byte_groups, map_batches, materialise, read_table, shared_dir, spread

CACHE_SCHEMA = "digest string, version string, n_tokens long"
_BATCH_BYTES = 1 << 20


@lru_cache(maxsize=2)
def _encoder(name: str, version: str):
    """texts → token counts, for the library that the job's file belongs to."""
    path = SparkFiles.get(name)
    if version_digest(path) != version:
        raise ValueError(f"{name} on this machine is not the tokenizer that the job was started with")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def version_digest(tokenizer_path: str) -> str:
    with open(tokenizer_path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """One count per digest of this tokenizer version; empty where there is no cache yet."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        table.schema  # noqa: B018  resolves the path
    except AnalysisException:
        table = spark.createDataFrame([], CACHE_SCHEMA)
    return table.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _local_copies_dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, content) without the repeats inside the task, whose digests fit in memory as its input is one split."""
    seen: set[str] = set()
    for batch in batches:
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def encode_misses(docs: DataFrame, cache_path: str, tokenizer_path: str, broadcast_digests: int = 100_000) -> DataFrame:
    """(digest, version, n_tokens) of the distinct contents that the cache lacks. ``docs``: content."""
    spark = docs.sparkSession
    ensure_importable(spark)
    version = version_digest(tokenizer_path)
    spark.sparkContext.addFile(tokenizer_path)
    name = os.path.basename(tokenizer_path)
    rows = docs.select(F.sha2(F.col("content").cast("binary"), 256).alias("digest"), "content")
    missing = rows.select("digest").distinct().join(read_cache(spark, cache_path, version).select("digest"), "digest", "left_anti")
    missing = materialise(missing.select(F.col("digest").alias("want")), "missing-digests")
    few = missing.count() <= broadcast_digests
    if few:
        rows = rows.join(F.broadcast(missing), F.col("digest") == F.col("want"), "left_semi")
    texts = rows.mapInArrow(_local_copies_dropped, "digest string, content string")
    if not few:
        # A merge join leaves the rows sorted by digest, as the aggregation below needs them.
        texts = texts.join(missing.hint("merge"), F.col("digest") == F.col("want"), "left_semi")
    texts = texts.groupBy("digest").agg(F.first("content").alias("content"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoder(name, version)
        digests, contents = batch.column(0), batch.column(1)
        sizes = pa.compute.binary_length(contents).to_pylist()
        counts: list[int] = []
        for start, end in byte_groups(sizes, _BATCH_BYTES):
            counts += encode(contents.slice(start, end - start).to_pylist())
        return pa.RecordBatch.from_arrays([digests, pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    return map_batches(texts.select("digest", "content"), CACHE_SCHEMA, run)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text); the cache gains what it lacked."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    encode_misses(rows.select("content"), cache_path, tokenizer_path).write.mode("append").parquet(cache_path)
    # Written out, so that the join below meets plain exchanges and adaptive execution can split a content with many copies.
    known = materialise(read_cache(spark, cache_path, version_digest(tokenizer_path)), "token-counts")
    keyed = rows.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of the 50k byte-level vocabulary for every document.

    The cache is the folder that the setting ``spark.matchloom.tokenCache`` names; where it is unset, a new one that starts empty.
    """
    import public_tokenizers

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    cache = spark.conf.get("spark.matchloom.tokenCache", None) or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
