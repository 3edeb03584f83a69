"""Token counts: documents of flat token files, found by scanning for the end-of-document id.

A flat file is nothing but little-endian token ids, each document followed by the separator.  Files
are read by byte ranges, so that one large file is many tasks, and ranges are searched by blocks
independently (one vectorised comparison each); a block reports its size and where separators are.
A prefix scan over the blocks of a file (their sizes, their separators, the last separator so far)
turns these into absolute positions, so a document that spans blocks or ranges is stitched from its
pieces without any block knowing of the others.  The scan runs inside segments of some thousand
blocks first, then over the segments' sums, so no task holds all blocks of a large file.

Files are opened by workers themselves (`opened`): on a local or mounted folder, HDFS, S3, GCS or any
other that Arrow's file systems know.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Scratch, checkpointed, folder
from .text import id_and_text, slices

#: Tokens of a block, and blocks of a segment of the prefix scan.
BLOCK_TOKENS, SEGMENT_BLOCKS = 1 << 16, 1 << 12
#: Bytes of a range that one task reads at a time, and of a flat file that is written here.
RANGE_BYTES, FILE_BYTES = 16 << 20, 64 << 20
DEFAULT_RANKS = os.environ.get("TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The id after the last of the vocabulary.
DEFAULT_SEPARATOR = 50256
#: Pattern by which the vocabulary's texts are cut before merging (a fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, size) of the byte ranges of files (file, length); an empty file has one, of no bytes."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    own = files.select("file", "length", starts).select("file", "start", F.least(F.col("length") - F.col("start"), F.lit(range_bytes)).alias("size"))
    return own.repartition("file", "start")


def read_flat(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The byte ranges of the flat files under a path; Spark lists them, their contents aren't read yet.

    `range_bytes` is a multiple of a token's width.
    """
    return ranges(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length"), range_bytes)


_BLOCKS = "file string, block long, n_tokens long, ends array<int>"


def blocks(own: DataFrame, separator: int = DEFAULT_SEPARATOR, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, n_tokens, ends) of every block of ranges (file, start, size).

    `block` is the place of the block's first token in its file, `ends` are the places of separators in
    the block.  Bytes after the last whole token are ignored; an empty file has one block of no tokens.
    """

    def scan(name: str, start: int, size: int) -> pa.RecordBatch:
        system, path = opened(name)
        with system.open_input_file(path) as f:
            content = f.read_at(size, start)
        tokens = np.frombuffer(content, f"<u{width}", len(content) // width)
        first = list(range(0, max(1, len(tokens)), block_tokens))
        cut = [tokens[b : b + block_tokens] for b in first]
        ends = [np.flatnonzero(x == separator).astype(np.int32) for x in cut]
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(cut), pa.string()), pa.array([start // width + b for b in first], pa.int64()), pa.array([len(x) for x in cut], pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
            ["file", "block", "n_tokens", "ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
                yield scan(name, start, size)

    return own.select("file", "start", "size").mapInArrow(run, _BLOCKS)


def stitched(found: DataFrame, segment_tokens: int = SEGMENT_BLOCKS * BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) of every document, from the blocks of its file in any order.

    Tokens after a file's last separator are a last document that isn't terminated; separators don't
    count as tokens.  Two separators side by side have an empty document between them.  No blocks: no rows.
    """
    found = checkpointed(found.select("file", "block", "n_tokens", "ends", F.floor(F.col("block") / segment_tokens).cast("long").alias("segment")))
    inside = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = (
        found.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), zero))
        .withColumn("first", F.coalesce(F.sum(F.size("ends")).over(inside), zero))
        .withColumn("last", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)))
        .withColumn("previous", F.last("last", ignorenulls=True).over(inside))
    )
    # the same over segments: where each starts, how many separators and which one come before it
    sums = placed.groupBy("file", "segment").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("ends")).alias("n_ends"), F.max("last").alias("last"))
    sums = sums.withColumn("segment_start", F.coalesce(F.sum("tokens").over(before), zero)).withColumn("segment_first", F.coalesce(F.sum("n_ends").over(before), zero))
    sums = sums.withColumn("last", F.col("segment_start") + F.col("last")).withColumn("segment_previous", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1).cast("long")))
    joined = placed.drop("last").join(sums.select("file", "segment", "segment_start", "segment_first", "segment_previous"), ["file", "segment"])
    absolute = joined.select(
        "file", "ends", (F.col("segment_start") + F.col("start")).alias("start"), (F.col("segment_first") + F.col("first")).alias("first"),
        F.coalesce(F.col("segment_start") + F.col("previous"), "segment_previous").alias("previous"),
    )
    inner = absolute.select("file", "first", F.posexplode(F.expr("transform(ends, (e, i) -> start + e - if(i = 0, previous, start + ends[greatest(i - 1, 0)]) - 1)")).alias("i", "n_tokens"))
    closed = inner.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    total = sums.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = total.select("file", "ordinal", (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated")).where("n_tokens > 0")
    return closed.unionByName(rest)


def count_tokens(spark: SparkSession, path: str, separator: int = DEFAULT_SEPARATOR, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) of every document in the flat files under a path."""
    return stitched(blocks(read_flat(spark, path), separator, width))


_CODEC: dict[int, object] = {}


def _encoder(ranks: bytes):
    """The byte-pair encoder of a rank file's bytes; made once for each worker."""
    key = hash(ranks)
    if key not in _CODEC:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _CODEC[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _CODEC[key]


def flat(ids: list[list[int]], separator: int, width: int = 2) -> bytes:
    """A flat file of documents."""
    out = []
    for own in ids:
        out += own
        out.append(separator)
    return np.array(out, f"<u{width}").tobytes()


def write_flat(docs: DataFrame, path: str, ranks_path: str = DEFAULT_RANKS, separator: int = DEFAULT_SEPARATOR, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, length, doc_ids) of flat files of `docs` under a path that all workers can write to.

    Each task writes files of about `file_bytes`, named by its attempt, so that one that is run again
    never writes into another's; files that the returned rows don't name are of lost attempts.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, n = _encoder(shared.value), TaskContext.get(), 0
        system, base = opened(path)
        system.create_dir(base, recursive=True)
        held, ids, size = [], [], 0

        def out() -> pa.RecordBatch:
            name = f"{task.partitionId()}-{task.taskAttemptId()}-{n}.tokens"
            with system.open_output_stream(f"{base}/{name}") as f:
                for x in held:
                    f.write(x)
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "length", "doc_ids"])

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(flat(encoder.encode_ordinary_batch(part.column("text").to_pylist(), num_threads=1), separator))
                ids += part.column("doc_id").to_pylist()
                size += len(held[-1])
                if size >= file_bytes:
                    yield out()
                    held, ids, size, n = [], [], 0, n + 1
        if held:
            yield out()

    return id_and_text(docs).mapInArrow(run, "file string, length long, doc_ids array<bigint>")


def counts(docs: DataFrame, ranks_path: str = DEFAULT_RANKS, separator: int = DEFAULT_SEPARATOR) -> DataFrame:
    """(doc_id, n_tokens, terminated) of every row: written to flat files in the shared folder, which are scanned.

    A null or empty text has 0 tokens; rows that repeat an id or a text have a row each, null ids too;
    an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    scratch.paths["tokens"] = folder(docs.sparkSession)
    files = scratch.keep("files", write_flat(docs, scratch.paths["tokens"], ranks_path, separator))
    ids = files.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    out = checkpointed(stitched(blocks(ranges(files), separator)).join(ids, ["file", "ordinal"]).select("doc_id", "n_tokens", "terminated"))
    scratch.clear()
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the number of tokens of every document, from flat files of `documents`."""
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
