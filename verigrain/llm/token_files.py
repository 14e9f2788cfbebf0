"""Token ids as files: a Spark data source over shards of patched frame-of-reference blocks.

    token_ids(docs, ...).write.format("token_blocks").mode("append").save(folder)
    spark.read.format("token_blocks").option("ids", "true").load(folder)

Each task writes a shard (``token_blocks``) under a name of its own; the driver, once all tasks have ended well, writes
the manifest that names the shards that count, with a few numbers of each. A task that is lost or run twice leaves at
most a file that no manifest names. A folder holds one table. Reading divides the shards by ranges of ids, and the
index of block starts leads each task to its range.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from verigrain.llm.columns import free_name
from verigrain.llm.packing import BYTES_AT_A_TIME, ChunkTokens
from verigrain.llm.textkit import sliced_by_bytes
from verigrain.llm.token_blocks import ShardReader, ShardWriter
from verigrain.plans.durable import batches_of, ensure_checkpoint_dir

FORMAT = "token_blocks"
MANIFEST = "manifest.json"
#: Ids of a shard that one task reads.
IDS_AT_A_TASK = 32 << 20
#: Rows sent to a Python worker at once.
BATCH_ROWS = 500


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it; what Hadoop calls s3a is s3 here."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


@dataclass
class Shard(WriterCommitMessage):
    part: int
    name: str
    n_docs: int
    n_ids: int
    first: int | None
    last: int | None


@dataclass
class Piece(InputPartition):
    name: str
    before: int
    begin: int
    end: int

    def __init__(self, name: str, before: int, begin: int, end: int):
        super().__init__((name, begin))
        self.name, self.before, self.begin, self.end = name, before, begin, end


class TokenBlocks(DataSource):
    """doc_id and ids are written; doc_id, start, n_tokens, ids_crc32 and, with the option ids, ids are read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        ids = ", ids array<int>" if self.options.get("ids", "false").lower() == "true" else ""
        return f"doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{ids}"

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options["path"], "ids" in schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        if overwrite or schema.names[:2] != ["doc_id", "ids"]:
            raise ValueError("token_blocks appends doc_id and ids to a folder that has no table yet")
        return TokenWriter(self.options["path"], float(self.options.get("percentile", 0.9)))


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, percentile: float):
        self.path, self.percentile = path, percentile

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        part = TaskContext.get().partitionId()
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        shard = Shard(part, f"part-{part:06d}-{uuid.uuid4().hex}.tok", 0, 0, None, None)
        writer = sink = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = files.open_output_stream(f"{folder}/{shard.name}")
                writer = ShardWriter(sink, self.percentile)
            doc_ids, lists = batch.column(0).to_pylist(), batch.column(1)
            ids, edges = lists.values.to_numpy(zero_copy_only=False).view(np.uint32), lists.offsets.to_numpy()
            for k, doc_id in enumerate(doc_ids):
                writer.add(doc_id, ids[edges[k] : edges[k + 1]].copy())
        if writer is not None:
            writer.finish()
            sink.close()
            shard.n_docs, shard.n_ids = len(writer.doc_ids), writer.n_ids
            shard.first, shard.last = writer.doc_ids[0], writer.doc_ids[-1]
        return shard

    def commit(self, messages: list[Shard | None]) -> None:
        shards = sorted((m for m in messages if m is not None and m.n_docs), key=lambda m: m.part)
        order = [(x is not None, x or 0) for s in shards for x in (s.first, s.last)]
        if order != sorted(order):
            raise ValueError("documents must come in ascending order of doc_id, partition by partition")
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        if files.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds a table already")
        with files.open_output_stream(f"{folder}/{MANIFEST}.new") as sink:
            sink.write(json.dumps([asdict(s) for s in shards]).encode())
        files.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Shard | None]) -> None:
        files, folder = opened(self.path)
        for m in messages:
            if m is not None and files.get_file_info(f"{folder}/{m.name}").type == fs.FileType.File:
                files.delete_file(f"{folder}/{m.name}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids = path, with_ids

    def partitions(self) -> list[Piece]:
        files, folder = opened(self.path)
        with files.open_input_file(f"{folder}/{MANIFEST}") as source:
            shards = json.loads(source.read())
        pieces, before = [], 0
        for s in shards:
            # A document without ids may begin at the very end of a shard.
            pieces += [Piece(s["name"], before, at, min(at + IDS_AT_A_TASK, s["n_ids"] + 1)) for at in range(0, s["n_ids"] + 1, IDS_AT_A_TASK)]
            before += s["n_ids"]
        return pieces or [Piece("", 0, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = opened(self.path)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        held = 0
        with files.open_input_file(f"{folder}/{partition.name}") as source:
            shard = ShardReader(source, source.size())
            for d in shard.documents(partition.begin, partition.end, self.with_ids):
                rows.append((d.doc_id, partition.before + d.start, d.n_tokens, d.ids_crc32))
                if self.with_ids:
                    ids.append(d.ids)
                    held += len(d.ids)
                if len(rows) >= 10_000 or held >= 1 << 20:
                    yield self._batch(names, rows, ids)
                    rows, ids, held = [], [], 0
        if rows:
            yield self._batch(names, rows, ids)

    def _batch(self, names: list[str], rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        if self.with_ids:
            edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, [*names, "ids"][: len(arrays)])


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>, ``end_id`` behind them) of every document, in ascending order of the id.

    One range shuffle. Rows that repeat an id follow each other by the hash of their texts and may be dealt to several
    tasks; null ids come first. Null text counts as empty. An id that is no integer is an error.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer, not {kind}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tie = free_name(rows, "tie")
    order = ["doc_id", F.xxhash64("text"), tie]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkTokens(tokenizer_path)
        for batch in batches:
            for some in sliced_by_bytes(batch, 1, BYTES_AT_A_TIME):
                ids, starts = coder.encode(some.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], ["doc_id", "ids"])

    return dealt.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", percentile: float = 0.9) -> None:
    """Encodes every whole text and writes the shards and the manifest of ``folder``, which must have none yet."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenBlocks)
    with batches_of(spark, BATCH_ROWS):
        ids = token_ids(docs, tokenizer_path, end_id, id_col, text_col)
        ids.write.format(FORMAT).option("percentile", percentile).mode("append").save(folder)


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of each document."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format(FORMAT).option("ids", str(ids).lower()).load(folder)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Writes the documents' ids to ``folder`` (a new shared one by default) and returns what the files say.

    * Null and empty texts are the end token alone. Null ids are kept and come first; repeated rows are all written.
    * Special tokens' strings in a text are what the tokenizer makes of them. Texts of any length are written whole.
    * An empty table writes a manifest without shards and gives an empty result. Other columns are ignored.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, folder, ids)
