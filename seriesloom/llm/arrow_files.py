"""Token ids in Arrow files: equal-length sequences and masks that are read without copying.

Every shard is one Arrow IPC file of record batches with the columns

- ``input_ids``: fixed-size list of unsigned integers, ``length`` ids each,
- ``attention_mask``: fixed-size list of booleans, false only where a shard's last sequence is filled up,
- ``doc_ids``, ``doc_starts``: the documents that begin in the sequence and where they do.

Fixed-size lists lie back to back in a batch, so a memory-mapped file gives any sequence as a view. All
documents of a shard follow one another without gaps, each with its end id, in ascending order of doc_id
(NULL first; equal ids by their text), and the shards follow one another in the same order.

Null texts count as empty: such a document is the end id alone. Repeated ids are all written. A doc_id is a whole number. Other
columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import only
from seriesloom.llm.tokens import encoder
from seriesloom.session import store, work_dir

LENGTH = 2048
ROWS = 128
FILL = 0


def schema(length: int, dtype: str) -> pa.Schema:
    kind = {"uint16": pa.uint16(), "uint32": pa.uint32()}[dtype]
    return pa.schema([
        ("input_ids", pa.list_(kind, length)), ("attention_mask", pa.list_(pa.bool_(), length)),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())),
    ], metadata={"rows": str(ROWS), "length": str(length), "dtype": dtype})


class ShardWriter:
    """Collects ids and writes a batch whenever ``ROWS`` sequences are full."""

    def __init__(self, sink, length: int, dtype: str):
        self.schema, self.length, self.dtype = schema(length, dtype), length, np.dtype(dtype)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.written = 0
        self.begun: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} does not fit into {self.dtype}")
        self.begun.append((doc_id, self.written + self.held))
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= ROWS * self.length:
            self._flush(self.held // (ROWS * self.length) * ROWS * self.length)

    def _flush(self, count: int) -> None:
        joined = np.concatenate(self.parts)
        self.parts, self.held = [joined[count:]], len(joined) - count
        for at in range(0, count, ROWS * self.length):
            self._batch(joined[at : min(at + ROWS * self.length, count)])

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.full(rows * self.length, FILL, self.dtype)
        full[: len(ids)] = ids
        mask = np.zeros(rows * self.length, bool)
        mask[: len(ids)] = True
        end = self.written + len(ids)
        here = [x for x in self.begun if x[1] < end]
        self.begun = self.begun[len(here) :]
        docs: list[list] = [[] for _ in range(rows)]
        starts: list[list] = [[] for _ in range(rows)]
        for doc_id, at in here:
            row, offset = divmod(at - self.written, self.length)
            docs[row].append(doc_id)
            starts[row].append(offset)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(full), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            pa.array(docs, self.schema.field("doc_ids").type), pa.array(starts, self.schema.field("doc_starts").type),
        ]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written = end

    def close(self) -> int:
        if self.held:
            self._flush(self.held)
        self.file.close()
        return self.written


class SequenceFile:
    """Random access to the sequences of one shard. On a local path they are views of the mapped file."""

    def __init__(self, path: str):
        filesystem, name = pafs.FileSystem.from_uri(path)
        source = pa.memory_map(name) if isinstance(filesystem, pafs.LocalFileSystem) else filesystem.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.rows = int(self.file.schema.metadata[b"rows"])
        self.length = int(self.file.schema.metadata[b"length"])

    def batches(self):
        for k in range(self.file.num_record_batches):
            yield self.file.get_batch(k)

    def __len__(self) -> int:
        count = self.file.num_record_batches
        return (count - 1) * self.rows + self.file.get_batch(count - 1).num_rows if count else 0

    def sequence(self, number: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view without copying) and mask of one sequence."""
        batch, row = divmod(number, self.rows)
        got = self.file.get_batch(batch)
        ids = got.column(0).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=True)
        return ids, got.column(1).values.slice(row * self.length, self.length)

    def documents(self):
        """(doc_id, start in the shard, n_tokens, crc32 of the ids as 32-bit integers) in file order."""
        current = None
        for batch in self.batches():
            mask = batch.column(1).values
            ids = batch.column(0).values.to_numpy(zero_copy_only=True)[: mask.true_count].astype("<u4").tobytes()
            base, begun = 0, []
            for docs, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                begun += [(doc, base + at) for doc, at in zip(docs, starts, strict=True)]
                base += self.length
            at = 0
            for (doc, start), end in zip([(None, None), *begun], [*(s for _, s in begun), len(ids) // 4], strict=True):
                if start is not None:
                    if current:
                        yield tuple(current)
                    previous = current[1] + current[2] if current else 0
                    current, at = [doc, previous, 0, 0], start
                if current and end > at:
                    current[2] += end - at
                    current[3] = zlib.crc32(ids[4 * at : 4 * end], current[3])
                at = end
        if current:
            yield tuple(current)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = LENGTH,
                 dtype: str | None = None) -> DataFrame:
    """Write the ids of all documents below ``folder``; one row (shard, path, n_tokens, n_docs) per file.

    One shuffle puts the documents in order. A task writes its file under a name of its own and moves
    it into place at the end, so a repeated task replaces the file with the same one. Ids take two bytes where the
    vocabulary and the end id allow it, else four.
    """
    if dtype is None:
        dtype = "uint16" if max(encoder(tokenizer).library.get_vocab_size() - 1, end_id) < 1 << 16 else "uint32"
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)

    def write(batches):
        only("tokens")
        encode_all, out, task, docs_seen = encoder(tokenizer).encode_all, None, TaskContext.get(), 0
        end = np.array([end_id], np.uint32).tobytes()
        target, base = pafs.FileSystem.from_uri(folder)
        shard = task.partitionId()
        unfinished = f"{base}/.{shard:06d}-{task.taskAttemptId()}"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1)), strict=True):
                if out is None:
                    sink = target.open_output_stream(unfinished)
                    out = ShardWriter(sink, length, dtype)
                out.add(doc_id, np.frombuffer(ids + end, np.uint32))
                docs_seen += 1
        if out is not None:
            total = out.close()
            sink.close()
            target.move(unfinished, f"{base}/{shard:06d}.arrow")
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{shard:06d}.arrow"],
                "n_tokens": pa.array([total], pa.int64()), "n_docs": pa.array([docs_seen], pa.int64()),
            })

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(write, "shard int, path string, n_tokens long, n_docs long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for row in SequenceFile(path).documents():
                    rows.append((row[0], base + row[1], row[2], row[3]))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                                          ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file; the running sum is over files, not documents.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = shards.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    tasks = max(1, shards.count())
    return based.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents' ids to Arrow files in a new shared folder and read them back."""
    folder = work_dir(spark, "tokens")
    return read_shards(write_shards(docs, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}",
                                    tokenizer, end_id))
