"""Token ids as Arrow files of equal-length sequences.

Documents are dealt to shards by ranges of ``doc_id``; each task encodes its documents in that order and
writes the ids, end to end, as one Arrow IPC file: batches of two fixed-size lists, ``input_ids`` and
``attention_mask`` (a bit each in whole bytes, 0 on the padding of the last sequence). The column buffers are plain arrays, so
a reader that maps a file into memory gets any sequence without copying. A second file lists the
documents of the shard and where their ids begin. Ids are stored in 16 bits if the vocabulary allows.

Files are written under another name and renamed when complete, so a task that is run again replaces
its own file, and a reader never sees half of one. A task holds one batch of sequences in memory.

Edge cases: a null or empty text is the end token alone; rows that share an id follow each other, in
the order of their texts' hashes; a null id sorts first; an empty table writes no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowspark.llm import common, tokens
from flowspark.llm.registry import query, table
from flowspark.session import scratch_path

END_TOKEN = 2
SEQUENCE = 2048
BATCH_SEQUENCES = 128


def _open_fs(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


class ShardWriter:
    """Writes one shard; ids come in any portions, sequences go out in full batches."""

    def __init__(self, root: str, shard: int, attempt: int, kind: np.dtype, length: int):
        self.fs, base = _open_fs(root)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/shard-{shard:06d}"
        self.part = f"{base}/.attempt-{attempt}-{shard:06d}"
        self.kind, self.length = np.dtype(kind), length
        self.schema = pa.schema([
            ("input_ids", pa.list_(pa.from_numpy_dtype(self.kind), length)),
            ("attention_mask", pa.list_(pa.uint8(), -(-length // 8)))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{self.part}.{x}") for x in ("arrow", "docs.arrow")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.held: list[np.ndarray] = []
        self.waiting, self.n_tokens, self.n_docs = 0, 0, 0

    def add(self, doc_ids: list, ids: np.ndarray, first: np.ndarray) -> None:
        self.docs.write_batch(pa.record_batch(
            [pa.array(doc_ids, pa.int64()), pa.array(self.n_tokens + first[:-1]), pa.array(np.diff(first))],
            schema=self.docs_schema))
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += len(doc_ids)
        block = self.length * BATCH_SEQUENCES
        if self.waiting >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._write(flat[at: at + block], block)
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.packbits((np.arange(len(flat)) < used).reshape(-1, self.length), axis=1, bitorder="little")
        self.ids.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask.ravel()), mask.shape[1])], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.zeros(0, self.kind)])
        if len(flat):
            self._write(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        for stream in (self.ids, self.docs, *self.sinks):
            stream.close()
        for x in ("arrow", "docs.arrow"):
            self.fs.move(f"{self.part}.{x}", f"{self.path}.{x}")


class ShardReader:
    """Random access to a shard: mapped into memory where the file system is local."""

    def __init__(self, root: str, shard: int):
        fs, base = _open_fs(root)
        local = isinstance(fs, pafs.LocalFileSystem)

        def opened(name: str) -> pa.ipc.RecordBatchFileReader:
            return pa.ipc.open_file(pa.memory_map(name) if local else fs.open_input_file(name))

        self.file = opened(f"{base}/shard-{shard:06d}.arrow")
        self.docs = opened(f"{base}/shard-{shard:06d}.docs.arrow")
        self.length = self.file.schema.field("input_ids").type.list_size
        self._at, self._flat, self._mask = -1, None, None

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            flat = []
            for column in self.file.get_batch(i).columns:
                size = column.type.list_size
                values = column.values.slice(column.offset * size, len(column) * size)
                flat.append(values.to_numpy(zero_copy_only=True))
            self._at, (self._flat, self._mask) = i, flat
        return self._flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, packed mask) of sequence ``i``, both views of the mapped file; see ``unpacked``."""
        at, size = i % BATCH_SEQUENCES, -(-self.length // 8)
        ids = self._batch(i // BATCH_SEQUENCES)
        return ids[at * self.length: (at + 1) * self.length], self._mask[at * size: (at + 1) * size]

    def unpacked(self, mask: np.ndarray) -> np.ndarray:
        """A mask as one boolean per id."""
        return np.unpackbits(mask, count=self.length, bitorder="little").astype(bool)

    def span(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the shard on."""
        block, out = self.length * BATCH_SEQUENCES, []
        end = start + count
        while start < end:
            i, at = divmod(start, block)
            take = min(end - start, block - at)
            out.append(self._batch(i)[at: at + take])
            start += take
        return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint16)])


def write_tokens(docs: DataFrame, root: str, path: str, end: int = END_TOKEN, length: int = SEQUENCE,
                 text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all documents below ``root`` in ascending order of ``key``; returns the manifest
    ``shard, n_docs, n_tokens, start`` (``start``: ids in the shards before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        tool = tokens.encoder(path).tokenizer
        kind = np.uint16 if max(end, tool.get_vocab_size() - 1) < 1 << 16 else np.uint32
        writer = None
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, hi, ids, first in tokens.encoded(batch.column(1), path):
                writer = writer or ShardWriter(root, task.partitionId(), task.taskAttemptId(), kind, length)
                ids = np.insert(ids, first[1:], end)
                writer.add(ids_of[lo:hi], ids, first + np.arange(hi - lo + 1))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": task.partitionId(), "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}],
                pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = common.settle(rows.mapInArrow(run, "shard int, n_docs long, n_tokens long"), "shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(root, shard)
                for i in range(reader.docs.num_record_batches):
                    listed = reader.docs.get_batch(i)
                    starts, counts = listed.column(1).to_numpy(), listed.column(2).to_numpy()
                    ids = [reader.span(int(a), int(n)).astype("<u4").tobytes()
                           for a, n in zip(starts, counts)]
                    yield pa.RecordBatch.from_arrays(
                        [listed.column(0), pa.array(starts + base), listed.column(2),
                         pa.array(ids, pa.binary()),
                         pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    files = manifest.select("shard", "start").repartition(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


@query("op4_token_files")
def token_files(spark, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), root, tokens.vocabulary())
    return read_documents(manifest, root).select("doc_id", "start", "n_tokens", "ids_crc32")
