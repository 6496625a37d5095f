"""Token ids as Arrow IPC files of fixed-size lists, for zero-copy random access to equal-length sequences and masks.

A data set is a folder of pairs of files: `part-NNNNN-*.arrow` holds the ids of consecutive documents, cut into rows of
`length` ids with a bit mask of the real ones (only a file's last row is padded), in record batches of `rows_per_batch`
rows; `part-NNNNN-*.index.arrow` holds doc_id, start (in the file) and n_tokens of each document. The manifest names the
files of the attempts that counted; files of attempts that were lost are in no manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import in_id_order, map_batches, new_path, resident, running_base, stage, text_slices
from tracewell.llm.tokens import WordEncoder, public_path

def word_encoder(vocabulary: str, cache: int = 192 << 20) -> WordEncoder:
    """One encoder per Python worker: its cache of about so many bytes lasts over tasks."""
    return resident(("words", vocabulary, cache), lambda: WordEncoder(public_path(vocabulary), cache))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("/") else f"file://{uri}")


class TokenWriter:
    """Writes ids of documents, in the order given, to one file pair."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, rows_per_batch: int):
        self.fs, path = file_system(uri)
        self.path, self.length, self.rows, self.dtype = path, length, rows_per_batch, dtype
        self.ids_type = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length)
        self.mask_type = pa.list_(pa.field("item", pa.bool_(), nullable=False), length)
        self.schema = pa.schema([pa.field("ids", self.ids_type, nullable=False), pa.field("mask", self.mask_type, nullable=False)])
        self.sink = self.fs.open_output_stream(path)
        self.out = ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.index: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        """Write whole batches; at the end also the rest, its last row padded. All batches but the last have the same rows."""
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = self.length * self.rows
        whole = len(ids) // step * step
        for a in range(0, whole, step):
            self._batch(ids[a : a + step], step)
        rest = ids[whole:]
        if last and len(rest):
            self._batch(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.ids_type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask_type)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        doc_ids, starts, lengths = zip(*self.index) if self.index else ((), (), ())
        table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())})
        with self.fs.open_output_stream(self.path.removesuffix(".arrow") + ".index.arrow") as sink, ipc.new_file(sink, table.schema) as out:
            out.write_table(table)


class TokenReader:
    """Random access to one file pair. Local files are memory-mapped: ids and masks are views of the file, not copies."""

    def __init__(self, uri: str):
        self.fs, path = file_system(uri)
        opened = pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path)
        self.file = ipc.open_file(opened)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        with self.fs.open_input_file(path.removesuffix(".arrow") + ".index.arrow") as source:
            self.index = ipc.open_file(source).read_all()

    def batch_ids(self, k: int) -> np.ndarray:
        """The ids of one record batch, padding included."""
        return self.file.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Row k of the file: its ids as a view, and its mask."""
        size = self.rows
        batch = self.file.get_batch(k // size)
        a = (k % size) * self.length
        return batch.column("ids").values.to_numpy(zero_copy_only=True)[a : a + self.length], batch.column("mask").values.slice(a, self.length)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, from the batches in order."""
        held, base, k = np.empty(0, np.uint32), 0, 0
        for doc_id, start, n in zip(*(self.index.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            parts = []
            while start + n > base + len(held):
                if start < base + len(held):
                    parts.append(held[max(0, start - base) :])
                base += len(held)
                held, k = self.batch_ids(k), k + 1
            a = max(start, base) - base
            parts.append(held[a : start + n - base])
            yield doc_id, start, np.concatenate(parts) if len(parts) > 1 else parts[0]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, length: int = 2048, rows_per_batch: int = 256) -> DataFrame:
    """Write the ids of every text in ascending doc_id order to files under path; returns the manifest, one row per file.

    Manifest: part (order of the files), file, n_docs, n_tokens and base (ids in the files before). Defined results: a null
    text is an empty one, whose only id is the end id; null doc_ids come first; rows of equal doc_id are ordered by a hash
    of their text, so equal rows are equal documents; other columns are not read; an empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        part, writer = TaskContext.get().partitionId(), None
        end = np.array([end_id], dtype=encoder.dtype)
        for batch in text_slices(batches, "__text", 2 << 20):
            if writer is None:
                name = f"{path}/part-{part:05d}-{uuid.uuid4().hex}.arrow"
                file_system(path)[0].create_dir(file_system(path)[1], recursive=True)
                writer = TokenWriter(name, encoder.dtype, length, rows_per_batch)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(batch.column("__text").to_pylist())):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.index)], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

    manifest = stage(map_batches(in_id_order(docs), run, "part int, file string, n_docs long, n_tokens long"), "token-manifest")
    return running_base(manifest, "part", "n_tokens")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                rows = [(d, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in TokenReader(file).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return map_batches(manifest.select("file", "base").repartition(files), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Write docs in the file format to the shared folder, and read the files back."""
    return read_token_files(write_token_files(docs, new_path(spark, "tokens"), vocabulary, end_id))
