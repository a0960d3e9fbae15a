"""Token ids as Arrow files of equal-length sequences.

A shard is one Arrow file (the random-access form of the stream format). Its record batches have two
columns of fixed-size lists: ``ids`` (unsigned, 16 bits where the vocabulary allows it, else 32) and
``mask`` (true where the id is real, false in the padding of a shard's last sequence). Both columns are
plain buffers of fixed width, so that a mapped file gives any sequence without a copy. Beside it lies
a file that has the shard's documents: doc_id, start and n_tokens.

Documents are laid out in range partitions over doc_id (and a hash of the text), and each becomes a shard. Shards count for
nothing until they are named in the manifest, which Spark writes; what a lost or repeated task left
behind is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, stage
from millrace.llm.tokens import encoder
from millrace.operators.staging import new_path

SEQUENCE = 2048
#: Sequences in a record batch: a writer holds no more than these, whatever the shard's size.
BATCH = 128
MANIFEST = "shard long, path string, n_docs long, n_tokens long"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard: ids in equal-length sequences, and the list of documents."""

    def __init__(self, path: str, width: int, length: int = SEQUENCE):
        self._length, self._type = length, {16: pa.uint16(), 32: pa.uint32()}[width]
        self._dtype = np.dtype(f"<u{width // 8}")
        self.schema = pa.schema([("ids", pa.list_(self._type, length)), ("mask", pa.list_(pa.bool_(), length))])
        store, place = _open(path)
        self._files = [store.open_output_stream(f"{place}{end}") for end in (".ids.arrow", ".docs.arrow")]
        self._ids = ipc.new_file(self._files[0], self.schema)
        self._docs = ipc.new_file(self._files[1], DOCUMENTS)
        self._held: list[np.ndarray] = []
        self._n_held = self.n_tokens = self.n_docs = 0
        self._rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._rows.append((doc_id, self.n_tokens, len(ids)))
        self._held.append(ids.astype(self._dtype))
        self._n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self._n_held >= self._length * BATCH:
            self._flush(last=False)
        if len(self._rows) >= 1 << 16:
            self._flush_rows()

    def _flush(self, last: bool) -> None:
        """Write what is held in batches of ``BATCH`` sequences; only the last of a shard may have fewer."""
        ids = np.concatenate(self._held) if self._held else np.empty(0, self._dtype)
        full = self._length * BATCH
        n = len(ids) if last else len(ids) // full * full
        for at in range(0, n, full):
            part = ids[at : min(n, at + full)]
            size = -(-len(part) // self._length) * self._length
            padded, mask = np.zeros(size, self._dtype), np.zeros(size, bool)
            padded[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (padded, mask)]
            self._ids.write_batch(pa.record_batch(lists, schema=self.schema))
        self._held, self._n_held = [ids[n:]], len(ids) - n

    def _flush_rows(self) -> None:
        if self._rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*self._rows, strict=True)]
            self._docs.write_batch(pa.record_batch(columns, schema=DOCUMENTS))
            self._rows = []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_rows()
        for writer in (self._ids, self._docs, *self._files):
            writer.close()


class ShardReader:
    """Random access to a shard: sequences and masks as views of the file's own buffers."""

    def __init__(self, path: str):
        store, place = _open(path)
        def opened(end: str) -> ipc.RecordBatchFileReader:
            if isinstance(store, fs.LocalFileSystem):
                return ipc.open_file(pa.memory_map(f"{place}{end}"))
            return ipc.open_file(store.open_input_file(f"{place}{end}"))

        self._ids, self._docs = opened(".ids.arrow"), opened(".docs.arrow")
        self.length = self._ids.schema.field("ids").type.list_size

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the k-th sequence of the shard, as views: neither is copied. The mask is bit-packed."""
        batch = self._ids.get_batch(k // BATCH)
        ids, mask = (batch.column(c).slice(k % BATCH, 1).flatten() for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard and ids of every document, from the sequences' real positions."""
        batches, held, at = self._real(), np.empty(0, "<u4"), 0
        for k in range(self._docs.num_record_batches):
            batch = self._docs.get_batch(k)
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, have = [held[start - at :]], len(held) - (start - at)
                while have < n:
                    at, held = at + len(held), next(batches)
                    parts.append(held)
                    have += len(held)
                yield doc_id, start, np.concatenate(parts)[:n] if len(parts) > 1 else parts[0][:n]

    def _real(self) -> Iterator[np.ndarray]:
        for k in range(self._ids.num_record_batches):
            batch = self._ids.get_batch(k)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            yield ids[batch.column(1).flatten().to_numpy(zero_copy_only=False)]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; return the staged manifest.

    The manifest has one row per shard: ``shard`` (in document order), ``path``, ``n_docs``,
    ``n_tokens``. A NULL text counts as empty; every document ends in ``end_id``. NULL doc_ids come
    first; rows of one doc_id are all kept, in the order of a hash of their texts, which also lets ranges
    split a doc_id that very many rows bear. Other columns are left out.
    """
    folder = folder or new_path(docs.sparkSession, "arrow")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        writer = path = None
        for batch in batches:
            for shard, doc_id, text in zip(batch["shard"], batch["doc_id"], batch["text"], strict=True):
                if writer is None:
                    store, place = _open(folder)
                    store.create_dir(place, recursive=True)
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
                    writer = ShardWriter(path, width_of(tokenizer), length)
                writer.add(None if doc_id is None else int(doc_id), np.frombuffer(encode(text) + end, "<u4"))
        if writer is not None:
            writer.close()
            row = {"shard": shard, "path": path, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}
            yield pd.DataFrame([row])

    wanted = docs.select(*columns_of(docs, doc_id="long", text="string"))
    hashed = wanted.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    # doc_id travels as text, as pandas would turn numbers beside NULLs into floats.
    ordered = ordered.select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("string"), "text")
    return stage(ordered.mapInPandas(shards, MANIFEST), "manifest")


def width_of(tokenizer: str) -> int:
    """Bits of an id: 16 where every id of the vocabulary fits."""
    return 16 if encoder(tokenizer)._tokenizer.get_vocab_size() <= 1 << 16 else 32


def read(manifest: DataFrame) -> DataFrame:
    """Documents from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                out = []
                for doc_id, start, ids in ShardReader(path).documents():
                    out.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 1 << 14:
                        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    # One row per shard; the running total of their sizes gives each shard's first position.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # The manifest is tiny, so only a fixed number keeps its shards in tasks of their own.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = based.repartition(tasks, "shard").select("path", "base")
    return spread.mapInPandas(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
