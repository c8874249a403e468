"""Token ids as length-delimited binary records with a separate offset index.

Record (all little-endian): u64 payload length, u32 masked checksum of these 8 bytes, payload, u32
masked checksum of the payload. Payload: u8 flags (1: the id is null, 2: ids take 4 bytes, else 2),
i64 document id, ids. Index: per record i64 byte offset of the frame, i64 ids before it in the
shard, i64 number of ids, so any record can be fetched in one seek; after the last entry a u32 masked
checksum of the whole index. The checksum is CRC-32, rotated right by 15 bits plus a constant
("masked"), so that data holding checksums does not check itself. A reader that goes through a shard
holds it against the manifest as well: the numbers of records and ids, and no bytes after the last.

Shards cover rising ranges of doc_id. A task writes its shard under a name of its own and reports
it as a row; only files named by the committed manifest count, so a task that is run again, or twice
at once, does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from returnsight.llm.common import gathered, ready, shared_path, staged
from returnsight.llm.tokens import LibraryChunks, sliced_ids, worker_table

MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("offset", "<i8"), ("start", "<i8"), ("n", "<i8")])
HEAD = struct.Struct("<Bq")
MANIFEST = "shard int, path string, first_start long, n_records long, n_ids long"


def masked(data: bytes) -> int:
    return masked_crc(zlib.crc32(data))


def masked_crc(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """(payload, position after the record) of the record at ``at``; ValueError if damaged."""
    if len(data) < at + 12:
        raise ValueError(f"record at byte {at} is cut short")
    length = bytes(data[at : at + 8])
    n = struct.unpack("<Q", length)[0]
    if struct.unpack_from("<I", data, at + 8)[0] != masked(length) or len(data) < at + n + 16:
        raise ValueError(f"damaged length at byte {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged payload at byte {at}")
    return payload, at + n + 16


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return HEAD.pack((doc_id is None) | 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = HEAD.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=HEAD.size).astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """Hadoop writes a local URI with one slash; Arrow wants three."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write ids of every text (null: empty) in ascending doc_id order (a null id first, rows of equal
    ids in the order of a hash of their texts) as shards in ``folder``; returns the manifest, one row
    per shard.

    The texts cross one range shuffle on doc_id and that hash, so that rows without an id or of one id
    are spread like any others; each task streams its range to one shard."""
    spark = ready(docs).sparkSession
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_table(LibraryChunks, vocabulary)
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        path = _filesystem(name)[1]
        at = before = records = crc = 0
        with files.open_output_stream(f"{path}.rec") as out, files.open_output_stream(f"{path}.idx") as index:
            for batch in gathered(batches, text=1):
                doc_ids = batch.column(0).to_pylist()
                for lo, ids, ends in sliced_ids(encoder, batch.column(1), end_id):
                    entries = np.zeros(len(ends) - 1, INDEX)
                    bounds, records_of = ends.tolist(), []
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        records_of.append(frame(pack_ids(doc_ids[lo + k], ids[a:b])))
                        entries[k] = at, before + a, b - a
                        at += len(records_of[-1])
                    out.write(b"".join(records_of))
                    index.write(entries.tobytes())
                    crc = zlib.crc32(entries.tobytes(), crc)
                    before, records = before + int(ends[-1]), records + len(entries)
            index.write(struct.pack("<I", masked_crc(crc)))
        row = [TaskContext.get().partitionId()], [name], [0], [records], [before]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "first_start", "n_records", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    manifest = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("first_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_index(data: bytes, path: str) -> np.ndarray:
    """Entries of an index, their checksum verified."""
    entries = data[:-4]
    if len(data) < 4 or len(entries) % INDEX.itemsize or struct.unpack("<I", data[-4:])[0] != masked(entries):
        raise ValueError(f"{path}: damaged index")
    return np.frombuffer(entries, INDEX)


def read_shard(path: str, n_records: int | None = None, n_ids: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, ids before it in the shard, ids) of each record. ValueError if a checksum is wrong,
    if records and index differ, or if there are not ``n_records`` and ``n_ids``, where given."""
    files, local = _filesystem(path)
    with files.open_input_file(f"{local}.idx") as f:
        index = read_index(f.read(), path)
    if n_records is not None and len(index) != n_records:
        raise ValueError(f"{path}: the index has {len(index)} records, the manifest {n_records}")
    with files.open_input_stream(f"{local}.rec") as f:
        at = before = 0
        for offset, start, n in index.tolist():
            if offset != at or start != before:
                raise ValueError(f"{path}: the index points to {offset} after {start} ids, the record is at {at} after {before}")
            head = f.read(12)
            size = struct.unpack_from("<Q", head)[0] if len(head) == 12 else 0
            payload, size = unframe(head + f.read(size + 4))
            doc_id, ids = unpack_ids(payload)
            if len(ids) != n:
                raise ValueError(f"{path}: {len(ids)} ids at {offset}, the index has {n}")
            at, before = at + size, before + n
            yield doc_id, start, ids
        if f.read(1):
            raise ValueError(f"{path}: bytes after the last record, at {at}")
    if n_ids is not None and before != n_ids:
        raise ValueError(f"{path}: {before} ids, the manifest has {n_ids}")


def fetch(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record ``k`` of a shard by one look into the index and one seek (shuffled reads)."""
    files, local = _filesystem(path)
    with files.open_input_file(f"{local}.idx") as f:
        offset = int(np.frombuffer(f.read_at(INDEX.itemsize, k * INDEX.itemsize), INDEX)["offset"][0])
    with files.open_input_file(f"{local}.rec") as f:
        size = struct.unpack("<Q", f.read_at(8, offset))[0]
        return unpack_ids(unframe(f.read_at(size + 16, offset))[0])


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's shards: doc_id, start (ids of all records before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for doc_id, start, ids in read_shard(row["path"], row["n_records"], row["n_ids"]):
                    out.append((doc_id, row["first_start"] + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    n = ready(manifest).count()
    return manifest.repartition(max(1, n), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write all of ``docs`` to the shared folder and read it back.

    Null texts count as empty (the end id alone); an empty table gives no rows; extra columns are
    ignored; repeated ids are all kept."""
    folder = shared_path(docs.sparkSession, "records")
    return read_records(write_records(docs, vocabulary, folder, end_id))
