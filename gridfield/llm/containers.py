"""Token-ID output: every document's ids compressed apart, with one zstandard dictionary that all of them share.

File format.  A data set is a folder with two Parquet tables.  ``dictionary`` has one row, the dictionary and its sha256.
``containers`` has a row a container, with the smallest and largest doc_id in it (null: without doc_ids); a container is one
binary cell: ``GFID`` | version u16 | without ids u16 | documents u32 | sha256 of the dictionary (32 bytes) | index | frames.
The index has, for each document in order, doc_id i64, offset of its frame u64 (from the first frame), length of its
frame u32, number of ids u32.  A frame is a zstandard frame, made with the dictionary, of the ids as little-endian u16
(where all fit) or u32; the version says which.  One document is read by the table's bounds and its index entry, without
the others (``TokenFiles.document``).

Plan.  The dictionary is trained on the driver on a bounded sample: the ``SAMPLE_DOCUMENTS`` documents whose ids have the
smallest hashes are chosen by id alone, encoded whole where they lie, and sent as ids, of long ones ``SLICES`` slices spread
over the document.  Where that is too little for zstandard to train on, the sample itself is the dictionary.  Tasks encode and
compress where the texts lie; the small frames, not the texts, are then dealt out by ranges of doc_id and sorted, and a
container takes up to ``container_bytes``.  Rows of one doc_id, or of none, are told apart by the place where they were
encoded, so that any number of them is dealt to many tasks.  A document's start is the sum over earlier ranges (one number a range),
earlier containers of its range and earlier documents of its container.

Cases.  Null or blank text: the end id alone.  Null doc_id: after all others, in containers of their own.  Rows that repeat a
doc_id: each is a document, in the order in which they were encoded.  Very long texts: a container of their own.  Extra columns,
whatever their names, aren't carried.  Empty table: no container, empty result.
"""

from __future__ import annotations

import hashlib
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.llm import runtime
from gridfield.llm.encoding import WordEncoder, encoder
from gridfield.llm.runtime import LAST_ID, Scratch, partitions_for, release, sampled

runtime.ship(sys.modules[__name__])

MAGIC, HEAD, ENTRY = b"GFID", "<4sHHI32s", np.dtype([("id", "<i8"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4")])
NARROW, WIDE = 1, 2
#: Bytes of ids that one zstandard dictionary covers, and documents that it is trained on.
DICTIONARY_BYTES, SAMPLE_DOCUMENTS = 64 * 1024, 2000
#: A sampled document of more ids than all of these gives as many slices of so many ids.
SLICES, SLICE = 8, 1024
#: Rows of a batch that are taken at a time.
ROWS = 500
KINDS = {"id": pa.int64(), "none": pa.bool_(), "place": pa.int64(), "version": pa.int32(), "n": pa.int64(), "frame": pa.binary()}
FRAMES = "id long, none boolean, place long, version int, n long, frame binary"


def _bare(ids: bytes) -> tuple[int, bytes]:
    wide = np.frombuffer(ids, "<u4")
    return (NARROW, wide.astype("<u2").tobytes()) if not len(wide) or wide.max() < 1 << 16 else (WIDE, ids)


def _sampled(path: str, end_id: int):
    def task(batches):
        release()
        own, end = WordEncoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(own.encode(batch.column(0)[k].as_py()) + end, "<u4")
                if len(ids) > SLICES * SLICE:
                    ids = np.concatenate([ids[a : a + SLICE] for a in np.linspace(0, len(ids) - SLICE, SLICES).astype(int)])
                yield pa.RecordBatch.from_arrays([pa.array([_bare(ids.tobytes())[1]], pa.binary())], ["ids"])

    return task


def train_dictionary(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> bytes:
    """A dictionary for the ids of documents like these; no bytes for an empty table."""
    import zstandard

    key = F.col(f"`{id_column}`").cast("long")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text")
    chosen = {r["id"] for r in sampled(docs.select(key.alias("id")).where("id is not null"), "id", sample_documents).collect()}
    texts = docs.select(text)
    if chosen:
        ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "sample_id long")
        texts = docs.select(key.alias("id"), text).join(F.broadcast(ids), F.col("id") == F.col("sample_id"))  # at most sample_documents ids
    samples = sorted(r["ids"] for r in texts.select("text").limit(sample_documents).mapInArrow(_sampled(path, end_id), "ids binary").collect())
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 20)), samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def _loaded(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _frames(path: str, end_id: int, dictionary: bytes):
    def task(batches):
        import zstandard
        from pyspark import TaskContext

        release(keep=True)
        own, end = encoder(path), end_id.to_bytes(4, "little")
        squeeze, place = zstandard.ZstdCompressor(level=3, dict_data=_loaded(dictionary)).compress, TaskContext.get().partitionId() << 40
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            n = batch.num_rows
            ids = [own.encode(t) + end for t in batch.column(2).to_pylist()]
            bare = [_bare(x) for x in ids]
            columns = (*batch.columns[:2], np.arange(place, place + n), [v for v, _ in bare], [len(x) // 4 for x in ids], [squeeze(x) for _, x in bare])
            place += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, KINDS.values(), strict=True)], list(KINDS))

    return task


def pack_container(rows: list[tuple[int, bool, int, int, bytes]], digest: bytes) -> bytes:
    """rows: id, whether there is none, version, number of ids, frame; all of one version, all with ids or all without."""
    sizes = np.array([len(r[4]) for r in rows], np.int64)
    index = np.zeros(len(rows), ENTRY)
    index["id"], index["n"], index["size"], index["at"] = [r[0] for r in rows], [r[3] for r in rows], sizes, np.cumsum(sizes) - sizes
    return struct.pack(HEAD, MAGIC, rows[0][2], rows[0][1], len(rows), digest) + index.tobytes() + b"".join(r[4] for r in rows)


def open_container(blob: bytes, dictionary: bytes):
    """The index, a function from a document's place in it to its ids, and whether the documents have no doc_id."""
    import zstandard

    magic, version, none, n, digest = struct.unpack_from(HEAD, blob)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a container of this dictionary")
    index = np.frombuffer(blob, ENTRY, n, struct.calcsize(HEAD))
    first, kind = struct.calcsize(HEAD) + n * ENTRY.itemsize, "<u2" if version == NARROW else "<u4"
    loose = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary)).decompress

    def read(k: int) -> np.ndarray:
        at = first + int(index["at"][k])
        return np.frombuffer(loose(blob[at : at + int(index["size"][k])]), kind).astype("<u4")

    return index, read, bool(none)


CONTAINERS = "part long, turn long, before long, documents long, ids long, first_id long, last_id long, blob binary"


def _fill(digest: bytes, container_bytes: int, container_documents: int):
    def task(batches):
        release()
        from pyspark import TaskContext

        part, turn, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        names = [x.split()[0] for x in CONTAINERS.split(", ")]

        def out():
            nonlocal turn, before, held, size
            n = sum(r[3] for r in held)
            ends = (None, None) if held[0][1] else (held[0][0], held[-1][0])
            values = (part, turn, before, len(held), n, *ends, pack_container(held, digest))
            turn, before, held, size = turn + 1, before + n, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if c == "blob" else pa.int64()) for c, x in zip(names, values, strict=True)], names)

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size + len(row[4]) > container_bytes or len(held) >= container_documents or row[1:3] != held[0][1:3]):
                    yield out()
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    return task


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(dictionary: bytes):
    def task(batches):
        release()
        import zlib

        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                index, read, none = open_container(blob.as_py(), dictionary)
                sizes, crc = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
                for k in range(len(index)):
                    ids = read(k)
                    sizes[k], crc[k] = len(ids), zlib.crc32(ids.tobytes())
                if (sizes != index["n"]).any():
                    raise ValueError("a frame doesn't hold what the index says")
                ids = pa.array(index["id"], pa.int64(), mask=np.full(len(index), none))
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return task


def _one(dictionary: bytes, doc_id: int):
    """Only that document's frames are opened."""

    def task(batches):
        for batch in batches:
            for blob in batch.column(0):
                index, read, _ = open_container(blob.as_py(), dictionary)
                for k in np.flatnonzero(index["id"] == doc_id):
                    yield pa.RecordBatch.from_arrays([pa.array([read(int(k)).tolist()], pa.list_(pa.int64()))], ["ids"])

    return task


class TokenFiles:
    """A written data set."""

    def __init__(self, table: DataFrame, dictionary: bytes):
        self.table, self.dictionary = table, dictionary

    @staticmethod
    def open(spark: SparkSession, folder: str) -> TokenFiles:
        row = spark.read.parquet(f"{folder}/dictionary").first()
        if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
            raise ValueError("the dictionary is damaged")
        return TokenFiles(spark.read.parquet(f"{folder}/containers"), bytes(row["dictionary"]))

    def document(self, doc_id: int) -> list[list[int]]:
        """The ids of the documents with this doc_id; containers that can't have it aren't read."""
        rows = self.table.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "turn").select("blob")
        return [r["ids"] for r in rows.mapInArrow(_one(self.dictionary, doc_id), "ids array<long>").collect()]

    def digests(self) -> DataFrame:
        """Reads every container: doc_id, start, n_tokens, ids_crc32."""
        spark = self.table.sparkSession
        totals = {r["part"]: r["n"] for r in self.table.groupBy("part").agg(F.sum("ids").alias("n")).collect()}  # one number a range
        bases, at = [], 0
        for part in sorted(totals):
            bases.append((part, at))
            at += totals[part]
        base = spark.createDataFrame(bases, "part long, base long")
        return self.table.join(base, "part").select((F.col("base") + F.col("before")).alias("base"), "blob").mapInArrow(_read(self.dictionary), DIGESTS)


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", container_bytes: int = 1 << 20, container_documents: int = 4096) -> TokenFiles:
    """Writes a data set to a folder, and opens it; without one, to a folder that goes when the driver ends."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ids")
    folder = (folder or f"{scratch.root}/files").rstrip("/")
    dictionary = train_dictionary(docs, path, end_id, id_column, text_column)
    digest = hashlib.sha256(dictionary)
    key = F.col(f"`{id_column}`").cast("long")
    texts = docs.select(F.coalesce(key, F.lit(LAST_ID)).alias("id"), key.isNull().alias("none"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("text"))
    frames = scratch.save(texts.mapInArrow(_frames(path, end_id, dictionary), FRAMES), "frames", "none")  # compressed already
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    order = ["none", "id", "place"]
    dealt = frames.repartitionByRange(partitions_for(spark, size, 64e6), *order).sortWithinPartitions(*order).drop("place")
    dealt.mapInArrow(_fill(digest.digest(), container_bytes, container_documents), CONTAINERS).write.option("compression", "none").parquet(f"{folder}/containers")
    spark.createDataFrame([(digest.hexdigest(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    scratch.drop(frames)
    return TokenFiles.open(spark, folder)
