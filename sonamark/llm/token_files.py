"""Token-id files: length-delimited binary records with masked checksums, and a separate offset index.

A record is: length of the payload (uint64), masked CRC-32 of those eight bytes (uint32), payload, masked CRC-32 of the payload
(uint32), a line feed; all little-endian. The payload is one byte (1 if the id is null), the document id (int64) and the token
ids as uint16, or as uint32 if the vocabulary has more than 65,536 entries (one byte: 2 or 4). The mask rotates the sum right by
15 bits and adds a constant, so that a sum stored among the data doesn't pass for data. Spark's own text writer puts the records out (its line
separator is the record's last byte), so a task that fails or an executor that is lost leaves no half-written file, and any
store that Spark reaches will do. The files, by the number of their task and then of the file within it, hold the documents in ascending id order (nulls
first, then ties by a hash of the text); repeated rows are written each. The index (Parquet) has a row for each record: file, offset, size. Texts are split
into words by the vocabulary's own rule (bpe_lexicon) and the library's model encodes each word once; tests hold the ids to those of whole texts.

Null texts count as empty; each document ends with the end id. An empty table writes no records and gives an empty index. A very long text is one record
of a row of its own. Columns other than the two named are not read, so their names can't clash.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_lexicon import VOCABULARY, Memo, as_bytes, as_ids, word_bpe
from .common import arrow_rows, fresh_path, tokenizer_path

#: Fixed values of the format.
MASK = 0xA282EAD8
HEAD, IDS = struct.Struct("<QI"), struct.Struct("<BqB")
#: The writer's rows hold whole records up to this many bytes (or one that is longer), and a file has so many rows at most: no file is read as a whole that
#: has more than ROWS_PER_FILE * (ROW_BYTES + its longest record) bytes.
ROW_BYTES, ROWS_PER_FILE = 8 << 20, 8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record without its line feed."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def records(content: bytes):
    """(offset, size, payload) of each record of a file; ValueError where a checksum or length is wrong."""
    at = 0
    while at < len(content):
        if at + HEAD.size > len(content):
            raise ValueError(f"a cut record at {at}")
        n, check = HEAD.unpack_from(content, at)
        if masked(content[at : at + 8]) != check:
            raise ValueError(f"a wrong length at {at}")
        end = at + HEAD.size + n
        payload = content[at + HEAD.size : end]
        if len(content) < end + 5 or masked(payload) != struct.unpack_from("<I", content, end)[0] or content[end + 4 : end + 5] != b"\n":
            raise ValueError(f"a wrong payload at {at}")
        yield at, end + 5 - at, payload
        at = end + 5


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return IDS.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = IDS.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=IDS.size).astype("<u4")


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes with the tokenizers library (words outside the memo go to its model) and writes the record files."""
    path = path or tokenizer_path(VOCABULARY)
    spark = docs.sparkSession
    arrow_rows(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(batches):
        bpe = word_bpe(path)
        model, chars = bpe.library.model, bpe.to_chars
        memo = memos.setdefault(path, Memo(lambda w: as_ids([w] if isinstance(w, int) else [t.id for t in model.tokenize(as_bytes(w).decode("latin-1").translate(chars))])))
        width = 2 if max(bpe.size, end_id + 1) <= 1 << 16 else 4
        row = lambda own: pa.RecordBatch.from_pydict({"frame": pa.array([b"\n".join(own)], pa.binary())})
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(b"".join(map(memo.__getitem__, bpe.words(text))), "<u4")
                record = frame(pack(doc_id, np.append(ids, np.uint32(end_id)), width))
                if held and size + len(record) > ROW_BYTES:
                    yield row(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield row(held)

    frames = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("lineSep", "\n").text(folder)


memos: dict[str, Memo] = {}


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """Reads every file, checks every sum, and writes the index: doc_id, file, offset, size, start_in_file, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, total = [], 0
                for at, size, payload in records(content.as_py()):
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, name, at, size, total, len(ids), zlib.crc32(ids.tobytes())))
                    total += len(ids)
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), *[pa.int64()] * 5))], names=["doc_id", "file", "offset", "size", "start_in_file", "n_tokens", "ids_crc32"])

    path = f"{folder}-index"
    schema = "doc_id long, file string, offset long, size long, start_in_file long, n_tokens long, ids_crc32 long"
    arrow_rows(spark, 1)  # one file at a time in a worker
    files(spark, folder).mapInArrow(run, schema).write.parquet(path)
    arrow_rows(spark)
    return spark.read.schema(schema).parquet(path)


def files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load([*paths]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def with_starts(index: DataFrame) -> DataFrame:
    """index with start: ids of all documents before this one. Only one row for each file is ordered as a whole, by the numbers of its task and of the file
    within it, which have no fixed width."""
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    order = [F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)[^-]*$")]
    before = sums.select("file", F.coalesce(F.sum("in_file").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(before, "file").withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")


def read_indexed(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Token ids of the index rows in wanted, in any order or selection: (doc_id, file, offset, ids). Only files that have a wanted row are opened (their names
    come to the driver, which lists a folder's files anyway), and only wanted slices are decoded."""
    names = [f"{folder}/{r.file}" for r in wanted.select("file").distinct().collect()]
    if not names:
        return spark.createDataFrame([], "doc_id long, file string, offset long, ids array<long>")

    def cut(rows: pa.Table, content: pa.Table) -> pa.Table:
        data = content.column("content")[0].as_py() if content.num_rows else b""
        at = rows.select(["file", "offset", "size"]).to_pylist()
        got = [unpack(next(records(data[r["offset"] : r["offset"] + r["size"]]))[2]) for r in at]
        return pa.table({"doc_id": pa.array([g[0] for g in got], pa.int64()), "file": rows.column("file"), "offset": rows.column("offset"), "ids": pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))})

    return wanted.groupBy("file").cogroup(files(spark, *names).groupBy("file")).applyInArrow(cut, "doc_id long, file string, offset long, ids array<long>")


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs to record files in the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32, file, offset, size."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    write_token_files(docs, folder, path, end_id)
    return with_starts(build_index(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "size")
