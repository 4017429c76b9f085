"""Token ids as files: frequency-ranked ids in byte-aligned variable-length code.

An id is replaced by its rank by frequency over the whole corpus, so that frequent ids take one
byte. Lengths (1 to 4 bytes, two bits each) stand in control bytes apart from the data bytes,
four ids to a control byte; both are decoded with numpy, the control bytes by a 256-row table.

A block is a self-contained byte string: magic "LWTB", version, counts, crc32, then document
ids, tokens per document, control bytes, data bytes. Blocks are stored in order in Parquet
files (columns file, block, ids, data), which any store that Spark reaches can hold;
`export` writes the bare blocks of one table to a local file. The rank table is stored beside.

Defined results: a null or empty text is its end id alone; equal doc_ids stay separate rows,
in an order of their own; a null doc_id comes first; an empty table gives no block.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import documents, scratch, shared_dir, slots, written
from .text import buffers, mix64
from .tokens import Encoder, encoded

END_ID = 2
MAGIC, VERSION = b"LWTB", 1
HEADER = struct.Struct("<4sIQQQI")
#: Ids that a block holds at most, unless one document has more; documents are never split.
BLOCK_IDS = 1 << 20
#: Encoded bytes that a file holds, about.
FILE_BYTES = 64 << 20
NO_ID = -(2**63)
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def encode(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Control and data bytes of the documents' ranks, and where each document's bytes end in both. Each starts a new control byte."""
    quads = -(-counts // 4)
    at = np.repeat(np.cumsum(quads) * 4 - quads * 4 - (np.cumsum(counts) - counts), counts) + np.arange(len(ranks))
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(int(quads.sum()) * 4, np.uint8)
    codes[at] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(counts)]
    return control.tobytes(), data.tobytes(), np.cumsum(quads), ends


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents, end to end."""
    quads = -(-counts // 4)
    at = np.repeat(np.cumsum(quads) * 4 - quads * 4 - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[at]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(doc_ids: np.ndarray, counts: np.ndarray, control: bytes, data: bytes) -> bytes:
    body = doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + control + data
    return HEADER.pack(MAGIC, VERSION, len(counts), len(control), len(data), zlib.crc32(body)) + body


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids per document, ranks; a damaged block raises."""
    magic, version, n, n_control, n_data, crc = HEADER.unpack_from(block)
    if magic != MAGIC or version != VERSION or len(block) != HEADER.size + 16 * n + n_control + n_data or zlib.crc32(block[HEADER.size :]) != crc:
        raise ValueError("not a whole token block")
    at = HEADER.size
    doc_ids = np.frombuffer(block, "<i8", n, at)
    counts = np.frombuffer(block, "<u8", n, at + 8 * n).astype(np.int64)
    at += 16 * n
    return doc_ids, counts, decode(block[at : at + n_control], block[at + n_control :], counts)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Per document its ids, as little-endian bytes: two for each id if the vocabulary allows, else four."""
    kind = "<u2" if max(Encoder.at(tokenizer).size(), end_id + 1) <= 1 << 16 else "<u4"

    def tokens(batches):
        for batch in batches:
            for first, ids, offsets in encoded(batch.column("text"), tokenizer, end_id):
                raw, cut = ids.astype(kind).tobytes(), (offsets * int(kind[2])).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(cut) - 1), pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], ["doc_id", "ids"])

    return documents(docs).mapInArrow(tokens, "doc_id long, ids binary")


def _groups(column, width: int, group: int = 1 << 20):
    """(first row, ids, ids of each row) for groups of rows of about `group` bytes."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + group, "right")) - 1))
        yield i, data[offsets[i] : offsets[j]].view(f"<u{width}"), np.diff(offsets[i : j + 1]) // width
        i = j


def ranking(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """All ids in the order of their frequency in the corpus (ties: the smaller id); size of the vocabulary in number."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, ids, _ in _groups(batch.column("ids"), width):
                total += np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})

    total = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        total[r["id"]] = r["n"]
    return np.lexsort([np.arange(size), -total]).astype(np.uint32)


def by_file(batch: pa.RecordBatch):
    """Its rows, a file at a time."""
    file = batch.column("file").to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if len(file) else np.empty(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(file)]):
        yield batch.slice(a, b - a)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """The corpus in ascending doc_id as token blocks under path/blocks, the ids by rank under path/ranks."""
    spark = docs.sparkSession
    size = max(Encoder.at(tokenizer).size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    tokens = written(tokenized(docs, tokenizer, end_id), "ids")
    by_rank = ranking(tokens, size, width)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/ranks")
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    n_bytes = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    files = max(1, -(-n_bytes // FILE_BYTES), min(slots(spark), n_bytes // (FILE_BYTES // 16)))
    # files by quantiles of the ids: cheaper than a range partitioning, which would encode all rows twice
    cuts = tokens.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(NO_ID)), [k / files for k in range(1, files)], 20 * files)).first()[0] if files > 1 else []
    edges = spark.sparkContext.broadcast(np.array(cuts or [], np.int64))

    def coded(batches):
        row = 0
        for batch in batches:
            for first, ids, counts in _groups(batch.column("ids"), width):
                control, data, c, d = encode(ranks.value[ids], counts)
                c, d = [0, *c.tolist()], [0, *d.tolist()]
                names = batch.column("doc_id").slice(first, len(counts))
                key = np.asarray(names.fill_null(NO_ID))
                low, high = (np.searchsorted(edges.value, key, side) for side in ("left", "right"))
                # an id that fills several files is dealt over them by the row's place, which a repeated task finds again
                deal = mix64(np.arange(row, row + len(key), dtype=np.uint64)) % (high - low + 1).astype(np.uint64)
                row += len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((low + deal.astype(np.int64)).astype(np.int32)), names, pa.array(counts), pa.array([control[a:b] for a, b in zip(c, c[1:])], pa.binary()), pa.array([data[a:b] for a, b in zip(d, d[1:])], pa.binary())],
                    ["file", "doc_id", "n", "control", "data"],
                )

    rows = tokens.mapInArrow(coded, "file int, doc_id long, n long, control binary, data binary")
    ordered = rows.repartition(files, "file").sortWithinPartitions("file", "doc_id", "n", "data")

    def assemble(batches):
        number, held, ids, file = 0, [], 0, -1

        def flush():
            t = pa.Table.from_batches(held)
            counts = t.column("n").to_numpy()
            names = t.column("doc_id").fill_null(NO_ID).to_numpy()
            block = block_bytes(names, counts, b"".join(t.column("control").to_pylist()), b"".join(t.column("data").to_pylist()))
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "block": pa.array([number], pa.int32()), "ids": pa.array([int(counts.sum())], pa.int64()), "data": pa.array([block], pa.binary())})

        for batch in (part for whole in batches for part in by_file(whole)):
            if batch.column("file")[0].as_py() != file:
                if held:
                    yield flush()
                number, held, ids, file = 0, [], 0, batch.column("file")[0].as_py()
            ends = np.cumsum(batch.column("n").to_numpy())
            i = 0
            while i < len(batch):
                gone = int(ends[i - 1]) if i else 0
                j = int(np.searchsorted(ends, gone + BLOCK_IDS - ids, "right"))
                if j <= i and not held:
                    j = i + 1
                if j > i:
                    held.append(batch.slice(i, j - i))
                    ids += int(ends[j - 1]) - gone
                    i = j
                if i < len(batch):
                    yield flush()
                    number, held, ids = number + 1, [], 0
        if held:
            yield flush()

    ordered.mapInArrow(assemble, "file int, block int, ids long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """Per document of the files at path: doc_id, ids of all documents before it, its ids' number and crc32 (DECODED)."""
    raw = spark.read.parquet(f"{path}/ranks").first()["ids"]
    ranks = spark.sparkContext.broadcast(np.frombuffer(bytes(raw), "<u4"))
    blocks = spark.read.schema("file int, block int, ids long, data binary").parquet(f"{path}/blocks")

    def per_document(batches):
        for batch in batches:
            for file, number, block in zip(batch.column("file"), batch.column("block"), batch.column("data")):
                names, counts, coded = read_block(block.as_py())
                ids = memoryview(ranks.value[coded].tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(file.as_py(), pa.int32()), len(counts)), pa.repeat(pa.scalar(number.as_py(), pa.int32()), len(counts)), pa.array(names, mask=names == NO_ID), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["file", "block", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = blocks.select("file", "block", "data").mapInArrow(per_document, "file int, block int, " + DECODED)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.select("file", "block", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("within"))
    totals = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("ids").alias("n")).collect()}  # a row for each file
    first, running = [], 0
    for file in sorted(totals):
        first.append((file, running))
        running += totals[file]
    starts = within.join(spark.createDataFrame(first, "file int, first long"), "file").select("file", "block", (F.col("within") + F.col("first")).alias("base"))
    return rows.join(starts, ["file", "block"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def export(spark, path: str, target: str) -> int:
    """All blocks of path, in order and each after its 8-byte length, in one local file; returns their number."""
    n = 0
    with open(target, "wb") as out:
        for row in spark.read.parquet(f"{path}/blocks").orderBy("file", "block").select("data").toLocalIterator():
            out.write(struct.pack("<Q", len(row["data"])) + bytes(row["data"]))
            n += 1
    return n


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to a fresh place in the shared folder and reads them back (DECODED)."""
    path = f"{shared_dir(docs.sparkSession)}/lagweave-tokens-{uuid.uuid4().hex}"
    with scratch(docs.sparkSession):
        write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path)
