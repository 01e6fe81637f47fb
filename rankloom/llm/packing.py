"""Token files: ids in the fewest bits that the vocabulary needs, in blocks that numpy unpacks at once.

``write`` puts documents in the order of their ids with one range shuffle, encodes them where they land and writes blocks
through Spark's own writer, so a lost executor costs its tasks only and any store that Spark reaches will do. A block holds
up to ``block_ids`` ids (one long document may hold more), packed back to back with ``width`` bits each, least significant
bit first, behind this head of little-endian integers:

    magic 'RLT1' | width u32 | documents u32 | ids u64 | per document: its id i64, its first id's place in the block u64

Id number ``k`` of a block begins at bit ``k * width``, so any document or id range is read alone. A block's row carries
its file part, its number and how many ids of the part stand before it; the ids of all earlier parts are summed over the
parts, of which there are as many as shuffle partitions.

Defined results: a null or empty text is the end id alone; rows with the same document id keep an order by text; a null
document id comes first and reads back as null; an empty table gives no blocks and no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, small_batches, text_of
from rankloom.llm.library import ids_of, whole_library
from rankloom.session import shared_folder

MAGIC = int.from_bytes(b"RLT1", "little")
HEAD = np.dtype([("magic", "<u4"), ("width", "<u4"), ("docs", "<u4"), ("ids", "<u8")])
ENTRY = np.dtype([("doc", "<i8"), ("start", "<u8")])
NO_ID = np.iinfo(np.int64).min


def width_of(vocabulary: int) -> int:
    """Bits that every id below ``vocabulary`` fits into."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids back to back, ``width`` bits each."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from number ``first`` on."""
    if count == 0:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    begin, end = first * width, (first + count) * width
    raw = np.frombuffer(data, np.uint8)[begin // 8 : (end + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[begin % 8 :][: count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def block_bytes(docs: list[int | None], arrays: list[np.ndarray], width: int) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.uint64)
    head = np.array([(MAGIC, width, len(docs), int(sizes.sum()))], HEAD)
    entries = np.zeros(len(docs), ENTRY)
    entries["doc"] = [NO_ID if d is None else d for d in docs]
    entries["start"] = np.cumsum(sizes) - sizes
    return head.tobytes() + entries.tobytes() + pack(np.concatenate(arrays), width)


@dataclass
class Block:
    """A block's head and entries; ids are unpacked on demand."""

    data: bytes

    def __post_init__(self):
        head = np.frombuffer(self.data, HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a block of token ids")
        self.width, self.ids = int(head["width"]), int(head["ids"])
        self.entries = np.frombuffer(self.data, ENTRY, int(head["docs"]), HEAD.itemsize)
        self.body = memoryview(self.data)[HEAD.itemsize + self.entries.nbytes :]
        self.ends = np.append(self.entries["start"][1:], np.uint64(self.ids)).astype(np.int64)

    def document(self, k: int) -> np.ndarray:
        start = int(self.entries["start"][k])
        return unpack(self.body, self.width, start, int(self.ends[k]) - start)

    def all(self) -> np.ndarray:
        return unpack(self.body, self.width, 0, self.ids)


@dataclass
class TokenFiles:
    """Written blocks: ``blocks`` (part, block, first_doc, last_doc, n_ids, before, data) under ``path``."""

    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(self.path)

    def part_starts(self) -> DataFrame:
        """Ids before each part: a row per part, of which there are as many as the writing shuffle had partitions."""
        sums = self.blocks().groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
        out, before = [], 0
        for row in sorted(sums):
            out.append((row["part"], before))
            before += row["n"]
        return self.spark.createDataFrame(out, "part int, part_start bigint")

    def lookup(self, low: int, high: int) -> DataFrame:
        """Blocks that can hold documents ``low`` to ``high``: the scan skips files by their statistics."""
        return self.blocks().where((F.col("last_doc") >= low) & (F.col("first_doc") <= high))


BLOCKS = "part int, block int, first_doc bigint, last_doc bigint, n_ids bigint, before bigint, data binary"


def write(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    block_ids: int = 1 << 18,
    width: int | None = None,
    path: str | None = None,
    id_col: str = "doc_id",
) -> TokenFiles:
    """Encodes every text, appends ``end_id`` and writes the blocks in ascending order of ``id_col``."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc"), text_of().alias("text"))
        .repartitionByRange(parts, "doc")
        .sortWithinPartitions("doc", "text")
        .withColumn("part", F.spark_partition_id())
    )
    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32())]
        + [(n, pa.int64()) for n in ("first_doc", "last_doc", "n_ids", "before")]
        + [("data", pa.binary())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = width or width_of(whole_library(tokenizer_path).get_vocab_size(with_added_tokens=True))
        names, arrays, held, block, before, part = [], [], 0, 0, 0, 0

        def closed() -> pa.RecordBatch:
            known = [n for n in names if n is not None]
            row = [part, block, min(known, default=None), max(known, default=None), held, before, block_bytes(names, arrays, bits)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, text, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = ids_of(tokenizer_path, text)
                ids.append(end_id)
                if held and held + len(ids) > block_ids:
                    yield closed()
                    before += held
                    names, arrays, held, block = [], [], 0, block + 1
                names.append(doc)
                arrays.append(np.array(ids, np.uint32))
                held += len(ids)
        if held:
            yield closed()

    ordered.mapInArrow(run, BLOCKS).write.parquet(path)
    return TokenFiles(spark, path)


def digests(files: TokenFiles) -> DataFrame:
    """Reads every block back: doc_id, start, n_tokens, ids_crc32 of each document."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        for part, before, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            block = Block(data)
            ids = block.all()
            for name, start, end in zip(block.entries["doc"].tolist(), block.entries["start"].tolist(), block.ends.tolist()):
                out["part"].append(part)
                out["doc_id"].append(None if name == NO_ID else name)
                out["local"].append(before + start)
                out["n_tokens"].append(end - start)
                out["ids_crc32"].append(zlib.crc32(ids[start:end].astype("<u4").tobytes()))
        return out

    read = files.blocks().select("part", "before", "data")
    found = read.mapInArrow(by_batch(work, schema), "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(files.part_starts(), "part").select(
        "doc_id", (F.col("part_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
