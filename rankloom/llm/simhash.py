"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set if over half of its hashed 4-word shingles have it set. Fingerprints that differ in at
most ``DISTANCE`` = 4 bits are linked. Cut into three segments, two such fingerprints have a segment that differs in one bit
at most; so each fingerprint is filed under every variant of its segments with one bit struck out (64 variants), and linked
fingerprints meet under a variant. Members of one variant are joined by equality and verified by counting differing bits; of
the variants that two share, the first one reports their link.

A variant with more than ``crowd`` members is not paired out. First its members are checked against a few hubs; where that
makes them one component, nothing is left to find. Otherwise it is cut again: the bits in which its members differ at all
form five segments, linked members agree in one of these, and every value of a segment is a smaller group. Each cut uses up
bits, and fingerprints that differ in five bits only are no crowd, so cuts come to an end by themselves: no link that could
join two components is lost, no crowd is paired out and none is gathered in one task.

Defined results: null, empty and blank texts have fingerprint 0, which is linked like any other; texts of one to three words
are one shingle; equal fingerprints are one node; a component is named by its smallest document id, null ids aside (null if
it has no other); rows that share a document id are judged by their texts; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, components, dropped, small_batches, staged, text_of
from rankloom.session import configure

SHINGLE, SEED, DISTANCE = 4, 42, 4
CROWD = 512  # up to so many members, comparing all costs less than filing each of them again under five segments
SLICE = 1 << 18  # bytes of a text that are cut into words at once
BLANK = re.compile(rb"[\x20\x09-\x0d]")
ONE = np.uint64(1)


def slices(data: bytes):
    """Parts of a text that end at blanks."""
    begin = 0
    while begin < len(data):
        blank = BLANK.search(data, min(begin + SLICE, len(data)))
        end = blank.start() if blank else len(data)
        yield data[begin:end]
        begin = end


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The 64 bits that most shingles have; a text is read slice by slice, with the last words carried over."""
    hashed = xxhash.xxh64_intdigest
    counts, total, carried = np.zeros(64, np.int64), 0, []
    for part in slices(data):
        words = carried + part.lower().split()
        if len(words) >= size:
            ends = list(accumulate(len(w) + 1 for w in words))
            joined = b" ".join(words)
            spans = zip([0, *ends], ends[size - 1 :])
            found = np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in spans), np.uint64, len(words) - size + 1)
            counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(found)
        carried = words[1 - size :] if size > 1 else []
    if not total:
        return hashed(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the 64 bits as a signed number) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        return {"doc_id": batch.column(0), "print": found.view(np.int64)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(by_batch(work, schema), "doc_id bigint, print bigint")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def cut(free: np.ndarray, segments: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each bit the segment it belongs to in each row, and the mask of each segment; a row's free bits are dealt evenly."""
    rank, at = np.zeros(len(free), np.uint64), []
    for p in range(64):  # how many free bits stand below each position
        at.append(rank.copy())
        rank += (free >> np.uint64(p)) & ONE
    total = np.maximum(rank, ONE)
    segment_of = [a * np.uint64(segments) // total for a in at]
    masks = np.zeros((segments, len(free)), np.uint64)
    for p in range(64):
        for s in range(segments):
            masks[s] |= np.where(segment_of[p] == s, free & (ONE << np.uint64(p)), np.uint64(0))
    return segment_of, masks


def struck(prints: np.ndarray, segments: int):
    """Row, key and struck bit of every segment variant with one bit struck out.

    Fingerprints that differ in fewer than ``2 * segments`` bits have a segment with one difference at most.
    """
    rows = np.arange(len(prints))
    segment_of, masks = cut(np.full(1, (1 << 64) - 1, np.uint64), segments)
    for p in range(64):
        kept = masks[int(segment_of[p][0]), 0] & ~(ONE << np.uint64(p))
        spot = np.full(len(prints), p, np.uint64)
        yield rows, mixed((prints & kept) ^ mixed(spot + ONE)), spot


def agreed(prints: np.ndarray, key: np.ndarray, free: np.ndarray, spot: np.ndarray, segments: int):
    """Row, key and struck bit of every segment of the free bits: one of ``segments`` agrees if fewer bits differ."""
    rows = np.arange(len(prints))
    for s, mask in enumerate(cut(free, segments)[1]):
        yield rows, mixed(mixed(key + np.uint64(s + 1)) ^ (prints & mask)), spot


def filed(members: DataFrame, work: Callable) -> DataFrame:
    """key, print, spot: ``work`` gives rows, keys and struck bits of the members."""
    schema = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("spot", pa.int8())])

    def run(batch: pa.RecordBatch) -> dict:
        columns = [np.asarray(c).view(np.uint64) for c in batch.columns]
        rows, keys, spots = (np.concatenate(part) for part in zip(*work(*columns)))
        return {"key": keys.view(np.int64), "print": columns[0][rows].view(np.int64), "spot": spots.astype(np.int8)}

    return members.mapInArrow(by_batch(run, schema), "key bigint, print bigint, spot tinyint")


def near(distance: int):
    return F.bit_count(F.col("hub").bitwiseXOR(F.col("node"))) <= distance


def first_spot(segments: int):
    """The first variant that ``hub`` and ``node`` share: the differing bit of a segment with one, or its first bit."""
    deal = [int(s[0]) for s in cut(np.full(1, (1 << 64) - 1, np.uint64), segments)[0]]
    out = F.lit(-1)
    for s in reversed(range(segments)):
        begin, size = deal.index(s), deal.count(s)
        part = F.shiftrightunsigned(F.col("hub").bitwiseXOR(F.col("node")), begin).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
        at = F.when(part == 0, begin).otherwise(F.bit_count(part - 1) + begin)
        out = F.when(F.bit_count(part) <= 1, at).otherwise(out)
    return out


def links(
    spark: SparkSession, prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD
) -> DataFrame:
    """hub, node of pairs of different ``print``: all links outside crowds, and as many in crowds as join their components."""
    segments = distance // 2 + 1
    if crowd < 2 ** (distance + 1):  # more members than that differ in more bits than there are segments to cut
        raise ValueError(f"a crowd has more than {2 ** (distance + 1)} members")
    rows = filed(prints.select("print"), lambda p: struck(p, segments))
    found = None
    while True:
        rows = staged(spark, rows, "filed")
        crowds = staged(
            spark, rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "crowds"
        )
        crowded = not crowds.isEmpty()
        few = rows.join(crowds, "key", "left_anti") if crowded else rows
        pairs = few.select("key", "spot", F.col("print").alias("hub")).join(
            few.select("key", F.col("print").alias("node")), "key"
        ).where((F.col("hub") < F.col("node")) & near(distance) & (F.col("spot") == first_spot(segments)))
        fresh = staged(spark, pairs.select("hub", "node").distinct(), "links")
        found = fresh if found is None else found.union(fresh)
        if not crowded:
            dropped(spark, rows, crowds)
            return found
        many = staged(spark, rows.join(crowds, "key"), "many")
        dropped(spark, rows, crowds)
        found = found.union(staged(spark, hub_links(spark, many, distance), "links"))
        known = components(spark, found).select(F.col("node").alias("print"), "root")
        rooted = staged(
            spark, many.join(known, "print", "left").select("key", "print", "spot", F.coalesce("root", "print").alias("root")), "rooted"
        )
        per_key = rooted.groupBy("key").agg(
            F.min("root").alias("a"), F.max("root").alias("b"), F.bit_or("print").alias("any"), F.bit_and("print").alias("all")
        )
        opened = staged(
            spark, per_key.where("a <> b").select("key", F.col("any").bitwiseXOR(F.col("all")).alias("free")), "opened"
        )
        members = rooted.join(opened, "key").select("print", "key", "free", F.col("spot").cast("bigint").alias("spot"))
        members = staged(spark, members, "members")
        dropped(spark, many, rooted, opened)
        rows = filed(members, lambda p, key, free, spot: agreed(p, key, free, spot, distance + 1))


def hub_links(spark: SparkSession, members: DataFrame, distance: int) -> DataFrame:
    """Links of the members of each crowd to four of its fingerprints: the one in most crowds, and three by hash."""
    weights = members.groupBy("print").agg(F.count(F.lit(1)).alias("weight"))
    orders = [F.struct(F.xxhash64(F.lit(k), "print").alias("order"), "print") for k in range(3)]
    picked = members.join(weights, "print").groupBy("key").agg(
        F.max(F.struct("weight", "print"))["print"].alias("h0"), *[F.min(o)["print"].alias(f"h{k + 1}") for k, o in enumerate(orders)]
    )
    hubs = staged(spark, picked.select("key", F.explode(F.array_distinct(F.array("h0", "h1", "h2", "h3"))).alias("a")), "hubs")
    met = members.select("key", F.col("print").alias("b")).join(hubs, "key").where("a <> b")
    return met.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("node")).where(near(distance)).distinct()


def component_ids(
    spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, crowd: int = CROWD
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    configure(spark)
    small_batches(spark)
    rows = staged(spark, fingerprints(docs), "fingerprints")
    nodes = staged(spark, rows.groupBy("print").agg(F.min("doc_id").alias("first_doc")), "nodes")
    roots = components(spark, links(spark, nodes, distance, crowd))
    named = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = staged(spark, named, "named")
    heads = staged(spark, named.groupBy("root").agg(F.min("first_doc").alias("component_id")), "heads")
    by_print = staged(spark, named.join(heads, "root").select("print", "component_id"), "by_print")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(by_print, "print").select("doc_id", hexed, "component_id")
