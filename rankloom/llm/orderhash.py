"""Near-duplicate documents by order MinHash, verified by banded alignment.

Two texts are linked if they can be aligned word by word with a similarity ``1 - distance / (words of both)`` of ``least``
or more, insertions and deletions counted. Classes are the connected components of the links. Nothing but the alignment
decides; sketches only find candidates.

A text's k-mers are its pairs of neighbouring words, each labelled with its occurrence. A sketch takes the ``picks``
smallest of them under one hash order and keeps them in text order, so it depends on the order of the text and not only on
its set of k-mers. Two texts with k-mer similarity ``s`` agree in one sketch with probability about ``s ** picks``, in one
of ``bands`` with ``1 - (1 - s ** picks) ** bands``. If every tenth word is another one (alignment 0.9), ``s`` is 0.68 and
4 picks in 48 bands find the pair with 0.99999; at every fifth word (alignment 0.8, the least that is linked) ``s`` is 0.47
and they find it with 0.91. Longer k-mers lose far more: five-word ones keep a third of themselves there. Pairs with a text
of at most ``SHORT`` k-mers are found for certain, by a prefix filter: an alignment of that similarity leaves a third of a
text's word pairs whole, so of its k-mers in an order that all texts share, the first two thirds hold a common one and are
buckets too. The order is by the number of texts that hold a k-mer, so that a common line is no bucket of texts that only
have this line in common.

Texts that share a sketch are a bucket; equal buckets are one. A bucket is not paired out. Its heaviest member, the hub, is
aligned with the others, and buckets whose members are now of one class are done. In the others every member stands for
the heaviest hub that it is linked with, its pivot, or for itself. Pivots of different classes in a bucket are aligned. As
the distance is a metric, members ``a`` and ``b`` with pivots ``p`` and ``q`` can only be linked if
``d(p, q) - d(a, p) - d(b, q)`` is within the reach of the two; those for which it is are aligned with the other pivot, and
only pairs that both of these distances leave open are aligned themselves. Before any of these pairs becomes a row, the
parities of its texts' word counts are compared: an inserted or deleted word flips one, so as many operations are needed at
least as parities differ, and a pair that the parities put out of reach is none. No link inside a bucket is lost that could join
two classes. Texts that are near each other without any link are all pivots, so a group of these is compared pair by pair
as far as its texts share sketches and their parities leave a link open. Equal texts are one node from the start.

Defined results: null and empty texts are equal texts; other texts without a word have no k-mer and link to none; texts of
one word have it as only k-mer; equal rows share a class; a class is named by its smallest document id, null ids aside;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, components, small_batches, staged, text_of

K, PICKS, BANDS, LEAST = 2, 4, 48, 0.8
MIX = np.random.default_rng(20_240_501).integers(1, 1 << 63, size=(4, 256), dtype=np.uint64) | np.uint64(1)
BLOCK = 1 << 14
PARITIES = 4096  # a multiple of ``64 * FEW``
FEW = 16  # the parities are folded to so many integers for a first look
SHORT = 30  # k-mers of texts whose links are found by prefixes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words, for as many words as a worker should remember."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


HASHES = WordHashes()


def by_occurrence(codes: np.ndarray) -> np.ndarray:
    """The codes, those that come again changed by how often they came before."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return codes
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    count = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
    times = np.empty(len(codes), np.uint64)
    times[order] = count.astype(np.uint64)
    return np.where(times > 0, mixed(codes + times * MIX[1, 0]), codes)


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hashes of a text's k-mers in text order, each with its occurrence."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    k = min(k, len(codes))
    out = np.full(len(codes) - k + 1, k, np.uint64)
    for j in range(k):
        out = mixed(out * MIX[0, j] + codes[j : len(codes) - k + 1 + j])
    return by_occurrence(out)


def parities(text: str) -> np.ndarray:
    """Whether the words of each of ``PARITIES`` classes are odd in number, as bits of 64-bit integers.

    A word and its second occurrence are of different classes, so that a word that one text has four times and the other
    twice counts as two.
    """
    words = text.split()
    codes = by_occurrence(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))) % np.uint64(PARITIES)
    return np.packbits(np.bincount(codes.astype(np.int64), minlength=PARITIES) & 1).view(np.int64)


def folded(odd: np.ndarray) -> np.ndarray:
    """Parities of classes that are put together, in ``FEW`` integers."""
    return np.bitwise_xor.reduce(odd.reshape(-1, FEW), axis=0)


def in_reach(one: str, two: str, limit: Column) -> Column:
    """Whether two texts may be as near as ``limit``: their distance is no less than the parities in which they differ."""
    few = F.expr(" + ".join(f"bit_count({one}.few[{k}] ^ {two}.few[{k}])" for k in range(FEW)))
    differing = F.zip_with(f"{one}.many", f"{two}.many", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    many = F.aggregate(differing, F.lit(0), lambda total, n: total + n)
    return (limit >= few) & (limit >= many)


def smallest(value: np.ndarray, picks: int) -> np.ndarray:
    """Places of the ``picks`` smallest values of each row. Of hashes, few are below a small limit, so only those are sorted."""
    n = value.shape[1]
    if n > 16 * picks:
        rows, places = np.divmod(np.flatnonzero(value.ravel() < np.uint64(int(2**64 * (5 * picks / n)))), n)
        counts = np.bincount(rows, minlength=len(value))
        if counts.min() >= picks:
            order = np.lexsort((value[rows, places], rows))
            return places[order][(np.cumsum(counts) - counts)[:, None] + np.arange(picks)]
    return np.argpartition(value, picks - 1, axis=1)[:, :picks]


def sketches(codes: np.ndarray, picks: int = PICKS, bands: int = BANDS) -> list[int]:
    """One hash per band of the ``picks`` smallest k-mers in text order."""
    if not len(codes):
        return []
    rows = np.arange(bands)[:, None]
    held = np.zeros((bands, 0), np.int64)
    for begin in range(0, len(codes), BLOCK):
        end = min(begin + BLOCK, len(codes))
        place = np.concatenate([held, np.broadcast_to(np.arange(begin, end), (bands, end - begin))], axis=1)
        value = (codes[place] if begin else codes[:end]) * MIX[2, :bands, None] + MIX[3, :bands, None]
        if place.shape[1] > picks:
            held = place[rows, smallest(value, picks)]
        else:
            held = place
    taken = codes[np.sort(held, axis=1)]
    out = np.arange(bands, dtype=np.uint64) * MIX[1, 1]
    for j in range(taken.shape[1]):
        out = mixed(out * MIX[1, 2] + taken[:, j])
    return out.view(np.int64).tolist()


def banded_distance(a: list[str], b: list[str], limit: int) -> int | None:
    """Insertions and deletions between word lists, or None beyond ``limit``.

    The longest common subsequence is grown for one word of ``b`` at a time, for all words of ``a`` at once as bits of one
    number; matches farther than ``limit`` from the diagonal are left out, as no alignment within it can use them.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    band = (1 << 2 * limit + 1) - 1 if 2 * limit < len(a) + len(b) else None
    unmatched = full
    for j, word in enumerate(b):
        met = places.get(word, 0)
        if met and band is not None:
            met &= band << j - limit if j > limit else band >> limit - j
        if met:
            u = unmatched & met
            unmatched = (unmatched + u | unmatched - u) & full
    distance = len(b) - len(a) + 2 * unmatched.bit_count()
    return distance if distance <= limit else None


def compared(a: str, b: str, least: float = LEAST) -> tuple[int, bool]:
    """Distance of two texts, as far as three times the one that links them, and whether they are linked."""
    x, y = a.split(), b.split()
    reach = int((1 - least) * (len(x) + len(y)) + 1e-9)
    found = banded_distance(x, y, 3 * reach)
    return 3 * reach + 1 if found is None else found, found is not None and found <= reach


def short_codes(text: str, codes: np.ndarray, longest: int) -> list[int]:
    """The k-mers that a prefix is taken from. Without its middle word a text of three words has none of its pairs left."""
    words = text.split()
    if len(codes) > longest:
        return []
    ends = kmers(f"{words[0]} {words[2]}") if len(words) == 3 else codes[:0]
    return sorted({*codes.view(np.int64).tolist(), *ends.view(np.int64).tolist()})


def sketched(docs: DataFrame, picks: int = PICKS, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """doc_id, key of the text, words, sketches, and the k-mers of texts that can be linked to one of ``SHORT`` k-mers."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("key", pa.binary()),
            ("words", pa.int64()),
            ("sketch", pa.list_(pa.int64())),
            ("short", pa.list_(pa.int64())),
        ]
    )
    longest = int((SHORT + 1) * (2 - least) / least + 1e-9)

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column(2).to_pylist()
        found = [kmers(t) for t in texts]
        return {
            "doc_id": batch.column(0),
            "key": batch.column(1),
            "words": [len(t.split()) for t in texts],
            "sketch": [sketches(codes, picks, bands) for codes in found],
            "short": [short_codes(t, codes, longest) for t, codes in zip(texts, found)],
        }

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"), text_of().alias("text"))
    return rows.mapInArrow(
        by_batch(work, schema), "doc_id bigint, key binary, words bigint, sketch array<bigint>, short array<bigint>"
    )


def prefixes(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """node, bucket: the prefix of each short text, rarest k-mers first, as far as other texts have them."""
    rows = nodes.select("node", F.size("short").alias("n"), F.explode("short").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    by_node = Window.partitionBy("node")
    # K-mers of one text only come first in the order, and are no buckets.
    placed = rows.join(shared, "bucket").select(
        "node",
        "bucket",
        "n",
        (F.col("n") - F.count(F.lit(1)).over(by_node) + F.row_number().over(by_node.orderBy("texts", "bucket"))).alias("place"),
    )
    # Of n words in pairs, x deletions and y insertions leave n - 1 - 2x - y pairs: so many at least, whatever the other text.
    common = F.ceil((F.col("n") + 1) * ((3 * least - 2) / (2 - least)) - 1 - 1e-9)
    return placed.where(F.col("place") <= F.col("n") - F.greatest(common, F.lit(1)) + 1).select("node", "bucket")


def text_key():
    return F.unhex(F.md5(text_of().cast("binary")))


def texts_of(spark: SparkSession, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes asked for."""
    rows = docs.select(text_key().alias("key"), text_of().alias("text"))
    return staged(spark, rows.join(nodes, "key").groupBy("node").agg(F.any_value("text").alias("text")), "texts")


def parities_of(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """node, odd: the parities of each text, all of them (many) and folded (few)."""
    schema = pa.schema([("node", pa.int64()), ("few", pa.list_(pa.int64())), ("many", pa.list_(pa.int64()))])

    def work(batch: pa.RecordBatch) -> dict:
        found = [parities(t) for t in batch.column(1).to_pylist()]
        return {"node": batch.column(0), "few": [folded(x) for x in found], "many": found}

    rows = texts.select("node", "text").mapInArrow(by_batch(work, schema), "node bigint, few array<bigint>, many array<bigint>")
    return staged(spark, rows.select("node", F.struct("few", "many").alias("odd")), "parities")


def verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """low, high, distance, linked of each pair of nodes, written."""
    pairs = staged(spark, pairs.select("low", "high").distinct(), "pairs")
    both = pairs.join(texts.select(F.col("node").alias("low"), F.col("text").alias("a")), "low").join(
        texts.select(F.col("node").alias("high"), F.col("text").alias("b")), "high"
    )
    schema = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("distance", pa.int64()), ("linked", pa.bool_())])

    def work(batch: pa.RecordBatch) -> dict:
        found = [compared(a, b, least) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return {"low": batch.column(0), "high": batch.column(1), "distance": [d for d, _ in found], "linked": [x for _, x in found]}

    judged = both.select("low", "high", "a", "b").mapInArrow(
        by_batch(work, schema), "low bigint, high bigint, distance bigint, linked boolean"
    )
    return staged(spark, judged, "judged")


def in_order(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def distinct_buckets(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """bucket, node, n, times of the buckets with several members; of buckets with the same members, one that counts for all."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    alike = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), *marks)
        .where("n > 1")
        .groupBy("n", "mark0", "mark1")
        .agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    )
    return staged(spark, rows.join(alike.select("bucket", "n", "times"), "bucket"), "shared")


def rooted(spark: SparkSession, members: DataFrame, judged: DataFrame) -> DataFrame:
    """Members with the root of their component, of buckets that still hold several components."""
    roots = components(spark, judged.where("linked").select(F.col("low").alias("hub"), F.col("high").alias("node")))
    named = staged(
        spark, members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted"
    )
    mixed = named.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    return staged(spark, named.join(mixed, "bucket"), "mixed")


def class_roots(
    spark: SparkSession, docs: DataFrame, nodes: DataFrame, least: float = LEAST, exact: DataFrame | None = None
) -> DataFrame:
    """node, root of the nodes that have a link: components of the verified links. ``exact`` are more buckets."""
    rows = nodes.select("node", F.explode("sketch").alias("bucket"))
    if exact is not None:
        rows = rows.union(exact.select("node", "bucket"))
    sized = distinct_buckets(spark, rows)
    # The node that shares most sketches is the best hub: of a text and its varied copies it is the text.
    weights = staged(spark, sized.groupBy("node").agg(F.sum((F.col("n") - 1) * F.col("times")).alias("weight")), "weights")
    members = staged(
        spark, sized.select("bucket", "node").join(weights, "node").join(nodes.select("node", "words"), "node"), "members"
    )
    texts = texts_of(spark, docs, nodes.select("node", "key").join(weights.select("node"), "node"))

    # Members against the hub of their bucket.
    hubs = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("h"))
    hubs = hubs.select("bucket", (-F.col("h.minus")).alias("hub"))
    star = verified(spark, members.join(hubs, "bucket").where("node <> hub").select(*in_order("node", "hub")), texts, least)
    links = star.where("linked")
    ends = links.select(F.col("low").alias("node"), F.col("high").alias("pivot"), "distance").union(
        links.select("high", "low", "distance")
    )
    heavier = "pivot_weight > weight or (pivot_weight = weight and pivot < node)"
    pivots = (
        ends.join(weights, "node")
        .join(weights.select(F.col("node").alias("pivot"), F.col("weight").alias("pivot_weight")), "pivot")
        .where(heavier)
        .groupBy("node")
        .agg(F.max(F.struct("pivot_weight", (-F.col("pivot")).alias("minus"), "distance")).alias("p"))
        .select("node", (-F.col("p.minus")).alias("pivot"), F.col("p.distance").alias("radius"))
    )
    standing = members.join(pivots, "node", "left").select(
        "bucket", "node", "words", F.coalesce("pivot", "node").alias("pivot"), F.coalesce("radius", F.lit(0)).alias("radius")
    )
    mixed = rooted(spark, standing, star)
    odd = parities_of(spark, texts)

    # Pivots of different components in one bucket; ``slack`` is how near to another pivot a member's links may bring it.
    reach = F.col("words") * (1 - least) + 1e-6
    slack = F.col("radius") + reach

    def pivot_pairs(mixed: DataFrame) -> DataFrame:
        groups = mixed.groupBy("bucket", "pivot").agg(F.max(slack).alias("slack"), F.any_value("root").alias("root"))
        groups = groups.join(odd.withColumnRenamed("node", "pivot"), "pivot")
        sides = [groups.select("bucket", *(F.col(c).alias(f"{c}{k}") for c in ("pivot", "slack", "root", "odd"))) for k in (1, 2)]
        return sides[0].join(sides[1], "bucket").where("pivot1 < pivot2 and root1 <> root2").where(
            in_reach("odd1", "odd2", F.col("slack1") + F.col("slack2"))
        )

    pairs = pivot_pairs(mixed).select(*in_order("pivot1", "pivot2")).distinct()
    judged = star.union(verified(spark, pairs.join(star, ["low", "high"], "left_anti"), texts, least))
    mixed = rooted(spark, mixed.drop("root"), judged)

    # Members against the other pivot, where the triangle inequality leaves a link open.
    near = pivot_pairs(mixed).withColumnsRenamed({"pivot1": "low", "pivot2": "high"}).join(judged, ["low", "high"])
    near = near.where(F.col("slack1") + F.col("slack2") >= F.col("distance"))
    near = staged(
        spark,
        near.select("bucket", F.col("low").alias("pivot"), F.col("high").alias("other"), F.col("slack2").alias("other_slack"), "distance", F.col("odd2").alias("other_odd")).union(
            near.select("bucket", F.col("high"), F.col("low"), F.col("slack1"), "distance", F.col("odd1"))
        ),
        "near",
    )
    facing = staged(
        spark,
        mixed.where("node <> pivot")
        .join(odd, "node")
        .join(near, ["bucket", "pivot"])
        .where(slack + F.col("other_slack") >= F.col("distance"))
        .where(in_reach("odd", "other_odd", reach + F.col("other_slack")))
        .where("node <> other")
        .select("node", "words", "pivot", "radius", "root", "other")
        .distinct(),
        "facing",
    )
    judged = judged.union(
        verified(spark, facing.select(*in_order("node", "other")).join(judged, ["low", "high"], "left_anti"), texts, least)
    )

    # Pairs of members that the distances from both pivots leave open.
    facing = facing.withColumns({"low": F.least("node", "other"), "high": F.greatest("node", "other")}).join(
        judged.select("low", "high", "distance"), ["low", "high"]
    ).join(odd, "node")
    columns = ("node", "words", "radius", "root", "distance", "odd")
    one = facing.select("pivot", "other", *(F.col(c).alias(f"{c}1") for c in columns))
    two = facing.select(
        F.col("other").alias("pivot"),
        F.col("pivot").alias("other"),
        *(F.col(c).alias(f"{c}2") for c in columns),
    )
    both = (F.col("words1") + F.col("words2")) * (1 - least) + 1e-6
    last = (
        one.join(two, ["pivot", "other"])
        .where("pivot < other and root1 <> root2")
        .where((F.col("distance1") - F.col("radius2") <= both) & (F.col("distance2") - F.col("radius1") <= both))
        .where(in_reach("odd1", "odd2", both))
        .select(*in_order("node1", "node2"))
    )
    judged = judged.union(verified(spark, last.join(judged, ["low", "high"], "left_anti"), texts, least))
    return components(spark, judged.where("linked").select(F.col("low").alias("hub"), F.col("high").alias("node")))


def classed(
    spark: SparkSession, docs: DataFrame, least: float, picks: int, bands: int
) -> tuple[DataFrame, DataFrame]:
    """The rows' ids and text keys, and the texts (key, first_doc) with their root."""
    small_batches(spark)
    raw = staged(spark, sketched(docs, picks, bands, least), "sketched")
    nodes = staged(
        spark,
        raw.groupBy("key")
        .agg(F.min("doc_id").alias("first_doc"), *(F.any_value(c).alias(c) for c in ("words", "sketch", "short")))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    exact = staged(spark, prefixes(nodes, least), "prefixes")
    roots = class_roots(spark, docs, nodes, least, exact)
    named = nodes.select("node", "key", "first_doc").join(roots, "node", "left")
    return raw.select("doc_id", "key"), named.select("key", "first_doc", F.coalesce("root", "node").alias("root"))


def classes(
    spark: SparkSession, docs: DataFrame, least: float = LEAST, picks: int = PICKS, bands: int = BANDS
) -> DataFrame:
    """doc_id, class_id, n_texts (different texts of the class) of every row."""
    rows, named = classed(spark, docs, least, picks, bands)
    heads = named.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    by_key = named.join(heads, "root").select("key", "class_id", "n_texts")
    return rows.join(by_key, "key").select("doc_id", "class_id", "n_texts")


def deduplicated(
    spark: SparkSession, docs: DataFrame, least: float = LEAST, picks: int = PICKS, bands: int = BANDS
) -> DataFrame:
    """One row of ``docs`` for each class, that of the smallest document id (null ids last), all columns kept."""
    _, named = classed(spark, docs, least, picks, bands)
    first = F.min(F.struct(F.col("first_doc").isNull().alias("unnamed"), "first_doc", "key")).alias("h")
    heads = named.groupBy("root").agg(first).select(F.col("h.key").alias("h_key"), F.col("h.first_doc").alias("h_doc"))
    columns = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), docs["doc_id"].cast("bigint").alias("h_doc"), text_key().alias("h_key"))
    met = rows.alias("r").join(
        heads.alias("h"), (F.col("r.h_key") == F.col("h.h_key")) & F.col("r.h_doc").eqNullSafe(F.col("h.h_doc"))
    ).select("r.row", "r.h_key", "r.h_doc")
    return met.dropDuplicates(["h_key", "h_doc"]).select("row.*")
