"""Exact removal of byte strings that occur again anywhere, by sorting a cover of the suffixes.

A difference-cover algorithm sorts a sample of suffixes that meets every pair of suffixes at a common distance, names them,
recurses on the names, places the remaining suffixes by their distance to the next sampled one, and compares neighbours.
Here only equality over the first ``length`` bytes matters, so the cover is chosen by content: of every string of
``length`` bytes it holds the start of the run of ``tuple_bytes`` bytes with the least hash (the leftmost of equals). Two
equal strings have it at the same distance, as with a difference cover, but it holds one suffix in a hundred instead of
two in three, and all copies of a string agree on it.

1. Sampled suffixes are named by their first ``tuple_bytes`` bytes. A name that occurs once is discarded, and all strings
   that belong to it: they cannot occur again.
2. The names are taken further: a block is the text of all strings that belong to one sampled suffix. Of equal blocks all
   strings repeat, and one of them stands for the rest. A name with one block only is finished.
3. What is left are different blocks of one name. They are cut at every ``STEP`` bytes of distance from the sampled suffix
   and named again, by the part that all strings of the cut share (if it occurs once, none repeats) and by the whole (if it
   occurs again, all repeat).
4. Only the strings of cuts that are neither are placed one by one, by name, distance and hash, and compared.

Every step is a count of equal keys with a combine before the shuffle; a key that many documents share is one row per task.

Defined results: null and empty texts have 0 bytes and keep the hash of nothing; texts shorter than ``length`` lose
nothing; equal rows lose everything if they are long enough; rows that share a document id are judged by their texts;
a null document id is kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, dropped, small_batches, staged, text_of

LENGTH, TUPLE, STEP = 400, 128, 16
SLICE = 1 << 17  # string starts that are worked on at once
PLACE = np.uint64((1 << 18) - 1)
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


UP, DOWN = powers(BASE, SLICE + 4096), powers(pow(BASE, -1, 1 << 64), SLICE + 4096)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes of any parts of some bytes, the same wherever the part stands."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * UP[: len(data)])))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * DOWN[begin])


def least_in_runs(values: np.ndarray, run: int) -> np.ndarray:
    """The least of every ``run`` neighbouring values."""
    short = (-len(values)) % run
    rows = np.concatenate((values, np.full(short, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, run)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - run + 1], ahead[run - 1 : len(values)])


def block_name(sums: Prefixes, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Name of the text of the strings that start from ``first`` to ``last``, and of where ``at`` stands in it."""
    place = (at - first).astype(np.uint64) << np.uint64(20) | (last - first).astype(np.uint64)
    return mixed(sums.of(first, last + length) + mixed(place))


def cover(data: np.ndarray, length: int, tuple_bytes: int):
    """For each sampled suffix: its place, the first and last start of its strings, its name, its block's name."""
    held = None
    for begin in range(0, len(data) - length + 1, SLICE):
        sums = Prefixes(data[begin : begin + SLICE + length - 1])
        starts = np.arange(len(sums.sums) - tuple_bytes)
        names = sums.of(starts, starts + tuple_bytes)
        ranked = (mixed(names) & ~PLACE) | starts.astype(np.uint64)
        chosen = (least_in_runs(ranked, length - tuple_bytes + 1) & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(new[1:], len(chosen)) - 1
        at = chosen[new]
        found = [at + begin, new + begin, last + begin, names[at], block_name(sums, new, last, at, length)]
        if held is not None and held[0][-1] == found[0][0]:  # its strings go on across the slices
            low, high = held[1][-1:], found[2][:1]
            across = Prefixes(data[low[0] : high[0] + length])
            found[1][0] = low[0]
            found[4][0] = block_name(across, low - low, high - low, found[0][:1] - low, length)[0]
            held = [x[:-1] for x in held]
        if held is not None:
            yield held
        held = found
    if held is not None:
        yield held


def key_of():
    return F.unhex(F.md5(text_of().cast("binary")))


def covered(docs: DataFrame, length: int, tuple_bytes: int) -> DataFrame:
    """key (of the text), at, low, high, name, block of every sampled suffix of every row."""
    schema = pa.schema([("key", pa.binary()), *((n, pa.int64()) for n in ("at", "low", "high", "name", "block"))])

    def work(batch: pa.RecordBatch) -> dict:
        rows, parts = [], [[], [], [], [], []]
        for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            if len(text) >= length:
                for found in cover(np.frombuffer(text, np.uint8), length, tuple_bytes):
                    rows.append(np.full(len(found[0]), k))
                    for column, values in zip(parts, found):
                        column.append(values)
        join = lambda arrays: np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
        out = dict(zip(("at", "low", "high", "name", "block"), map(join, parts)))
        out["key"] = pc.take(batch.column(0), pa.array(join(rows)))
        return out

    wanted = docs.select(key_of().alias("key"), text_of().alias("text"))
    return wanted.mapInArrow(by_batch(work, schema), "key binary, at bigint, low bigint, high bigint, name bigint, block bigint")


def cuts(docs: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    """name, step, core, whole, key, at, low, marks, open of every cut of the blocks."""
    lists = blocks.groupBy("key").agg(F.collect_list(F.struct("at", "low", "high", "name", "open")).alias("blocks"))
    rows = docs.select(key_of().alias("key"), text_of().alias("text")).join(lists, "key")
    schema = pa.schema(
        [(n, pa.int64()) for n in ("name", "step", "core", "whole")]
        + [("key", pa.binary()), ("at", pa.int64()), ("low", pa.int64()), ("marks", pa.list_(pa.int64())), ("open", pa.bool_())]
    )

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema}
        done = None
        for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            if key == done:  # the join puts copies side by side
                continue
            done = key
            data = np.frombuffer(text, np.uint8)
            for b in found:
                at, low, high = b["at"], b["low"], b["high"]
                base = max(0, low - STEP)
                sums = Prefixes(data[base : high + length + STEP])
                starts = np.arange(low - base, high - base + 1)
                marks = sums.of(starts, starts + length).view(np.int64)
                steps = np.arange((at - high) // STEP, (at - low) // STEP + 1)
                begin, end = at - base - STEP * steps - STEP + 1, at - base - STEP * steps
                core = sums.of(end, begin + length).view(np.int64)
                fits = (begin >= 0) & (end + length < len(sums.sums))
                whole = sums.of(np.where(fits, begin, 0), np.where(fits, end + length, 0)).view(np.int64)
                first, last = np.maximum(begin + base, low), np.minimum(end + base, high)
                for k in range(len(steps)):
                    out["marks"].append(marks[first[k] - low : last[k] - low + 1])
                out["name"] += [b["name"]] * len(steps)
                out["key"] += [key] * len(steps)
                out["at"] += [at] * len(steps)
                out["open"] += [b["open"]] * len(steps)
                out["step"] += steps.tolist()
                out["core"] += core.tolist()
                out["whole"] += [w if f else None for w, f in zip(whole.tolist(), fits.tolist())]
                out["low"] += first.tolist()
        return out

    ddl = "name bigint, step bigint, core bigint, whole bigint, key binary, at bigint, low bigint, marks array<bigint>, open boolean"
    return rows.select("key", "text", "blocks").mapInArrow(by_batch(work, schema), ddl)


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, tuple_bytes: int = TUPLE) -> DataFrame:
    """key, low, high: runs of starts of strings that occur again, the strings of a text by the text's key."""
    small_batches(spark)
    sampled = staged(spark, covered(docs, length, tuple_bytes), "sampled")
    # Keys are written before they are joined: beside an aggregation a join on a hot key could not be split.
    names = staged(spark, sampled.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")
    kept = staged(spark, sampled.join(names, "name"), "kept")
    dropped(spark, sampled, names)
    one = F.min(F.struct("key", "at", "low", "high")).alias("one")
    blocks = staged(spark, kept.groupBy("name", "block").agg(F.count(F.lit(1)).alias("n"), one), "blocks")
    again = kept.join(blocks.where("n > 1").select("name", "block"), ["name", "block"]).select("key", "low", "high")
    several = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("name")
    unsure = staged(spark, blocks.join(several, "name").select("name", "one.*", (F.col("n") == 1).alias("open")), "unsure")
    # An open block occurs once, so its text has no copy; a copy's cuts count as occurrences, which they are.
    cut = staged(spark, cuts(docs, unsure, length), "cuts")
    dropped(spark, unsure)
    place = ["name", "step"]
    shared = cut.groupBy(*place, "core").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open")).where("n > 1 AND open").select(*place, "core")
    shared = staged(spark, shared, "shared")
    alike = staged(spark, cut.join(shared, [*place, "core"], "left_semi"), "alike")
    dropped(spark, cut, shared)
    wholes = (
        alike.where("whole IS NOT NULL").groupBy(*place, "whole")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at", "low")).alias("one")).where("n > 1")
    )
    wholes = staged(spark, wholes, "wholes")
    known = staged(
        spark,
        alike.join(wholes, [*place, "whole"], "left")
        .withColumn("first", F.coalesce(F.struct("key", "at", "low") == F.col("one"), F.lit(False)))
        .withColumn("same", F.col("n").isNotNull()).drop("n", "one"),
        "known",
    )
    dropped(spark, alike, wholes)
    high = F.col("low") + F.size("marks") - 1
    all_again = known.where("open AND same").select("key", "low", high.alias("high"))
    asked = known.where("open AND NOT same").select(*place, "core").distinct()
    strings = known.where("NOT same OR first").join(asked, [*place, "core"], "left_semi").select(
        "name", "key", "at", "low", (F.col("open") & ~F.col("same")).alias("asked"), F.posexplode("marks").alias("k", "mark")
    ).select("name", (F.col("at") - F.col("low") - F.col("k")).alias("distance"), "mark", "key", (F.col("low") + F.col("k")).alias("low"), "asked")
    strings = staged(spark, strings, "strings")
    spot = ["name", "distance", "mark"]
    twice = strings.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked")).where("n > 1 AND asked").select(*spot)
    twice = staged(spark, twice, "twice")
    by_one = strings.where("asked").join(twice, spot).select("key", "low", F.col("low").alias("high"))
    found = staged(spark, again.union(all_again).union(by_one).distinct(), "repeats")
    dropped(spark, kept, blocks, known, strings, twice)
    return found


def removed(spark: SparkSession, docs: DataFrame, length: int = LENGTH, tuple_bytes: int = TUPLE, keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` without repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``keep_text`` all columns of ``docs``, with the bytes that are left as ``text`` (null texts stay null; a character
    that is cut in two becomes U+FFFD).
    """
    found = repeats(spark, docs, length, tuple_bytes)
    runs = found.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    columns = [c for c in docs.columns if c != "text"] if keep_text else ["doc_id"]
    rest = F.struct(*[docs[c] for c in columns]).alias("row")  # the text goes beside it, once
    joined = docs.select(rest, text_of().alias("whole"), docs["text"].isNull().alias("absent"), key_of().alias("key")).join(runs, "key", "left")
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("left", pa.string())]
    row_type = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ">"

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n, _ in fields}
            for text, spans in zip((t.as_py() for t in batch.column(1).cast(pa.binary())), batch.column(2).to_pylist()):
                kept, at, lost, count, end = [], 0, 0, 0, -1
                for low, high in sorted((s["low"], s["high"] + length) for s in spans or ()):
                    if low > end:
                        count += 1
                        kept.append(text[at:low])
                    lost += max(0, high - max(low, end))
                    at = end = max(end, high)
                kept.append(text[at:])
                left = b"".join(kept)
                out["n_bytes"].append(len(text))
                out["n_removed"].append(lost)
                out["n_spans"].append(count)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["left"].append(left.decode("utf-8", "replace") if keep_text else None)
            arrays = [batch.column(0), batch.column(3), *(pa.array(out[n], t) for n, t in fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "absent", *out])

    result = joined.select("row", "whole", "runs", "absent").mapInArrow(
        run, f"row {row_type}, absent boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, left string"
    )
    if not keep_text:
        return result.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    text = F.when(F.col("absent"), F.lit(None).cast("string")).otherwise(F.col("left")).alias("text")
    return result.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
