"""Cleaning and tokenising text, per-row term counts, and the words that two rows share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as neither word character nor white space, in any script.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def clean(text: Column) -> Column:
    return F.regexp_replace(text, NOT_WORD, " ")


def tokens(text: Column) -> Column:
    """Lower-case words in text order."""
    return F.array_remove(F.split(F.lower(clean(text)), r"\s+"), "")


def term_vectors(df: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """Add ``length, bag, terms, tfs`` per row without a shuffle.

    Sorting a row's tokens brings equal words together, so the counts are the gaps between run starts. ``bag`` is a
    digest of the sorted tokens: rows with the same bag have the same bag-of-words score against anything.
    """
    ordered = df.select(*keep, F.sort_array(tokens(F.col(text_col))).alias("_words"))
    starts = ordered.withColumn(
        "_starts",
        F.array_compact(
            F.transform("_words", lambda w, i: F.when((i == 0) | (w != F.get("_words", i - 1)), i))
        ),
    )
    return starts.select(
        *keep,
        F.size("_words").cast("bigint").alias("length"),
        F.md5(F.array_join("_words", " ")).alias("bag"),
        F.transform("_starts", lambda i: F.get("_words", i)).alias("terms"),
        F.transform(
            "_starts", lambda i, j: F.coalesce(F.get("_starts", j + 1), F.size("_words")) - i
        ).alias("tfs"),
    )


def _places(asked: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and the places in both lists, of the words that stand in a row's two lists, in the order of ``asked``."""
    n_asked, n_held = (pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (asked, held))
    words = held.flatten().dictionary_encode()
    codes = pc.fill_null(pc.index_in(asked.flatten(), value_set=words.dictionary), -1).to_numpy()
    rows, own_rows = (np.repeat(np.arange(len(n)), n) for n in (n_asked, n_held))
    at, own_at = (np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) for r, n in ((rows, n_asked), (own_rows, n_held)))
    known = np.flatnonzero(codes >= 0)
    # One sorted list of (row, word): a word's first place is its number's rank.
    keys = own_rows * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, wanted = keys[order], rows[known] * len(words.dictionary) + codes[known]
    found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    met = np.flatnonzero(keys[found] == wanted) if len(keys) else np.empty(0, np.int64)
    return rows[known[met]], at[known[met]], own_at[order[found[met]]]


def _shared(asked: pa.Array, held: pa.Array) -> pa.Array:
    rows, i, at = _places(asked, held)
    ends = np.cumsum(np.bincount(rows, minlength=len(asked)))
    pairs = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(at + 1, pa.int32())], ["i", "at"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)


def shared_words(asked: Column | str, held: Column | str) -> Column:
    """Where the words of both lists stand: ``i`` from 0 in ``asked``, ``at`` from 1 in ``held``, its first place there."""
    return F.arrow_udf(_shared, "array<struct<i:int,at:int>>")(asked, held)
