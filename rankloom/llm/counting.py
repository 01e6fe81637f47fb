"""Token counts; huge documents by overlap resynchronisation.

A text of more than ``size`` characters is encoded in chunks that overlap, each with the offsets of its tokens and words.
The pre-tokeniser scans from left to right and looks one character ahead, so from a place on where two chunks both begin
a word, both go on alike. Such a place is a proven splice if the left chunk is right there: it is right from its own splice
up to its last two words, or up to the length of the longest special string before its end, as only these can still
change with the text that follows. The right chunk counts from the splice on. Where an overlap has no such place (a word
longer than it), it is doubled, the last time to the whole rest of the text; memory is one chunk and its overlap.

Texts up to ``size`` are counted whole. Defined results: null and empty texts have 0 bytes and 0 tokens; rows are counted
one by one, repeated rows stay, extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import by_batch, small_batches, text_of
from rankloom.llm.library import whole_library

SIZE = 65_536
OVERLAP = 512


class Chunk:
    """Token starts of ``text[begin:end]`` in the whole text, and which of them begin a word."""

    def __init__(self, library, text: str, begin: int, end: int):
        got = library.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.end = begin, end
        self.starts = [begin + a for a, _ in got.offsets]
        words = got.word_ids
        # A special token has no word of its own: it begins one, and so does what follows it.
        self.heads = [k for k in range(len(words)) if k == 0 or words[k] is None or words[k] != words[k - 1]]

    def word_starts(self) -> dict[int, int]:
        """Place of each word in the text: number of tokens before it."""
        return {self.starts[k]: k for k in self.heads}


def splice(left: Chunk, right: Chunk, margin: int) -> tuple[int, int] | None:
    """Tokens of ``left`` before, and of ``right`` before, the first place that is proven to be a boundary of the text."""
    sure = [k for k in left.heads[:-2] if left.starts[k] <= left.end - margin]
    ahead = right.word_starts()
    for k in sure:
        # The chunk's own first place is a cut, not a boundary that its scan has found.
        if left.starts[k] > right.begin and left.starts[k] in ahead:
            return k, ahead[left.starts[k]]
    return None


def count_in_chunks(library, text: str, size: int = SIZE, overlap: int = OVERLAP) -> int:
    specials = [t.content for t in library.get_added_tokens_decoder().values()]
    margin = max(map(len, specials), default=0) + 1
    total, skip = 0, 0
    left = Chunk(library, text, 0, min(size, len(text)))
    while left.end < len(text):
        wide = overlap
        while True:
            begin = max(left.begin, left.end - wide)
            right = Chunk(library, text, begin, min(left.end + size, len(text)))
            met = splice(left, right, margin)
            if met is not None and met[0] >= skip:
                total += met[0] - skip
                left, skip = right, met[1]
                break
            if begin == left.begin:  # no place even in the whole chunk: it grows
                left = Chunk(library, text, left.begin, min(left.end + size, len(text)))
                break
            wide *= 2
    return total + len(left.starts) - skip


def counted(
    docs: DataFrame, path: str, limit: int = 1024, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every text. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def work(batch: pa.RecordBatch) -> dict:
        library, texts = whole_library(path), batch.column(1).to_pylist()
        whole = iter(library.encode_batch_fast([t for t in texts if len(t) <= size], add_special_tokens=False))
        counts = [
            len(next(whole).ids) if len(t) <= size else count_in_chunks(library, t, size, overlap) for t in texts
        ]
        return {
            id_col: batch.column(0),
            "n_bytes": batch.column(2),
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    wanted = docs.select(
        F.col(id_col).cast("bigint").alias(id_col), text_of().alias("text"), F.octet_length(text_of()).cast("bigint").alias("n")
    )
    return wanted.mapInArrow(by_batch(work, schema), f"{id_col} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
