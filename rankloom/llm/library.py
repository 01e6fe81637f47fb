"""The libraries that read a tokenizer file: the file's own, and a faster one for the same vocabulary."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

from rankloom.llm.bpe import BYTE_PATTERN, byte_alphabet

# The rank encoder's pattern matcher runs out of stack on about a million blanks in a row.
LONG_BLANK = re.compile(r"\s{10000}")


def tokenizer(path: str):
    """The file's own library, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def whole_library(path: str):
    """One for each worker."""
    return tokenizer(path)


@lru_cache(maxsize=2)
def ranked(path: str):
    """The same ids from a rank encoder, several times as fast; refuses files whose ids are not in the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    if spec["normalizer"] or not plain or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("only plain byte-level files have a rank encoder")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in pairs] != [*range(256, 256 + len(pairs))]:
        raise ValueError("ids are not in the order of merges")
    raw = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(raw[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def blank_for_long(text: str) -> bool:
    """Whether a text must be left to the file's own library."""
    return len(text) >= 10_000 and LONG_BLANK.search(text) is not None


def ids_of(path: str, text: str) -> list[int]:
    """Ids of a whole text; strings of special tokens become these tokens."""
    if blank_for_long(text):
        return whole_library(path).encode(text, add_special_tokens=False).ids
    return ranked(path).encode(text, allowed_special="all", disallowed_special=())
