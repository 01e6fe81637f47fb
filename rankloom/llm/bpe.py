"""Byte-pair encoding and decoding as streaming transducers.

``sufficient_lookahead`` bounds, from the merge list alone, how far ahead of a token the text can still change it.
``Transducer`` reads symbols one by one and keeps, for every recent prefix, the last token of that prefix's encoding.
Any continuation of the text ends a token within the last ``longest`` symbols, and the encoding of a prefix that ends at
a token's end is final; so the tokens on which the chains of all those prefixes agree are stable and are emitted at once.
The state never exceeds the lookahead, however long the input is.

``Encoder`` puts the file's normaliser and pre-tokeniser in front. Blanks end every pre-token of the supported files that
drop white space, so a text is read blank by blank; short pieces, which lie inside the lookahead as a whole, are merged
directly, those of a batch together, and remembered in a bounded table. ``Decoder`` turns ids back into text with an incremental byte-to-text state
machine that holds at most three bytes, or into the joined token strings if the file names no decoder.

Defined results: null and empty texts have no tokens and decode to the empty text; strings of special tokens inside a
text become these tokens, as in the library; letters that Python's Unicode tables lack count as symbols; rows are handled one by one, so repeated rows and ties need no rule; extra
columns of the input are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import string
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankloom.llm.common import by_batch, small_batches, text_of

# Unicode white space, and the split pattern of byte-level files that name none.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DIRECT = 64  # pieces of so many characters are merged at once; longer ones are streamed
SHORT = 24  # symbols of words that are merged many at a time
REMEMBERED = 100_000  # pieces whose ids a task keeps, about 25 MB; longer ones are not kept
LONGEST_KEPT = 64
NONE = np.int32(1 << 30)


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Merges:
    """The vocabulary and merge list of a tokenizer file, by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(self.strings) + 1
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.suffix] for c in alphabet]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        self.spelt: dict[int, tuple[int, ...]] = {i: (i,) for i in {*self.inner, *self.final}}
        rules = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.vocab[left], self.vocab[right]
            new = self.vocab[left + right]
            self.ranks.setdefault((a, b), rank)
            self.made.append(new)
            self.spelt.setdefault(new, self.spelt[a] + self.spelt[b])
            rules.append((a, b))
        self.rules = rules
        self.longest = max(map(len, self.spelt.values()))
        self.by_spelling = {s: i for i, s in self.spelt.items()}
        raw = {c: b for b, c in enumerate(alphabet)}
        symbol_bytes = {self.inner[b]: bytes([b]) for b in range(256)}
        if self.suffix:
            symbol_bytes |= {self.final[b]: bytes([b]) + b" " for b in range(256)}
        self.bytes_of = {i: b"".join(symbol_bytes[x] for x in s) for i, s in self.spelt.items()}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.bytes_of |= {
            i: bytes(raw[c] for c in s if c in raw) for i, s in self.strings.items() if i not in self.bytes_of
        }

    def apply(self, symbols: list[int]) -> list[int]:
        """The merges of a whole piece: the rule of the lowest rank first, the leftmost pair of it first."""
        rank_of, made, ids, none = self.ranks.get, self.made, list(symbols), len(self.made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), none)
        return ids


class ManyMerges:
    """``Merges.apply`` of many short words at once: one row per word, the best rule of every row in each round."""

    def __init__(self, merges: Merges, bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.made = np.array([*merges.made, 0], np.int32)
        self.inner, self.final = np.array(merges.inner, np.int32), np.array(merges.final, np.int32)
        pairs = np.array([(a << 32) | b for a, b in merges.ranks], np.int64)
        for key, slot, rank in zip(pairs.tolist(), self._slot(pairs).tolist(), merges.ranks.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, rank

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = (left.astype(np.int64) << 32) | right
        slot = self._slot(pairs)
        out = np.full(len(pairs), NONE, np.int32)
        todo = np.arange(len(pairs))
        while len(todo):
            held = self.keys[slot]
            hit = held == pairs
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, pairs, slot = todo[on], pairs[on], (slot[on] + 1) & self.mask
        return out

    def apply(self, words: list[bytes]) -> list[bytes]:
        """Ids of the words, as unsigned 32-bit integers in a row."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max()) + 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, last = self.inner[raw], np.cumsum(size) - 1
        symbols[last] = self.final[raw[last]]
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = symbols
        after = np.minimum(np.arange(1, width + 1), width - 1)[None, :].repeat(len(words), 0)
        before = np.maximum(np.arange(-1, width - 1), 0)[None, :].repeat(len(words), 0)
        rank = np.full(ids.shape, NONE, np.int32)
        inside = np.arange(width - 1) < size[:, None] - 1
        rank[:, :-1][inside] = self._rank(ids[:, :-1][inside], ids[:, 1:][inside])
        rows = np.arange(len(words))
        while len(rows):
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            on = best < NONE
            rows, at, best = rows[on], at[on], best[on]
            if not len(rows):
                break
            gone = after[rows, at]
            ids[rows, at] = self.made[best]
            ids[rows, gone] = -1
            rank[rows, gone] = NONE
            then = after[rows, gone]
            after[rows, at] = then
            before[rows, then] = at
            ahead = ids[rows, then] >= 0
            fresh = np.full(len(rows), NONE, np.int32)
            fresh[ahead] = self._rank(ids[rows[ahead], at[ahead]], ids[rows[ahead], then[ahead]])
            rank[rows, at] = fresh
            behind = at > 0
            r, k = rows[behind], at[behind]
            p = before[r, k]
            rank[r, p] = self._rank(ids[r, p], ids[r, k])
        alive = ids >= 0
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        flat = ids[alive].tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def sufficient_lookahead(merges: Merges) -> int:
    """Symbols after a token's end that can still change it, at most.

    A symbol further right acts on a token only through a chain of merges: a rule takes the token that a later rule would
    have merged to the left, and so on. Ranks rise along a chain, and each step passes one token. Rule ``s`` may follow
    rule ``r`` if the right part of ``s`` and the left part of ``r`` can end at the same place, so one is a suffix of the
    other. The longest such chain times the longest token bounds the lookahead.
    """
    ending: dict[tuple[int, ...], int] = {}
    exact: dict[tuple[int, ...], int] = {}
    longest = 0
    for a, b in merges.rules:
        left, right = merges.spelt[a], merges.spelt[b]
        before = max([ending.get(right, 0), *(exact.get(right[k:], 0) for k in range(len(right)))])
        length = before + 1
        longest = max(longest, length)
        if exact.get(left, 0) < length:
            exact[left] = length
            for k in range(len(left)):
                if ending.get(left[k:], 0) < length:
                    ending[left[k:]] = length
    return (longest + 1) * merges.longest


class Transducer:
    """Encodes one piece symbol by symbol, emitting tokens once no continuation can change them."""

    def __init__(self, merges: Merges, check_every: int = 64):
        self.merges, self.check_every = merges, check_every
        self.symbols: list[int] = []  # since ``begun``
        self.last: list[int] = []  # last token of the prefix that ends after each of them
        self.begun = 0  # length of the prefix already emitted and forgotten
        self.first: int | None = None  # the token before ``begun``
        self.fits: dict[tuple[int, int], bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether token ``b`` follows token ``a`` in the encoding of their joint text."""
        found = self.fits.get((a, b))
        if found is None:
            spelt = self.merges.spelt
            found = self.merges.apply([*spelt[a], *spelt[b]]) == [a, b]
            if len(self.fits) > 100_000:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def push(self, symbol: int) -> list[int]:
        self.symbols.append(symbol)
        n, known = len(self.symbols), self.merges.by_spelling
        for length in range(min(n, self.merges.longest), 0, -1):
            token = known.get(tuple(self.symbols[n - length :]))
            if token is None:
                continue
            before = self.last[n - length - 1] if n > length else self.first
            if (self.merges.apply(self.merges.spelt[token]) == [token]) if before is None else self._fit(before, token):
                self.last.append(token)
                break
        else:
            raise ValueError("the merge list does not fit its vocabulary")
        return self._stable() if n >= self.check_every + self.merges.longest else []

    def _emit(self, end: int) -> list[int]:
        out, at = [], end
        while at:
            out.append(self.last[at - 1])
            at -= len(self.merges.spelt[self.last[at - 1]])
        return out[::-1]

    def _stable(self) -> list[int]:
        """Emits what the chains of all prefixes that end within the last token's reach have in common."""
        n = len(self.symbols)
        live = set(range(max(0, n - self.merges.longest + 1), n + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - len(self.merges.spelt[self.last[top - 1]]))
        end = live.pop()
        if not end:
            return []
        out = self._emit(end)
        self.first = out[-1]
        self.symbols, self.last, self.begun = self.symbols[end:], self.last[end:], self.begun + end
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.symbols))


class Encoder:
    """Ids of texts as the tokenizer file defines them, special tokens inside texts included."""

    def __init__(self, merges: Merges):
        self.merges = merges
        spec = merges.spec
        steps = spec["normalizer"] or {"normalizers": []}
        kinds = {s["type"] for s in steps.get("normalizers", [steps])}
        if not kinds <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normaliser {sorted(kinds)} is not supported")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = next((p for p in parts if p["type"] == "Split"), None)
        pattern = split["pattern"]["Regex"] if split else BYTE_PATTERN
        self.drops_blanks = bool(split) and split["behavior"] == "Removed"
        self.words = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        # Letters of a later Unicode version than the library's are no letters to it: matched as a currency sign instead.
        beyond = "".join(map(chr, range(0x80, 0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
        self.later = frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", beyond) if unicodedata.category(c) == "Cn")
        self.blanks = regex.compile(f"[{SPACES}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.marks = {s[0] for s in merges.special}  # special tokens begin with one of them
        self.plain = not any(map(str.isalpha, self.marks))  # no special token inside letters
        signs = set(string.punctuation) - self.marks if self.plain else ()
        self.tails = {c for c in signs if self.words.findall(f"ab{c}") == ["ab", c]}
        self.many = ManyMerges(merges)
        # Ids as unsigned 32-bit integers in a row; special tokens are known by their ids.
        self.fixed = {i: array("I", [i]).tobytes() for i in merges.special.values()}
        self.pieces: dict[str, bytes] = {}
        self.words_seen: dict[str | int, bytes] = {**self.fixed}
        self.passing: list[str] = []

    def _normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # code point by code point: a final sigma is no special case
            text = text.replace("Σ", "σ").lower()
        return text

    def _split(self, text: str) -> list[str]:
        if text.isascii() or self.later.isdisjoint(text):
            return self.words.findall(text)
        shown = "".join("¤" if c in self.later else c for c in text)
        return [text[m.start() : m.end()] for m in self.words.finditer(shown)]

    def _symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        out = [*map(self.merges.inner.__getitem__, raw)]
        out[-1] = self.merges.final[raw[-1]]
        return out

    def _word(self, word: str) -> bytes:
        symbols = self._symbols(word)
        if len(word) <= DIRECT:
            return array("I", self.merges.apply(symbols)).tobytes()
        machine, out = Transducer(self.merges), array("I")
        for symbol in symbols:
            out.extend(machine.push(symbol))
        out.extend(machine.finish())
        return out.tobytes()

    def _parts(self, piece: str) -> list[str | int]:
        """Words and ids of special tokens of a piece."""
        # Most pieces are letters, some with one sign behind them; the pattern need not be asked about these.
        if self.plain and piece.isalpha():
            word = self._normal(piece)
            if word.isalpha():
                return [word]
        elif piece[-1:] in self.tails and piece[:-1].isalpha():
            word = self._normal(piece[:-1])
            if word.isalpha():
                return [word, piece[-1]]
        if self.marks.isdisjoint(piece):
            return self._split(self._normal(piece))
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(piece) if self.special else [piece]):
            out += [self.merges.special[part]] if k % 2 else self._split(self._normal(part))
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Ids of the pieces not seen yet, the short words of all of them at once."""
        asked, known = set(chain.from_iterable(texts)), self.words_seen
        if len(self.pieces) > REMEMBERED:  # what these texts hold again is likely to come back
            self.pieces = {p: ids for p, ids in self.pieces.items() if p in asked}
        parts = {p: self._parts(p) for p in asked.difference(self.pieces)}
        words = {w for w in chain.from_iterable(parts.values()) if w.__class__ is str}
        if len(known) > REMEMBERED:
            known = self.words_seen = {**self.fixed, **{w: ids for w, ids in known.items() if w in words}}
        fresh = words.difference(known)
        raw = {w: w.encode("utf-8", "surrogatepass") for w in fresh if len(w) <= SHORT}
        short = {w: x for w, x in raw.items() if len(x) <= SHORT}
        if short:
            known.update(zip(short, self.many.apply([*short.values()])))
        long = fresh.difference(short)
        known.update((w, self._word(w)) for w in long)
        for piece, found in parts.items():
            self.pieces[piece] = known[found[0]] if len(found) == 1 else b"".join(map(known.__getitem__, found))
        for word in long:
            del known[word]
        self.passing = [piece for piece in parts if len(piece) > LONGEST_KEPT]

    def forget(self, everything: bool = False) -> None:
        """Drops the long pieces of the last texts, or all that was learned."""
        for piece in self.passing:
            self.pieces.pop(piece, None)
        self.passing = []
        if everything:
            self.pieces, self.words_seen = {}, {**self.fixed}

    def _cut(self, text: str) -> list[str]:
        if not self.drops_blanks:
            return [text]
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these for blanks
            return [*filter(None, self.blanks.split(text))]
        return text.split()

    def encode_all(self, texts: list[str]) -> list[array]:
        cut = [*map(self._cut, texts)]
        self.learn(cut)
        ids_of = self.pieces.__getitem__
        out = [array("I", b"".join(map(ids_of, pieces))) for pieces in cut]
        self.forget()
        return out

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]


class Decoder:
    """Text of ids, fed bit by bit."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.joins = merges.spec["decoder"] is None
        self.begun = False

    def text(self, ids: Iterable[int]) -> str:
        """Text whose bytes are complete so far; word ends become blanks."""
        return self.machine.decode(b"".join(map(self.merges.bytes_of.__getitem__, ids)))

    def feed(self, ids: Iterable[int]) -> str:
        """As the file says: through bytes with a byte-level decoder, else the token strings with blanks between."""
        if not self.joins:
            return self.text(ids)
        shown = " ".join(map(self.merges.strings.__getitem__, ids))
        if shown and self.begun:
            shown = " " + shown
        self.begun = self.begun or bool(shown)
        return shown

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def coder(path: str) -> Encoder:
    """One encoder for each worker; what it learns ends with the task."""
    return Encoder(Merges(path))


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_sha256, decoded_sha256, n_text_chars, and ids if asked for.

    ``path`` is a tokenizer file at the same place on every machine. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    kind = pa.int64()
    fields = [
        pa.field(id_col, kind),
        pa.field("n_tokens", pa.int64()),
        pa.field("ids_sha256", pa.string()),
        pa.field("decoded_sha256", pa.string()),
        pa.field("n_text_chars", pa.int64()),
    ] + ([pa.field("ids", pa.list_(pa.int32()))] if keep_ids else [])

    def work(batch: pa.RecordBatch) -> dict:
        encoder = coder(path)
        out: dict[str, list] = {f.name: [] for f in fields}
        out[id_col] = batch.column(0)
        for ids in encoder.encode_all(batch.column(1).to_pylist()):
            decoder = Decoder(encoder.merges)
            shown = decoder.feed(ids) + decoder.finish()
            back = Decoder(encoder.merges)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())
            out["n_text_chars"].append(len(back.text(ids)) + len(back.finish()))
            if keep_ids:
                out["ids"].append(np.frombuffer(ids, np.int32))
        return out

    schema = pa.schema(fields)
    types = {pa.int64(): "bigint", pa.string(): "string"}
    ddl = ", ".join(f"{f.name} {types.get(f.type, 'array<int>')}" for f in fields)
    def run(batches):
        try:
            yield from by_batch(work, schema)(batches)
        finally:
            coder(path).forget(everything=True)

    return docs.select(docs[id_col].cast("bigint").alias(id_col), text_of().alias("text")).mapInArrow(run, ddl)
