"""Token coding, files and counts against the libraries."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from odd import docs_of, odd_docs, odd_texts

from rankloom.llm import bpe, counting, packing
from rankloom.llm.library import ids_of, tokenizer

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def made_texts(seed, n=150):
    rng = random.Random(seed)
    kinds = ["ab", "aA ", "theing \n", "aeiou!  '", "é世a 　", "xyz0 \x1c\x85", "<|>endoftext startof", "a", "ΣΑσ İ", "e\u0301 n\u0303"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([0, 3, 90, 400, 1500])))
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["<|endoftext|>", "<|startoftext|>"]) + text[at:]
        out.append(text)
    return out


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Merges(WORD))


def test_encoder_and_decoder_equal_the_library(encoder):
    library = tokenizer(WORD)
    for text in made_texts(1) + [t or "" for _, t in odd_texts()]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(encoder.encode(text)) == ids
        decoder = bpe.Decoder(encoder.merges)
        cut = len(ids) // 2
        shown = decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.finish()
        assert shown == library.decode(ids, skip_special_tokens=False)


def test_transducer_is_exact_and_bounded(encoder):
    merges = encoder.merges
    bound = bpe.sufficient_lookahead(merges)
    rng = random.Random(3)
    for alphabet in ("a", "ab", "ing", "theraou", "!?"):
        symbols = [merges.inner[b] for b in "".join(rng.choice(alphabet) for _ in range(1500)).encode()]
        machine, out = bpe.Transducer(merges), []
        for n, symbol in enumerate(symbols, 1):
            out += machine.push(symbol)
            assert len(machine.symbols) <= bound
        assert out + machine.finish() == merges.apply(symbols)


def test_transducer_emits_before_the_end(encoder):
    machine = bpe.Transducer(encoder.merges)
    early = [t for b in b"thenandwherethistion" * 50 for t in machine.push(encoder.merges.inner[b])]
    assert len(early) > 100


def test_byte_machine_restores_text_bit_by_bit():
    merges = bpe.Merges(BYTE)
    for text in made_texts(4, 40):
        ids = ids_of(BYTE, text)
        decoder = bpe.Decoder(merges)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_coded_table(spark):
    library = tokenizer(WORD)
    got = sorted(map(tuple, bpe.coded(odd_docs(spark), WORD).drop("n_text_chars").collect()), key=repr)
    want = []
    for doc, text in odd_texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.coded(odd_docs(spark).limit(0), WORD).count() == 0
    assert bpe.coded(docs_of(spark, [(1, "hello there")]), WORD, keep_ids=True).first().ids == library.encode("hello there", add_special_tokens=False).ids


def test_rank_encoder_equals_the_library():
    library = tokenizer(BYTE)
    for text in made_texts(2):
        assert ids_of(BYTE, text) == library.encode(text, add_special_tokens=False).ids
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000, "\u3000" * 1_500_000 + "<|endoftext|>", "x" * 2_000_000):
        assert ids_of(BYTE, text) == library.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        ids_of(WORD, "a")


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, width)
    assert len(data) == (1001 * width + 7) // 8
    for first, count in ((0, 1001), (0, 0), (5, 1), (333, 400), (1000, 1)):
        assert np.array_equal(packing.unpack(data, width, first, count), ids[first : first + count])
    block = packing.Block(packing.block_bytes([4, None, 9], [ids[:10], ids[:0], ids[10:]], width))
    assert np.array_equal(block.document(2), ids[10:]) and len(block.document(1)) == 0 and np.array_equal(block.all(), ids)


def test_width_is_the_fewest_bits():
    assert [packing.width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("width", [None, 19])
def test_token_files(spark, width):
    library = tokenizer(BYTE)
    files = packing.write(odd_docs(spark), BYTE, end_id=0, block_ids=500, width=width)
    got = sorted(map(tuple, packing.digests(files).collect()), key=lambda r: r[1])
    want, at = [], 0
    for doc, text in sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert got == want
    found = files.lookup(7, 7).collect()
    assert any(7 in packing.Block(bytes(r.data)).entries["doc"] for r in found) and len(found) < files.blocks().count()


def test_token_files_of_an_empty_table(spark):
    assert packing.digests(packing.write(odd_docs(spark).limit(0), BYTE)).count() == 0


def test_chunks_count_like_the_whole():
    library, rng = tokenizer(BYTE), random.Random(5)
    for text in made_texts(6):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert counting.count_in_chunks(library, text, rng.choice([40, 64, 200]), rng.choice([4, 16, 40])) == n


def test_counted_table(spark):
    library = tokenizer(BYTE)
    got = sorted(map(tuple, counting.counted(odd_docs(spark), BYTE, limit=20, size=1000, overlap=64).collect()), key=repr)
    want = []
    for doc, text in odd_texts():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 20))
    assert got == sorted(want, key=repr)
    assert counting.counted(odd_docs(spark).limit(0), BYTE).count() == 0


def test_pieces_of_letters_are_not_matched_by_the_pattern(monkeypatch):
    encoder = bpe.Encoder(bpe.Merges(WORD))
    asked = []
    split = encoder._split
    monkeypatch.setattr(encoder, "_split", lambda text: asked.append(text) or split(text))
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    texts = ["Hello, (there) großer Éclair. don't", "Hello, İ ab< <|endoftext|>, x'", "Éclair. e\u0301a, Ωmega's"]
    for text in texts:
        assert list(encoder.encode(text)) == tokenizer(WORD).encode(text, add_special_tokens=False).ids
    assert not {"hello,", "großer", "éclair."} & set(asked)
    encoder.encode("Hello, Hello, a")
    encoder.encode("Hello, b")  # full, yet what is asked again stays
    assert "Hello," in encoder.pieces and "a" not in encoder.pieces
