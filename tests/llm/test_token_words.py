import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Regex, Tokenizer, pre_tokenizers

from qaflow.llm import huffman_tokens

PARTS = ["a", "the", "Was", " ", " ", " ", "  ", "\n", "\n", "\n\n", "'s", "'ll", "é", "à", "è ", "1", "23", "!!", ".", ",", ";:", "?", "　", "日本", "😀", "aaaa", "ing",
         "\t", "\r\n", " ", " ", "᠎", " ", " ", "\x1c", "\x85", "\x0b", "\x00", "<|endoftext|>", "<|", "_", "(", "Ġ", "Ċ", "̀", "ª", "²", "٣"]


def texts(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    return [["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(40)] for _ in range(n)]


def path():
    return public_tokenizers.path(huffman_tokens.TOKENIZER_FILE)


def test_a_word_is_encoded_once_whatever_follows_it():
    words = huffman_tokens.WordIds(path())
    words.batch(["One two, one.\nTwo two. One two", "Two; two\nTwo two? two"])
    assert set(words.known) == {b"One", b"Two", b" two", b" one", b"\nTwo", b" One", b",", b".", b";", b"?"}


@pytest.mark.parametrize("most", [huffman_tokens.CACHE_WORDS, 60])
def test_words_equal_library(monkeypatch, most):
    monkeypatch.setattr(huffman_tokens, "CACHE_WORDS", most)
    words, library = huffman_tokens.WordIds(path()), Tokenizer.from_file(path())
    for some in texts(4, 60):
        assert [x.tolist() for x in words.batch(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert words.batch([]) == [] and [len(x) for x in words.batch(["", ""])] == [0, 0]


def test_a_blank_behind_any_character():
    words, library = huffman_tokens.WordIds(path()), Tokenizer.from_file(path())
    some = [f"a{chr(c)} b{chr(c)}\nc {chr(c)}d\n{chr(c)}e.{chr(c)},f" for c in [*range(0x3100), 0xFEFF, 0xFF0C]]
    assert [x.tolist() for x in words.batch(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_words_of_another_pattern(tmp_path):
    # here a mark takes the line feeds behind it and a letter the mark before it
    pattern = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
    library = Tokenizer.from_file(path())
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.save(str(tmp_path / "other.json"))
    words = huffman_tokens.WordIds(str(tmp_path / "other.json"))
    for some in texts(5, 60):
        assert [x.tolist() for x in words.batch(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("n", [0, 1, huffman_tokens.PACKED - 1, huffman_tokens.PACKED, huffman_tokens.PACKED + 1, 3 * huffman_tokens.PACKED + 700])
def test_packing_in_parts(n):
    rng = random.Random(n)
    ids = np.array([min(int(rng.paretovariate(0.6)), 400) for _ in range(n)], "<u2")
    lengths = huffman_tokens.code_lengths(np.bincount(ids, minlength=401) + 1, 16)
    codes, table, size = huffman_tokens.canonical(lengths)
    payload, at = huffman_tokens.pack(ids, codes, lengths)
    assert (huffman_tokens.unpack(payload, n, at, table, size) == ids).all() and len(at) == -(-n // huffman_tokens.CHECKPOINT)
