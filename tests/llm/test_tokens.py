"""Token counts and BPE against the library, byte for byte."""

import random

import pytest
from tokenizers import Tokenizer

from encore.llm import bpe, tokens
from encore.llm.bpe import Bpe, decode_names, encode_names, ragged
from encore.llm.tokens import count_tokens
from encore.llm.words import pieces

SCHEMA = "track_id long, track_name string, n_tokens string, id string"
ODD = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n x", "a  b", "　", "it's  we'll", "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>  b", "日本語の曲 名", "🎵🎶 é", "é", "\x1c \x85 z"]
ODD += ["a" * 3000, "ab" * 1500, " " * 500, "1234567890" * 50, "word " * 5000, "ƿȟɐʘ՘Ᲊ \U0001fae9x", "�\x00", "\t\tTrack\t01 - Name..."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.TOKENIZER)


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    mixed = ["".join(rng.choices(["the", "Ab", " ", "  ", "\n", "é", "'s", "12", "!!", "日", "<|endoftext|>", " ", "\U0001f3b5"], k=30)) for _ in range(200)]
    return ODD + mixed


def test_pieces_never_change_the_ids(library, names):
    for text in names:
        head, *rest = pieces(text)
        cut = [library.encode(p, add_special_tokens=False).ids for p in [head, *(" " + r for r in rest)]]
        assert sum(cut, []) == library.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(spark, rows, library, names):
    data = [(i, t, "x", "y") for i, t in enumerate(names)] + [(None, None, None, None), (1, "repeated", "", ""), (1, "repeated", "", "")]
    got = count_tokens(rows(data, SCHEMA), limit=100, table_size=20).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in data)
    assert sorted((r.track_id if r.track_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_encode_and_decode_equal_the_library(spark, rows, library, names):
    data = [(i, t, "x", "y") for i, t in enumerate(names)] + [(-1, None, None, None), (None, "no id", "", "")]
    got = decode_names(encode_names(rows(data, SCHEMA))).collect()
    assert len(got) == len(data)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in data}
    for r in got:
        assert r.token_ids == want[r.track_id]
        assert r.track_name == library.decode(r.token_ids, skip_special_tokens=False)


def test_decoding_in_the_same_task(spark, rows, names):
    got = encode_names(rows([(i, t, "x", "y") for i, t in enumerate(names)], SCHEMA), decoded="n_tokens").collect()
    assert {r.track_id: r.n_tokens for r in got} == dict(enumerate(names))


def test_ids_that_are_no_text_decode_as_in_the_library(library):
    with open(bpe.TOKENIZER, encoding="utf-8") as source:
        model = Bpe(source.read())
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(12)]
        assert model.decode(ragged([ids, []], int)) == [library.decode(ids, skip_special_tokens=False), ""]


def test_cuts_agree_with_the_library_for_every_code_point(library):
    with open(bpe.TOKENIZER, encoding="utf-8") as source:
        model = Bpe(source.read())
    for point in [*range(0x3000), *range(0xFE00, 0xFFFF), *range(0x1F000, 0x1FB00)]:
        text = "a{0}1{0}.{0}{0} {0}".format(chr(point))
        assert model.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_cache_overflow_changes_nothing(library, names, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(tokens, "CACHE", 3)
    with open(bpe.TOKENIZER, encoding="utf-8") as source:
        text = source.read()
    model, lengths = Bpe(text), tokens.Lengths(text, {})
    for start in range(0, len(names), 7):
        part = names[start : start + 7]
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        got = model.encode(part)
        assert [got.flat[a:b].tolist() for a, b in zip(got.ends, got.ends[1:])] == want
        assert lengths.counts(part) == [len(w) for w in want]


def test_empty_tables(spark, rows):
    empty = rows([], SCHEMA)
    assert count_tokens(empty).count() == 0
    assert decode_names(encode_names(empty)).count() == 0
