"""Token counts and the codec against the public library; the machines against plain rules."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventframe.llm import bpe_codec, bpe_machine, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["'s", "'re", "'", "'l", "'ll", " 'v", "'ve", "'d", " ", "  ", "\n", "\t", " ", " ", "the", " and", "tion",
        "123", " 45", "!!", "...", "Über", "naïve", " it's", "一二三", "🙂", "é", "\U000323b0", "Ᲊ", "<|endoftext|>", "<|endof"]


def random_text(rnd: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.6:
            out.append(rnd.choice(BITS))
        elif kind < 0.8:
            out.append(rnd.choice("abstrelvd aaa-=é"))
        elif kind < 0.9:
            out.append(chr(rnd.choice([rnd.randrange(1, 0x500), rnd.randrange(0x500, 0xD800), rnd.randrange(0xE000, 0x110000)])))
        else:
            out.append(rnd.choice([" ", "-", "a", "1", "the"]) * rnd.randrange(60))
    return "".join(out)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    return ["", " ", "'", "'r", "\n\n", "a" * 5000, "x " * 3000, "-" * 999 + "z"] + [random_text(rnd, rnd.randrange(150)) for _ in range(600)]


def test_encoder_equals_library(texts, library):
    encoder = bpe_machine.Encoder(PATH)
    tokens, counts = encoder.encode(texts)
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [r.tolist() for r in np.split(tokens, np.cumsum(counts)[:-1])] == wanted
    assert encoder.counts(texts).tolist() == [len(w) for w in wanted]


def test_small_tables_and_stream_give_the_same(texts, library):
    encoder = bpe_machine.Encoder(PATH)
    encoder.machine.bound = 200
    some = texts[5:80]
    wanted = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [encoder.encode([t])[0].tolist() for t in some] == wanted
    assert encoder.machine.drops > 0
    assert [[n for block in encoder.stream(t) for n in block] for t in some] == wanted


def test_states_of_frequent_words_outlive_a_drop(monkeypatch, library):
    encoder = bpe_machine.Encoder(PATH)
    machine, rnd, common = encoder.machine, random.Random(5), "some words of every text"
    machine.bound = 400
    for n in range(120):
        text = f"{common} {''.join(rnd.choices('abcdefghij', k=9))}"
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert machine.drops > 1
    machine._drop()
    assert len(machine.configs) <= 300 and machine.cells.count <= len(machine.configs) * 4
    monkeypatch.setattr(machine, "_compile", None)  # nothing is left to compile
    assert encoder.encode([common])[0].tolist() == library.encode(common, add_special_tokens=False).ids


def test_unstable_bytes_stay_within_the_lookahead(texts):
    encoder = bpe_machine.Encoder(PATH)
    encoder.encode(texts)
    machine = encoder.machine
    size = [len(b) for b in encoder.merges.bytes]
    waiting = max(sum(size[t] for t in tokens) for n in range(len(machine.configs)) for _, tokens in machine._starts(n)[1])
    assert 0 < waiting <= encoder.merges.lookahead


def test_long_text_in_parts(monkeypatch, library):
    monkeypatch.setattr(bpe_machine, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe_codec, "SLICE_CHARS", 50)
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 50)
    rnd = random.Random(3)
    text = "".join(random_text(rnd, 30) + " of the " for _ in range(30)) + "q" * 700
    monkeypatch.setattr(bpe_machine.parts, "__defaults__", (50,))
    monkeypatch.setattr(bpe_machine.slices, "__defaults__", (50,))
    encoder = bpe_machine.Encoder(PATH)
    wanted = library.encode(text, add_special_tokens=False).ids
    assert np.concatenate(list(encoder.tokens(text))).tolist() == wanted
    assert token_counts.counts_of(encoder, ["a", text, ""]) == [1, len(wanted), 0]
    assert "".join(bpe_codec.decoded(encoder, encoder.tokens(text))) == text


@pytest.mark.parametrize("data", [b"", b"abc", "é一🙂".encode(), b"\xff\xfea", b"\xe4\xb8", b"\xed\xa0\x80x", b"\xf0\x9f\x99", b"\xc3(", b"\xf4\x90\x80\x80", b"\xe0\x80\x80"])
def test_decoder_pieces(data):
    machine = bpe_codec.TextDecoder()
    out = "".join(machine.feed(data[n : n + 1]) for n in range(len(data))) + machine.finish()
    assert out == data.decode("utf-8", "replace")


def test_decode_broken_bytes_like_library(library):
    rnd = random.Random(8)
    for _ in range(300):
        ids = [rnd.randrange(50257) if rnd.random() < 0.5 else rnd.randrange(256) for _ in range(rnd.randrange(30))]
        mine = "".join(bpe_codec.decoded(bpe_machine.Encoder.of(PATH), [ids]))
        assert mine == library.decode(ids, skip_special_tokens=False)


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in pairs], "doc_id long, text string, n_tokens int, id string")


def test_operators_on_odd_rows(spark, library):
    pairs = [(1, "hello world"), (1, "hello world"), (None, "it's"), (2, None), (3, ""), (4, "<|endoftext|> ok " * 400)]
    docs = rows_of(spark, pairs)
    key = lambda x: (x is None, x)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in pairs}
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=lambda r: (key(r[0]), r[1:]))
    assert got == sorted(((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 1024) for i, t in pairs), key=lambda r: (key(r[0]), r[1:]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, bpe_codec.digests(docs, PATH).collect()), key=lambda r: (key(r[0]), r[1:]))
    assert got == sorted(((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(t or "")) for i, t in pairs), key=lambda r: (key(r[0]), r[1:]))
    back = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH)
    assert sorted((key(r[0]), r[1]) for r in back.collect()) == sorted((key(i), t or "") for i, t in pairs)
    assert token_counts.count_tokens(rows_of(spark, []), PATH).count() == 0
    assert bpe_codec.digests(rows_of(spark, []), PATH).count() == 0
