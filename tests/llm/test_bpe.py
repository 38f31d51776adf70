"""Encoding against the tokenizers library; decoding as a round trip."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from panelrisk.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "!", "<|endoftext|>", "\x1c", "\x85", " ", "日本", "𝄞", "word,", " "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    out += ["a" * 5000, "*#" * 3000, "the quick brown " * 3000, "", " ", "x " * 400, "thequick" * 500]
    return out


def test_encoder_equals_library(library, tmp_path):
    tables = bpe.Tables(PATH)
    all_texts = texts()
    words = sorted({(" " + u).encode() for t in all_texts for u in (bpe.units(t) or [])[1:] if len(u) < 20})
    exact = bpe.Encoder(tables, None)
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_lexicon(words, [exact.merged(w.decode()) for w in words]))
    encoder = bpe.Encoder(tables, bpe.Transducer(str(file)))
    for text, ids in zip(all_texts, encoder.encode(all_texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_transducer_shares_suffixes_and_numbers_words(tmp_path):
    words = sorted(f" {a}{b}".encode() for a in ("over", "under", "out") for b in ("ing", "ed", "s", ""))
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_lexicon(words, [[i, i] for i in range(len(words))]))
    t = bpe.Transducer(str(file))
    assert t.numbers(words).tolist() == list(range(len(words)))
    assert t.numbers([b"", b" ove", b" overx", b"out", b" outs "]).tolist() == [-1] * 5
    assert len(t.final) < sum(map(len, words)) / 2


def test_query_rows(docs_of, library):
    rows = [(1, "Hello world, hello  world"), (2, None), (3, ""), (1, "Hello world, hello  world"), (None, "ñandú 123")]
    got = bpe.encode_decode(docs_of(rows), PATH, keep_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: rows[0][1], 2: "", 3: "", None: "ñandú 123"}[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(docs_of([]), PATH).count() == 0


def test_words_merged_side_by_side_equal_words_alone():
    tables = bpe.Tables(PATH)
    rng = random.Random(5)
    data = [bytes(rng.choice(b" etaoinshrdl.,0\xc3\xa9") for _ in range(rng.randint(0, 60))) for _ in range(9000)]
    data += [b" the", b" there", b"aaaaaaaa", b""] * 20
    assert tables.words(data) == [np.array(tables.word(w), "<u4").tobytes() for w in data]
    assert tables.words(data[:5]) == [np.array(tables.word(w), "<u4").tobytes() for w in data[:5]]


def test_compiling_holds_states_and_no_node_of_every_word():
    words = sorted(f" {i:05d}abcdefghijklmnopqrstuvwxyzabcdefghijkl".encode() for i in range(4000))
    ids = [[i] for i in range(len(words))]
    tracemalloc.start()
    bpe.compile_lexicon(words, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000, peak


def test_learning_does_not_go_through_what_is_known():
    class Known(dict):
        def keys(self):
            raise AssertionError("goes through the whole cache")

    encoder = bpe.Encoder(bpe.Tables(PATH), None)
    encoder.cache = Known()
    assert len(list(encoder.encode(["one two three", "one two four"]))) == 2
