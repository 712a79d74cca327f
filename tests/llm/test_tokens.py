"""Token counts and token files against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusaudit.llm import token_files
from corpusaudit.llm.token_counts import counter, token_counts
from corpusaudit.llm.token_files import Encoder, pack, read_token_files, unpack, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", " ", " ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "The", "é", "ß", "1", "23", ".", "'s", "'", "!", "漢", "<|endoftext|>", "́", "𝔘", "\0", "٣", "Ⅷ", "²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts(library):
    count, encode = counter(PATH), Encoder(PATH)
    for t in texts(4000):
        want = library.encode(t, add_special_tokens=False).ids
        assert count(t) == len(want), t
        assert np.frombuffer(encode(t), np.uint32).tolist() == want, t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    sample = ["", "Hello there, world!", "a  b\n", "été 漢"]
    if name.endswith("json"):
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in sample]
    else:
        import sentencepiece

        want = list(map(len, sentencepiece.SentencePieceProcessor(model_file=path).encode(sample)))
    assert [counter(path)(t) for t in sample] == want


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_blocks(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 200:
        ids[::50] = 2**32 - 1  # outliers
    row = pack(ids)
    assert (unpack(row)[:n] == ids).all()
    if n > 1000:
        assert (unpack(row, 2, 5) == ids[256:640]).all()


def rows():
    return [*enumerate(texts(60, 3)), (100, None), (101, ""), (102, "word " * 40_000), (None, "no id"), (7, "again"), (100, None), (-5, "first")]


def test_counts(docs_of, library):
    got = token_counts(docs_of(rows()), PATH, limit=5).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t in rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(docs_of([(1, "a")]).where("doc_id > 1"), PATH).collect() == []


def test_files(spark, docs_of, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 200)
    path = f"{tmp_path}/tokens"
    write_token_files(docs_of(rows()), path, PATH, 2)
    got = read_token_files(spark, path).collect()
    known = {}
    for i, t in rows():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        known.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((i for i, _ in rows()), key=lambda i: (i is not None, i))
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    for i, want in known.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) == sorted(want)
    empty = f"{tmp_path}/empty"
    write_token_files(docs_of([(1, "a")]).where("doc_id > 1"), empty, PATH, 2)
    assert read_token_files(spark, empty).collect() == []
