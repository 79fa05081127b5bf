"""Operators 2 and 9: against the tokenizer libraries on whole texts."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from ferrule.llm import common as C
from ferrule.llm import op2_bitpack as pack
from ferrule.llm import op9_bpe as bpe

EDGE = [None, "", " ", "\n\n", "'s", "a's't're ''s", "  two  spaces ", "x" * 5000, "é́̈ İ ΣΑΣ ß ÷×", "<|endoftext|> <|EndOfText|>",
        "1234 12,5% 字字 　 \x85\x1c", "tab\tnew\nline  nbsp", "a" * 70 + " " + "ab" * 60, "same", "same"]


def some_texts(n, seed):
    rng = random.Random(seed)
    parts = list(" \n\t'strevmld aé9٣!?’字xÉ×ς") + ["'ll", "  ", "the ", "<|", "|>", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, make_docs, tiktoken_encoding):
    texts = EDGE + some_texts(1500, 1)
    got = bpe.encode(make_docs(texts), P.path(bpe.VOCABULARY), ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        want = tiktoken_encoding.encode_ordinary(text)
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_cuts_for_every_kind_of_code_point(tiktoken_encoding):
    own = bpe.codec(P.path(bpe.VOCABULARY))
    points = [*range(1, 0x3000), *range(0x3000, 0xD800, 97), *range(0xE000, 0x110000, 997)]
    texts = ["a" + chr(c) + "b 1" + chr(c) + "2 !" + chr(c) + "! " + chr(c) for c in points]
    for c in C.chunks(pa.array(texts)):
        ids, first = own.encode(c)
        for k, r in enumerate(c.rows.tolist()):
            assert ids[first[k] : first[k + 1]].tolist() == tiktoken_encoding.encode_ordinary(texts[r])


def test_bpe_empty_table(no_docs):
    assert bpe.encode(no_docs, P.path(bpe.VOCABULARY)).count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip_and_ranges(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 777, dtype=np.uint64).astype(np.uint32)
    payload = pack.pack(ids, width)
    assert len(payload) == pack.HEADER.size + 13 * 8 * width
    assert (pack.unpack(payload) == ids).all()
    for a, b in ((0, 1), (63, 65), (100, 777), (5, 5), (770, 9999)):
        assert (pack.unpack(payload, a, b) == ids[a:b]).all()


def test_pack_refuses_wide_ids():
    with pytest.raises(ValueError):
        pack.pack(np.array([8]), 3)


def test_files_equal_library(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    texts = EDGE + some_texts(800, 2)
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    rows = [(10 * k, texts[k]) for k in order]
    path = str(tmp_path / "packed")
    pack.write(make_docs(rows).repartition(7), path, P.path(pack.VOCABULARY), block_ids=2000)
    got = {r["doc_id"]: r for r in pack.read(spark, path).collect()}
    library = Tokenizer.from_file(P.path(pack.VOCABULARY))
    start = 0
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids + [pack.END_ID]
        r = got[10 * k]
        assert (r["start"], r["n_tokens"]) == (start, len(want)), text
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        start += len(want)
    one = pack.read_tokens(spark, path, 70)
    assert [x.tolist() for x in one] == [library.encode(texts[7], add_special_tokens=False).ids + [pack.END_ID]]


def test_files_with_repeated_and_null_ids_and_empty_table(spark, make_docs, no_docs, tmp_path):
    rows = [(5, "b"), (5, "a"), (None, "n"), (5, "a"), (1, None)]
    path = str(tmp_path / "ties")
    pack.write(make_docs(rows), path, P.path(pack.VOCABULARY))
    got = pack.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 5, 5, 5]
    assert [r["n_tokens"] for r in got] == [2, 1, 2, 2, 2]
    path = str(tmp_path / "none")
    pack.write(no_docs, path, P.path(pack.VOCABULARY))
    assert pack.read(spark, path).count() == 0


def test_word_table_stays_bounded_whatever_the_words():
    import numpy as np

    from ferrule.llm import op9_bpe as bpe

    table = bpe.WordTable(lambda words: ([b for w in words for b in w], [len(w) for w in words]))
    rng = np.random.default_rng(0)
    for size in (200, 200, 12, 12, 64, 65):
        for _ in range(4):
            data = rng.integers(97, 123, 5000 * size, dtype=np.uint8)
            starts = np.arange(0, len(data), size)
            ids, counts = table.expand(data, starts, starts + size)
            assert (counts == size).all() and (ids == data).all()
            held = sum(map(len, table.place)) + 4 * len(table.ids) + bpe.WORD_COST * len(table.place)
            assert held == table.size and held <= bpe.CACHE_BYTES + 5000 * (size * 5 + bpe.WORD_COST)
        if size == 200:
            assert not table.place and not len(table.ids)  # long words are never kept
    mixed = np.frombuffer(b"ab" * 40 + b"ab" + b"c" * 70, np.uint8)
    ids, counts = table.expand(mixed, np.array([0, 80, 82, 0]), np.array([80, 82, 152, 80]))
    assert counts.tolist() == [80, 2, 70, 80] and bytes(ids.astype(np.uint8)) == b"ab" * 41 + b"c" * 70 + b"ab" * 40
