import hashlib
import json
import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import TEXTS, awkward, empty
from zonewright.llm.byte_pairs import BytePairs, TokenBytes, decode_documents, encode_documents, vocabulary_file
from zonewright.llm.common import BYTE_VOCABULARY, tokenizer_file
from zonewright.llm.queries import op12_bpe_codec

PATH = tokenizer_file(BYTE_VOCABULARY)
HARD = [
    "",
    " ",
    "  a  b   ",
    "\n\n \t x\r\n y\x0b\x0c",
    "don't we'll I'VE you're 'tis 'sssss",
    "a<|endoftext|>b <|endoftext|><|endoftext|> c<|endof",
    "\x1c \x1d\x1e a\x1fb\x00\x7f",
    "\x85\xa0  x　​ y﻿",
    "日本語 テキスト １２３ ½ ² Ⅷ",
    "é é नमस्ते 👩‍👩‍👧 🇩🇪",
    "aaaaaaa" * 50,
    "x" * 5000 + " " * 3000 + "1" * 777,
    "#!@$%^&*()_+ --- === ... ,,, \\\\ //",
]


LIBRARY = Tokenizer.from_file(PATH)
TOKENS = TokenBytes(vocabulary_file(PATH))


def by_library(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(x: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(x) // 4}I", x))


def test_words_as_if_merged_alone():
    model, rng, library = BytePairs(PATH), random.Random(5), LIBRARY
    random_texts = ["".join(rng.choice("theinanr  \n'sEé1日!") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for some in (HARD, random_texts, HARD + random_texts[:100]):
        got = list(model.encode_texts(some))
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [ids(x) for x in got] == want
        assert [TOKENS.decode(x).decode() for x in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_index_of_pairs():
    model = BytePairs(PATH)
    words = [b"the", b"then", b"in"]
    flat = model.first[list(b"".join(words))]
    last = np.array([i in (2, 6, 8) for i in range(9)])
    got = {(TOKENS.bytes_of[model.left[r]], TOKENS.bytes_of[model.right[r]]): p for r, p in model.index(flat, last).items()}
    assert got[b"h", b"e"] == [1, 4] and got[b"i", b"n"] == [7] and (b"e", b"t") not in got and (b"n", b"i") not in got
    assert model.encode_words([]) == [] and model.encode_words([b"", b"a"])[0] == b""


def test_every_character_is_cut_as_the_library_cuts_it():
    model, library = BytePairs(PATH), LIBRARY.pre_tokenizer
    for at in range(0, 0x20000, 64):
        some = "".join(f"a{chr(c)}1 {chr(c)}  " for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert model.pre_tokens(some) == [some[i:j] for _, (i, j) in library.pre_tokenize_str(some)]
    known = [c for c in "\x85\xa0éßÖñ日本 \u3000½①" if c in model.agreed]
    assert len(known) > 10 and "\u0558" not in model.agreed


def test_broken_ids_and_vocabularies(tmp_path):
    model = BytePairs(PATH)
    lone = struct.pack("<3I", *(int(model.first[b]) for b in (0xE6, 0x41, 0xFF)))
    assert TOKENS.decode(lone).decode() == LIBRARY.decode(ids(lone), skip_special_tokens=False)
    spec = json.load(open(PATH))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "turned.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="ascending"):
        BytePairs(str(tmp_path / "turned.json"))


def test_documents_against_the_library(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op12_bpe_codec(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        want = by_library(rows[r.doc_id] or "")
        sha = hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha, hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted((str(r.doc_id), ids(r.ids), r.decoded) for r in decode_documents(encode_documents(docs, PATH), PATH).collect())
    assert got == sorted((str(i), by_library(t or ""), t or "") for i, t, _, _ in TEXTS)
    assert decode_documents(encode_documents(empty(spark), PATH), PATH).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62E6' AS STRING) AS text")
    assert [ids(r.ids) for r in encode_documents(bad, PATH).collect()] == [by_library("a�b�")]
