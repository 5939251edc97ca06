"""Token files against the tokenizer applied to whole texts, and keyed access."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from voxboard.llm.common import documents
from voxboard.llm.perfect_hash import PerfectHash
from voxboard.llm.token_files import Encoder, document_keys, write_tokens

PATH = tokenizer_path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
OWN = Encoder(PATH, kept=50)


def check(texts):
    got = [ids.tolist() for ids in OWN.encode(pa.array(texts, pa.string()))]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.text(st.sampled_from(list("ab'é.1 \n\t\x1c\x85\xa0 \U0001f600s<|")), max_size=30))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_the_whole(text):
    check([text])


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    check([text.encode("utf-8", "ignore").decode(), "", text.encode("ascii", "ignore").decode()])


def test_added_tokens_are_found_in_texts():
    check(["hello <|endoftext|> world", "a<|endoftext|>b c", "<|endoftext|>", "<|endof text|>", "plain", "", "x <|endoftext|"])
    assert [50256 in ids for ids in OWN.encode(pa.array(["x <|endoftext|> y", "<|endoftext"]))] == [True, False]


@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "<|", "|>", "\n", "  ", "endoftext"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_added_tokens_anywhere(parts):
    check(["".join(parts)])


def test_other_tokenizers_are_used_as_they_are():
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    own = Encoder(path)
    texts = ["Hello  World", "a b c", "É!"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in own.encode(pa.array(texts))] == want


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_perfect_hash(keys):
    keys = np.array(keys + keys[:2], np.uint64)
    function, slots = PerfectHash.build(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    again = PerfectHash.load(*function.dump())
    found = again.find(keys)
    assert (keys[np.argsort(slots)][found] == keys).all()


def expected(rows):
    out, start, seen = [], 0, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, 0)):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]
        copy = seen[doc] = seen.get(doc, -1) + 1
        out.append((doc, copy, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark):
    from voxboard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    want = [(d, s, n, c) for d, _, s, n, c in expected(rows)]
    df = QUERIES["op1_token_files"](spark, sf)
    assert dict(df.dtypes) == {c: "bigint" for c in ("doc_id", "start", "n_tokens", "ids_crc32")}
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()]
    assert sorted(got) == want


@pytest.mark.parametrize("block_ids", [1, 40, 1 << 20])
def test_repeats_nulls_and_long_texts(spark, block_ids):
    # Rows of one id have one text each, so that their order does not matter.
    rows = [((1 << 60) + 1, "large id"), (None, "nothing here")] + [(None, "nothing here")] * 39 + [(5, "same text")] * 30 + [(7, None), (8, ""), (9, "x  y\n\n z")]
    rows += [(i, f"word{i} " * (i % 7)) for i in range(100, 160)] + [(999, "very long " * 20000)]
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, shard int, ids string")
    files = write_tokens(df, PATH, shards=5, block_ids=block_ids)
    got = files.digests(files.lookup(document_keys(df))).collect()
    want = expected(rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_keyed_access(spark):
    rows = [(i, f"text number {i}") for i in range(50)]
    files = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shards=3, block_ids=16)
    keys = spark.createDataFrame([(7, 0), (49, 0), (7, 1), (1234, 0), (None, 0)], "id long, copy long")
    got = {(r.id, r.copy): r.token_ids for r in files.read(keys).collect()}
    assert got == {
        (i, 0): [*PLAIN.encode(f"text number {i}", add_special_tokens=False).ids, 2] for i in (7, 49)
    }


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    files = write_tokens(df, PATH)
    assert files.digests(files.lookup(document_keys(df))).count() == 0
