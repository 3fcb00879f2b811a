import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from radiolake.llm import rangecoder, tokens
from radiolake.session import scratch_path
from tests.llm.helpers import docs_table, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000, 40_000])
@pytest.mark.parametrize("vocabulary", [1, 2, 49_408, 1 << 17])
def test_round_trip(n, vocabulary):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n) - 1, vocabulary - 1).astype(np.int64)
    got, rows, n_rows = rangecoder.unpack_block(rangecoder.pack_block(ids, b"rows", 3, vocabulary))
    assert (got == ids).all() and rows == b"rows" and n_rows == 3


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(1).integers(0, 49_408, 500), 200)
    assert len(rangecoder.pack_block(ids, b"", 0, 49_408)) < len(ids) / 2


def test_damage_is_found():
    block = rangecoder.pack_block(np.arange(2000), b"x", 1, 3000)
    for bad in (block[:-1], block[:10], block[:60] + bytes([block[60] ^ 1]) + block[61:], b""):
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.unpack_block(bad)


TEXTS = st.text(st.sampled_from("aB'sé 7,.\n\t\x7f<|endoftxXÅ̊́ …€Σσß 日") | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_chunks_equal_the_library_on_whole_texts(texts):
    import pyarrow as pa

    library = Tokenizer.from_file(PATH)
    ids, counts, _ = tokens.encode_texts(pa.array(texts, pa.string()), PATH)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for e in expected for i in e]
    assert counts.tolist() == [len(e) for e in expected]


def test_files_hold_whole_documents_in_order(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 9)) for _ in range(50)] + [None, "", "<|endoftext|> it's", prose(rng, 900)]
    ids = random.Random(3).sample(range(1000), len(texts) - 1) + [None]
    docs = docs_table(spark, texts, ids).withColumnRenamed("lang", "block")
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(docs, path, PATH, 2, block_tokens=300, partitions=3)
    rows = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(PATH), 0
    ordered = sorted(zip(ids, texts, strict=True), key=lambda x: -1 if x[0] is None else x[0])
    assert [r.doc_id for r in rows] == [i for i, _ in ordered]
    for row, (_, text) in zip(rows, ordered, strict=True):
        own = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens) == (at, len(own))
        assert zlib.crc32(row.ids) == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        at += len(own)


def test_empty_table_and_repeated_rows(spark):
    docs = docs_table(spark, ["a b", "a b", "c"], [1, 1, 1])
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(docs, path, PATH, 2)
    assert sorted(r.start for r in tokens.read_tokens(spark, path).collect()) in ([0, 3, 6], [0, 2, 5])
    tokens.write_tokens(docs.where("doc_id > 1"), path + "-none", PATH, 2)
    assert tokens.read_tokens(spark, path + "-none").count() == 0
