import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from radiolake.llm import pieces
from tests.llm.helpers import docs_table

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = st.text(st.sampled_from("aetho Theré ▁  \n\t\x01<s>0x41日本😀ñ") | st.characters(codec="utf-8"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_equals_the_library(texts):
    ids, counts, agrees = pieces.encode_texts(pa.array(texts, pa.string()), PATH)
    expected = LIBRARY.encode(texts)
    assert ids.tolist() == [i for e in expected for i in e]
    assert counts.tolist() == [len(e) for e in expected]
    assert agrees.all()
    model, _ = pieces._model(PATH)
    assert model.decode(ids, counts).to_pylist() == [LIBRARY.decode(e) for e in expected]


def test_heap_and_list_agendas_agree():
    model, _ = pieces._model(PATH)
    for chunk in (" " + "then" * 40, " ththththa" * 7, "    " * 20):
        symbols = list(chunk.replace(" ", pieces.MARK))
        assert model._merge_long(list(symbols)) == model._merge_short(list(symbols))


def test_columns_nulls_and_empty_tables(spark):
    docs = docs_table(spark, ["Hello  world", None, "", "x" * 5000, "same", "same"]).withColumnRenamed("source", "ids")
    rows = {r.doc_id: r for r in pieces.encode(docs, PATH, decoded_col="decoded").collect()}
    for i, text in enumerate(["Hello  world", "", "", "x" * 5000, "same", "same"]):
        assert list(rows[i].ids) == LIBRARY.encode(text) and rows[i].decoded == text and rows[i].agrees
    again = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted(r.decoded for r in again) == sorted(["Hello  world", "", "", "x" * 5000, "same", "same"])
    assert pieces.encode(docs.where("doc_id > 9"), PATH).count() == 0


def test_single_bytes_decode_one_by_one():
    model, _ = pieces._model(PATH)
    import numpy as np

    ids = np.array([model.byte_id[b] for b in b"\xe6\x97a\xff"])
    assert model.decode(ids, np.array([4])).to_pylist() == [LIBRARY.decode(ids.tolist())]
