"""What the pipeline's last stage hands on."""

import hashlib
from array import array

import public_tokenizers
import sentencepiece

import corpus_pipeline


def test_last_stage_keeps_ids_and_decoded_texts(spark):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["The  cat sat", None, "é日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in corpus_pipeline.pieces(spark, df, "").collect():
        ids = p.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == p.decode(ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()


def test_rows_are_passed_on_in_parts(spark, monkeypatch):
    from tieout.llm import piece_codec

    texts = ["a b c", "", "the cat " * 50, None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sorted(map(tuple, piece_codec.encode_decode(df, path, keep=True).collect()))
    monkeypatch.setattr(piece_codec, "PASSED_ON", 3)
    batches = piece_codec.encode_decode(df, path, keep=True)
    assert sorted(map(tuple, batches.collect())) == whole and len(whole) == 5
    assert piece_codec.encode_decode(df.limit(0), path, keep=True).count() == 0
