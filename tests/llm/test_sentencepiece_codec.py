import random
import unittest.mock
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import sentencepiece_codec as c

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    MODEL = f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
PLAIN, VARIED = c.Codec(MODEL, dropout=0), c.Codec(MODEL, dropout=0.3)
TEXT = st.one_of(
    st.text(max_size=60),
    st.text(alphabet="abceinorst \n\t▁é日😀", max_size=60),
    st.lists(st.sampled_from(["the", "mountain", "unbelievable", "Überraschung", "   ", "\n", "aaaaaaaaaa", "▁", "of"]), max_size=15).map(" ".join),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_without_dropout_it_is_the_library(batch):
    batch = [t.replace("▁", " ") for t in batch]
    assert [x.tolist() for x in PLAIN.encode_all([b"x"] * len(batch), batch)] == LIBRARY.encode(batch)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(0, 3))
def test_decoding_gives_the_text_back(batch, name):
    for codec in (PLAIN, VARIED):
        assert [codec.decode(x) for x in codec.encode_all([str(name).encode()] * len(batch), batch)] == batch


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abceinorst▁é日", min_size=1, max_size=40), min_size=1, max_size=8))
def test_rounds_and_agenda_agree(chunks):
    for codec in (PLAIN, VARIED):
        keys = codec.chunk_keys(chunks)
        flat, ends = codec.segment(chunks, keys)
        begin = 0
        for chunk, key, end in zip(chunks, keys.tolist(), ends.tolist(), strict=True):
            assert flat[begin:end].tolist() == codec.segment_by_agenda(chunk, key)
            begin = end


def plain_merges(codec, chunk, key):
    """The definition, without agenda or arrays: merge the best pair that is not dropped until there is none."""
    spans = [(i, i + 1, codec.piece_id.get(x)) for i, x in enumerate(chunk)]
    while True:
        best = None
        for k in range(len(spans) - 1):
            (a, b, left), (_, d, right) = spans[k], spans[k + 1]
            m = codec.piece_id.get(chunk[a:d]) if left is not None and right is not None else None
            if m is not None and not codec.skipped(np.uint64(key), a, b, d) and (best is None or codec.rank[m] < codec.rank[best_piece]):
                best, best_piece = k, m
        if best is None:
            return [x for a, b, p in spans for x in ([p] if p is not None else [int(codec.byte_ids[y]) for y in chunk[a:b].encode()])]
        spans[best : best + 2] = [(spans[best][0], spans[best + 1][1], best_piece)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abceinorst▁é日", min_size=1, max_size=25))
def test_agenda_follows_the_definition(chunk):
    for codec in (PLAIN, VARIED):
        key = int(codec.chunk_keys([chunk])[0])
        assert codec.segment_by_agenda(chunk, key) == plain_merges(codec, chunk, key)


def test_long_chunks(monkeypatch):
    rng = random.Random(4)
    chunks = ["".join(rng.choice("abcdeinorst") for _ in range(n)) for n in (255, 256, 257, 3000)]
    keys = VARIED.chunk_keys(chunks)
    flat, ends = VARIED.segment(chunks, keys)
    assert "".join(VARIED.raw[i].decode() for i in flat.tolist()) == "".join(chunks) and len(ends) == 4
    monkeypatch.setattr(c, "LONG_CHUNK", 10**6)
    again, _ = VARIED.segment(chunks, keys)
    assert again.tolist() == flat.tolist()


def test_seeds_and_documents_vary_and_reruns_agree():
    text = "The mountain was unbelievable and the mountain was wonderful again. " * 20
    runs = {(seed, name): tuple(c.Codec(MODEL, seed, 0.2).encode_all([name], [text])[0].tolist()) for seed in (1, 2) for name in (b"1", b"2")}
    assert len(set(runs.values())) == 4
    assert runs[1, b"1"] == tuple(c.Codec(MODEL, 1, 0.2).encode_all([b"1"], [text])[0].tolist())
    few = len(PLAIN.encode_all([b"1"], [text])[0])
    assert all(len(r) > 1.05 * few for r in runs.values())


def test_a_word_varies_with_every_place():
    text = " ".join(["unbelievable"] * 2000 + ["x" * 40])
    ids = VARIED.encode_all([b"1"], [text])[0].tolist()
    words = "".join("|" * VARIED.raw[i].startswith(b" ") + str(i) + "," for i in ids).split("|")
    assert len(set(words)) > 20


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.sampled_from([1, 16]))
def test_each_place_follows_its_own_key(batch, least):
    digest = lambda x: int.from_bytes(xxhash.xxh64_digest(x, VARIED.seed), "big")
    names = [str(i).encode() for i in range(len(batch))]
    with unittest.mock.patch.object(c, "PATTERN_PLACES", least):
        found = VARIED.encode_all(names, batch)
    for name, text, got in zip(names, batch, found, strict=True):
        want = []
        for place, chunk in enumerate(VARIED._split(text)):
            key = c.mix(VARIED.chunk_keys([chunk]) ^ c.mix(np.array([place ^ digest(name)], np.uint64)))
            want += VARIED.segment_by_agenda(chunk, int(key[0]))
        assert got.tolist() == want


@pytest.mark.parametrize("dropout", [0.0, 0.1])
def test_documents(spark, dropout):
    rows = [(1, "The river is long.\nAnd wide.", 0), (2, None, 0), (3, "", 0), (None, "no id ▁ here", 0), (1, "The river is long.\nAnd wide.", 0), (5, "word " * 30000 + "x" * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = c.encode_documents(df, MODEL, dropout=dropout)
    got = out.collect()
    assert len(got) == len(rows) and all(r.decoded_equal for r in got)
    assert [r.n_chars for r in got] == [len(t or "") for _, t, _ in rows] and [r.n_pieces for r in got] == [len(r.ids) for r in got]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert got[0] == got[4] and got[1].ids == got[2].ids == []
    assert [r.text for r in c.decode_documents(out, MODEL).collect()] == [t or "" for _, t, _ in rows]
    if not dropout:
        assert got[0].ids == LIBRARY.encode(rows[0][1])
    assert c.encode_documents(df.limit(0), MODEL).collect() == []
