import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import queries, simple8b, token_counts, token_files

JSON = queries.tokenizer_file("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_str(JSON)
FAST = token_files.Encoder(JSON)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 60000), st.just(0), st.integers(0, 1), st.integers(2**60 - 1, 2**60 + 1)), max_size=400))
def test_simple8b_round_trip(values):
    words = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words).tolist() == values
    assert len(words) <= max(1, 2 * len(values))


def test_simple8b_is_dense():
    for count, bits in simple8b.LAYOUT.values():
        values = np.full(count * 5, (1 << bits) - 1, np.uint64)
        assert len(simple8b.encode(values)) == 5 and simple8b.decode(simple8b.encode(values)).tolist() == values.tolist()
    assert len(simple8b.encode(np.empty(0, np.uint64))) == 0 and len(simple8b.decode(np.empty(0, np.uint64))) == 0
    mixed = np.array([1] * 90 + [50000] + [3] * 33 + [0] * 300, np.uint64)
    greedy, at = 0, 0
    while at < len(mixed):
        at += max(n for n, b in simple8b.LAYOUT.values() if at + n <= len(mixed) and all(int(v) < 1 << b for v in mixed[at : at + n]))
        greedy += 1
    assert len(simple8b.encode(mixed)) == greedy


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text(alphabet="ab'stre vl\n \t\r\x0b\x1c\x85\xa0é1.,!", max_size=80), st.lists(st.text(alphabet="aé'sLl1.,\n", max_size=6), max_size=12).map(" ".join), st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=40), st.sampled_from(["<|endoftext|>", "I'll we've  \n\n x", "日本語 12", "  x"])), max_size=8))
def test_encoder_is_the_library(batch):
    flat, counts = FAST.encode_all(pa.array(batch, pa.string()))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in batch]
    assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "MAX_KNOWN", 3)
    own = token_files.Encoder(JSON)
    for batch in (["one two three four", "日本 one"], ["four two\nfive"], []):
        flat, counts = own.encode_all(pa.array(batch, pa.string()))
        want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in batch]
        assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))


def expected(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def rows_of(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "river", "Éa", "don't", "1984", "\n", "  ", "x" * 50, "日本"]
    rows = [(i * 7 - 100, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    rows += [(None, "no id"), (3000, None), (3001, ""), (3002, "long " * 40000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [10**6, 50])
def test_files_hold_every_document(spark, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    path = token_files.write(df, JSON)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    narrow = token_files.read(spark, path)
    assert "ids" not in narrow.columns and narrow.count() == len(rows)


def test_repeated_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (0, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_files.read(spark, token_files.write(df, JSON)).collect())
    assert got == [(0, 0, 2), (1, 2, 3), (1, 5, 3)]
    assert token_files.read(spark, token_files.write(df.limit(0), JSON)).collect() == []


@pytest.mark.parametrize("block", [1, 3, 64, 10**6])
def test_scan_finds_every_document(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for f in range(4):
        ids = [rng.choice([9, 1, 2, 70000]) for _ in range(rng.choice([0, 1, 40, 200]))] + [9] * rng.choice([0, 2])
        (tmp_path / f"part-{f}").write_bytes(np.array(ids, "<u4").tobytes() + b"\n" * rng.choice([0, 1]))
        start, k = 0, 0
        for at, x in enumerate(ids):
            if x == 9 or at == len(ids) - 1:
                want.append((f"part-{f}", k, start, at + 1 - start, x == 9))
                start, k = at + 1, k + 1
    got = sorted(map(tuple, token_counts.scan(spark, str(tmp_path), 9, 4, block).collect()))
    assert got == sorted(want)


def test_counts_match_the_vocabulary(spark):
    rows = rows_of(2)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    ranks = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    got = token_counts.count_tokens(df, ranks, public_tokenizers.PATTERN, 50256, block_ids=100).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, n) for i, _, n, _, _ in expected(rows)), key=str)
    place = {}
    for r in sorted(got, key=lambda r: (r.part, r.place)):
        k, start = place.get(r.part, (0, 0))
        assert (r.place, r.start) == (k, start)
        place[r.part] = (k + 1, start + r.n_tokens)
    twice = spark.createDataFrame([(1, "a"), (1, "a b c")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts.count_tokens(twice, ranks, public_tokenizers.PATTERN, 50256).collect()) == [2, 4]
    assert token_counts.count_tokens(twice.limit(0), ranks, public_tokenizers.PATTERN, 50256).collect() == []


def test_long_runs_of_white_space():
    encode = token_counts.encoder(queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("a" + " " * 30000 + "b", "\n" * 25000, "x  " + "\t \n" * 9000 + "end " + " " * 21000, "\u3000" * 20001 + "'s", "a" * 30000, " " * 19999 + "b"):
        assert encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(encode(" " * 2_000_000)) > 0 and len(encode("a" + "\n" * 2_000_000 + "b")) > 2


def test_rolling_files_and_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FILE_BYTES", 200)
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 2)
    rows = [(i if i is None else f"id {i}\n/%", t) for i, t in rows_of(3)] + [("", "empty id"), ("7", " " * 50_000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id string, text string, chunk int").repartition(2)
    ranks = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    counted = token_counts.count_tokens(df, ranks, public_tokenizers.PATTERN, 50256, block_ids=64).collect()
    want = {(i, n) for i, t in rows for n in [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1]}
    assert len(counted) == len(rows) and {(r.doc_id, r.n_tokens) for r in counted} == want and max(r.chunk for r in counted) > 2
    got = token_files.read(spark, token_files.write(df, JSON), True, "string").orderBy("start").collect()
    order = sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.doc_id for r in got] == order and {(r.doc_id, r.n_tokens) for r in got} == want and max(r.roll for r in got) > 2
    assert [r.start for r in got[1:]] == list(np.cumsum([r.n_tokens for r in got])[:-1])
