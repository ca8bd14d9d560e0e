import math
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from corvane.llm import queries, simhash, spotsigs

CONTRACT = {
    "op1": ["doc_id", "fingerprint", "component_id"],
    "op2": ["page_id", "host", "path", "rule", "verdict"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["page_id", "url", "text", "n_chars"],
    "op5": ["doc_id", "n_pieces", "decoded_equal"],
    "op6": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8": ["doc_id", "size", "source_size", "target", "taken"],
    "op9": ["doc_id", "n_tokens"],
    "op10": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op13": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}
#: Queries that don't give one row for each of a table's.
OTHERS = {
    "op11": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op12": ["lang", "source", "part", "item", "value", "rank"],
}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows_of(spark, sf_dir, op):
    name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
    return queries.QUERIES[name](spark, sf_dir)


def test_there_is_one_query_for_each():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("op", CONTRACT)
def test_every_row_is_answered(spark, sf_dir, op):
    df = rows_of(spark, sf_dir, op)
    assert set(CONTRACT[op]) <= set(df.columns)
    source, key = ("pages", "page_id") if CONTRACT[op][0] == "page_id" else ("documents", "doc_id")
    ids = sorted(r[0] for r in df.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).collect())


@pytest.mark.parametrize("op", OTHERS)
def test_other_columns(spark, sf_dir, op):
    df = rows_of(spark, sf_dir, op)
    assert df.columns == OTHERS[op] and df.schema["rank"].dataType.simpleString() == "int" and df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = db.execute(queries.ORACLES[name])
    named = [d[0] for d in result.description]
    want = sorted(repr(tuple(dict(zip(named, r))[c] for c in columns)) for r in result.fetchall())
    assert sorted(named) == columns and sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want


def test_fingerprints_and_components(spark, sf_dir, documents):
    got = {r.doc_id: r for r in rows_of(spark, sf_dir, "op1").collect()}
    fps = {i: int.from_bytes(simhash.fingerprint(d.text.encode()), "big") for i, d in documents.items()}
    assert all(int(got[i].fingerprint, 16) == f for i, f in fps.items())
    group = {i: i for i in fps}
    for a in sorted(fps):
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    assert {i: r.component_id for i, r in got.items()} == group


def test_token_files_match_the_library(spark, sf_dir, documents):
    library = Tokenizer.from_str(queries.tokenizer_file("byte_bpe_50k.json"))
    start, want = 0, {}
    for i in sorted(documents):
        ids = [*library.encode(documents[i].text, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, sf_dir, "op6").collect()} == want
    assert {r.doc_id: r.n_tokens for r in rows_of(spark, sf_dir, "op9").collect()} == {i: n for i, (_, n, _) in want.items()}


def test_mix_is_near_its_targets(spark, sf_dir, documents):
    rows = rows_of(spark, sf_dir, "op8").collect()
    taken, target, largest = {}, {}, {}
    for r in rows:
        s = documents[r.doc_id].source
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        largest[s] = max(largest.get(s, 0), r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken) and math.isclose(sum(target.values()), sum(r.size for r in rows))


def test_likeness_follows_the_texts(spark, sf_dir, documents):
    order = sorted(documents)
    for r in rows_of(spark, sf_dir, "op10").collect():
        following = documents[order[(order.index(r.doc_id) + 1) % len(order)]].text
        own, other = spotsigs.signatures(documents[r.doc_id].text), spotsigs.signatures(following)
        assert r.near_next == len(own & other) / len(own | other) and r.fingerprint == spotsigs.digest_of(own)


def test_pieces_decode(spark, sf_dir):
    assert rows_of(spark, sf_dir, "op5").where("not decoded_equal").count() == 0
