import html
import math
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import catalogue
from corvane.functions import ipc
from corvane.functions import text as t

ONCE = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
STRINGS = st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="İ"), max_size=20), st.sampled_from(["a &amp; b", "&lt;", "  x\x1c", "2024-01-31", "20240131", "2024013", "IN201841002345B1", "Tata & Sons (P) Ltd.", "éco co"])), min_size=1, max_size=12)


def col(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def clean(s):
    return re.sub(r"\s+", " ", html.unescape(s or "")).strip()


@ONCE
@given(STRINGS)
def test_cleaning(spark, values):
    got = col(spark, values, t.clean_text(F.col("s")), t.norm_date(F.col("s")), t.tokens(F.col("s")), t.org_form(F.col("s")), t.patent_key(F.col("s")))
    for v, (text, date, tokens, form, key) in zip(values, got):
        c = clean(v)
        assert text == c
        m = re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", c, re.A)
        assert date == ("-".join(m.groups()) if m else c)
        assert tokens == re.findall("[a-z0-9]+", (v or "").lower())
        assert form == re.sub(r"\s+", " ", re.sub(r"[.,()\"'&/\\-]", " ", (v or "").lower())).strip()
        raw = re.sub("[^A-Z0-9]", "", (v or "").upper())
        m = re.match(r"^(.*\d)([A-Z]\d?)$", raw)
        assert key == ((m[1] if m and len(m[1]) >= 8 else raw) or None)


@pytest.mark.parametrize("values,want", [([" a ", "b", "a", "", None, "&lt;"], ["a", "b", "<"]), ([], []), (None, []), ([""], [])])
def test_lists(spark, values, want):
    assert spark.createDataFrame([(values,)], "v array<string>").select(t.clean_list(F.col("v"))).first()[0] == want


def test_record_ids(spark):
    rows = [(" AB 1 ", "s", "u"), ("", "s", "u"), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, s string, u string").select(t.record_id(F.col("a"), F.col("s"), F.col("u"))).collect()]
    assert got == ["AB 1", "s-aec9a4ede6", "src-" + __import__("hashlib").sha1(b"None|None").hexdigest()[:10]]


@pytest.mark.parametrize("text,term,hit", [("éco x", "co", False), ("co-op", "co", True), ("a co", "co", True), ("_co", "co", False), ("c++ x", "c++", False), ("xc++y", "++", True), ("日co", "co", False)])
def test_whole_words(spark, text, term, hit):
    assert spark.range(1).select(F.lit(text).rlike(t.whole_word(term))).first()[0] is hit


def test_dates_slugs_texts(spark):
    got = col(spark, ["31/12/2025", "1/2/2025", None], t.day_first_date(F.col("s")))
    assert [g[0] for g in got] == ["2025-12-31", "", ""]
    assert spark.range(1).select(t.file_slug(F.lit("38/2026"), F.lit(" Part I (a) "))).first()[0] == "38-2026_Part-I-a"
    items = spark.createDataFrame([([("de", "Eis"), ("en", "ice")],), ([("de", "Eis")],), ([],)], "x array<struct<lang:string,text:string>>")
    assert [r[0] for r in items.select(t.preferred_text(F.col("x"))).collect()] == ["ice", "Eis", ""]


@pytest.mark.parametrize(
    "text,codes",
    [
        ("C22B\n3/04, 3/06", ["C22B 3/04"]),
        (":F01K23/06 A61K0031443900", ["F01K 23/06", "A61K 31/4439"]),
        ("H01M C12Q0001700000 H01F", ["H01M", "C12Q 1/70", "H01F"]),
        ("B09B 3/00, B09B 3/00", ["B09B 3/00"]),
        ("1/02 none", []),
        ("", []),
        (None, []),
    ],
)
def test_classification_codes(spark, text, codes):
    assert spark.createDataFrame([(text,)], "s string").select(ipc.ipc_codes(F.col("s"))).first()[0] == codes


def test_code_lines(spark):
    lines = ["C22B", "3/04,", "C22B 3/04, H01M 10/54", "1)Anna Name", "C22B 3/04 x", ""]
    assert [g[0] for g in col(spark, lines, ipc.only_codes(F.col("s")))] == [True, True, True, False, False, False]


def test_sizes_as_sql_prints_them(spark, tmp_path):
    # Ties that a binary fraction meets exactly (20971.52 * 10 ** 8 bytes are 1953.125 GB), values whose shortest digits look like ties, and no value.
    prices = [20971.52, 62914.56, 104857.6, 0.0, 12345.67, -20971.52, 1e9, 1.005 * 10.73741824, 1e25, None, math.nan, math.inf, -math.inf]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = [tuple(r) for r in catalogue.QUERIES["human_size"](spark, str(tmp_path)).orderBy("o_orderkey").collect()]
    assert got == db.execute(f"{catalogue.ORACLES['human_size']} ORDER BY o_orderkey").fetchall()
    assert got[0][1] == "1953.12 GB" and got[9][1] is None
