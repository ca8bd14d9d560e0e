"""Landed files by record marks: the same pieces at any split size, equal to the readers of whole files, in batch and as a stream."""

import io
import json
import random
import time

import pyarrow.fs as pafs
import pytest
import regex
from pyspark.sql import functions as F

from corvane import catalogue, catalogue_formats
from corvane.sources import journal, landed, readers
from test_sources import BIBLIO, CARDS, EXPORT, JOURNAL, TORN


def whole(text: bytes, mark: bytes):
    starts = [m.start() for m in regex.finditer(mark, text)]
    return [(a, text[a:b]) for a, b in zip(starts, [*starts, len(text)][1:], strict=True)]


def test_pieces_at_any_split_size(monkeypatch):
    r = random.Random(5)
    foot = b"The Patent Office Journal No. 38/2026 Dated 18/09/2026 101"
    bits = [b"(12)", b" ", b"\n\f", b"PATENT APPLICATION PUBLICATION", b"PATENT", b"(1", "é ".encode(), b"x" * 7, foot, foot + b"\n", b"(12) PATENT APPLICATION PUBLICATION"]
    for _ in range(60):
        text = b"".join(r.choice(bits) for _ in range(r.randint(0, 60)))
        want = whole(text, landed.MARKS["journal"])
        for step, chunk in ((1, 1), (3, 5), (17, 2), (64, 1 << 20), (10_000, 7)):
            monkeypatch.setattr(landed, "CHUNK", chunk)
            got = [p for at in range(0, len(text), step) for p in landed.pieces(io.BytesIO(text), at, min(len(text), at + step), landed.MARKS["journal"])]
            assert got == want


def test_lines_at_any_split_size(monkeypatch):
    r = random.Random(6)
    for _ in range(60):
        text = b"".join(r.choice([b"\n", b"a", b"bc\n", b"\n\n", b"long" * 9]) for _ in range(r.randint(0, 30)))
        want, at = [], 0
        for line in text.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        want = [w for w in want if w[0] < len(text)]
        for step, chunk in ((1, 1), (4, 3), (1000, 2)):
            monkeypatch.setattr(landed, "CHUNK", chunk)
            assert [p for k in range(0, len(text), step) for p in landed.lines(io.BytesIO(text), k, min(len(text), k + step))] == want


WORKS = '{"results": [{"id": "W1", "title": "Study", "publication_date": "2024-01-02"}, {"id": "W2"}]}'
TEXTS = {"google_patents": "\n\n".join(map(json.dumps, EXPORT)) + "\n", "patentscope": BIBLIO + BIBLIO.replace("<html>", "") * 2, "csir_nml": CARDS * 4, "openalex": WORKS}


@pytest.mark.parametrize("source", list(TEXTS))
def test_formats_equal_the_readers(spark, tmp_path, source):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text(TEXTS[source])
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "empty").write_text("")
    # Spark writes a local file's scheme with one slash or three.
    rows = lambda df: [tuple(r) for r in df.withColumn("file", F.substring_index("file", "/", -1)).orderBy("file", "line").drop("line").collect()]
    want = rows(readers.reader(source)(spark, str(tmp_path / "f*.txt"), fetched_at="2025-01-02"))
    for size in (40, 1000, landed.SPLIT_BYTES):
        assert rows(landed.read(spark, source, str(tmp_path), size, fetched_at="2025-01-02")) == want != []
    assert landed.read(spark, source, f"file://{tmp_path}/f1*").count() * 3 == len(want)
    many = spark.read.format(source).option("split_bytes", 40).load(str(tmp_path))
    assert many.rdd.getNumPartitions() == (3 if source == "openalex" else 3 * -(-len(TEXTS[source].encode()) // 40))


def test_journal_by_splits(spark, tmp_path):
    text = JOURNAL * 3 + "".join("(12)\nPATENT APPLICATION PUBLICATION " + b.format(n=202611000100 + k) for k, b in enumerate(TORN)) + "(12) \fThe Patent Office Journal No. 38/2026 Dated 18/09/2026 7 PATENT APPLICATION PUBLICATION (21) Application No.202611000999 B"
    (tmp_path / "j.txt").write_text(text)
    rows = lambda df: [tuple(r) for r in df.orderBy("line").drop("file", "line").collect()]
    want = rows(journal.read_journal(spark, str(tmp_path / "j.txt"), "38/2026", "Part I"))
    for size in (33, 500, landed.SPLIT_BYTES):
        assert rows(landed.read(spark, "journal", str(tmp_path), size, journal_no="38/2026", journal_part="Part I")) == want and len(want) == 12


def test_files_are_streamed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        rows = landed.stream(spark, "patentscope", str(tmp_path / "in"), 50, fetched_at="2025-01-02")
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    for name in "ba":
        (tmp_path / f"in/{name}").write_text(BIBLIO)
    assert run() == 4 and run() == 4
    (tmp_path / "in/0").write_text(BIBLIO)
    assert run() == 6 and run() == 6
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("appl_no").distinct().collect()) == ["IN201811000001", "WO1"]


def test_unknown_sources_raise(spark, tmp_path):
    with pytest.raises(KeyError, match="unknown source"):
        landed.read(spark, "nobody", str(tmp_path))
    landed.register(spark)
    with pytest.raises(Exception, match="unknown source"):
        spark.read.format("landed").option("source", "nobody").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="no_such"):
        spark.read.format("csir_nml").load(str(tmp_path / "no_such")).count()
    (tmp_path / "c.html").write_text(CARDS)
    assert spark.read.format("landed").option("source", "csir_nml").load(str(tmp_path)).columns == ["file", "line", "value"]


def test_many_splits_are_few_tasks(spark, tmp_path):
    (tmp_path / "a.html").write_text(CARDS * 500)
    (tmp_path / "b.html").write_text("x" * 9 + CARDS)
    sizes = [(tmp_path / n).stat().st_size for n in ("a.html", "b.html")]
    parts = landed.Batch("csir_nml", str(tmp_path), 11).partitions()
    assert sum(-(-n // 11) for n in sizes) > 10_000 and len(parts) <= landed.TASKS + 2
    # Every byte is in one task, and the pieces are those of one split.
    assert [(p.value[2], p.value[3]) for p in parts if p.value[1].endswith("b.html")][-1][1] == sizes[1]
    assert all(p.value[3] == q.value[2] for p, q in zip(parts, parts[1:]) if p.value[1] == q.value[1])
    got = lambda ps: [r for p in ps for b in landed.read_split("csir_nml", p) for r in zip(*b.to_pydict().values())]
    assert got(parts) == got(landed.Batch("csir_nml", str(tmp_path), 1 << 30).partitions()) != []
    assert landed.read(spark, "csir_nml", str(tmp_path), 11).count() == landed.read(spark, "csir_nml", str(tmp_path)).count() >= 1000
    # Tasks are no longer than a split may be by itself.
    big = landed.splits([pafs.FileInfo("/x", pafs.FileType.File, size=1 << 44)], "/x", 50_000, False)
    assert max(p.value[3] - p.value[2] for p in big) <= landed.SPLIT_BYTES


def test_listing_pages_by_splits(spark, tmp_path, monkeypatch):
    row = lambda n, end="</tr>": f'<TR class="x"><td>{n}</td><td>{n}/2026</td><td>18/09/2026</td><td>x</td><td><form action="ViewJournal"><input name="FileName" value="a{n}"/><button>Part I</button></form></td>{end}'
    page = "<table></tr>" + row(1) + "<track>" + row(2, "</TR\n >") + "<tr>" + row(3) + row(4, "</tr >") + "</tr>" + row(5, "")
    (tmp_path / "l.html").write_text(page)
    columns = ["journal_no", "published", "parts"]
    want = [tuple(r) for r in journal.journals(readers.whole_files(spark, str(tmp_path / "l.html"))).orderBy("row").select(columns).collect()]
    for size in (13, 400, landed.SPLIT_BYTES):
        assert [tuple(r) for r in landed.read(spark, "journal_listing", str(tmp_path), size).orderBy("file", "row").select(columns).collect()] == want
    assert [w[0] for w in want] == ["1/2026", "2/2026", "3/2026", "4/2026"]
    # A page of several files keeps their order, and no file is a row.
    (tmp_path / "m.html").write_text("".join(row(n) for n in range(10, 60)))
    listed = journal.list_journals(spark, str(tmp_path))
    assert [r.journal_no for r in journal.select_journals(listed, latest=6).orderBy("file", "row").collect()] == [*[w[0] for w in want], "10/2026", "11/2026"]
    assert "wholetext" not in listed._jdf.queryExecution().toString().lower() and listed.count() == 54
    for chunk in (1, 3, 1000):
        monkeypatch.setattr(landed, "CHUNK", chunk)
        raw = page.encode()
        got = [p for at in range(0, len(raw), 17) for p in landed.pieces(io.BytesIO(raw), at, min(len(raw), at + 17), landed.ENDS["journal_listing"], True)]
        assert got == list(landed.pieces(io.BytesIO(raw), 0, len(raw), landed.ENDS["journal_listing"], True)) and len(got) == 6


def test_small_splits_fill_a_task(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"x" + CARDS.encode().replace(b"</a>", b" \xff\xe9 \xc3\xa9</a>", 1) * 2000)
    batch = landed.Batch("csir_nml", str(tmp_path), 500).partitions()
    stream = landed.Stream("csir_nml", str(tmp_path), 500)
    for parts in (batch, stream.partitions(stream.initialOffset(), stream.latestOffset())):
        assert (tmp_path / "a.html").stat().st_size > 500 * 2 * landed.TASKS and len(parts) == 1
    # Adjoining pieces are one buffer; bytes that are not UTF-8 are replaced within their piece.
    text = (tmp_path / "a.html").read_bytes()
    want = [(at, raw.decode("utf-8", "replace")) for at, raw in whole(text, landed.MARKS["csir_nml"])]
    assert [(r["line"], r["value"]) for b in landed.read_split("csir_nml", batch[0]) for r in b.to_pylist()] == want


def test_cards_go_to_python_once(spark, tmp_path):
    (tmp_path / "c.html").write_text(CARDS)
    assert landed.read(spark, "csir_nml", str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


@pytest.mark.parametrize("name", ["landed_listings", "landed_stream"])
def test_cards_land_without_a_shuffle(spark, sf_dir, name, monkeypatch):
    plans, write = [], catalogue_formats.landed_file
    monkeypatch.setattr(catalogue_formats, "landed_file", lambda spark, pages, name: plans.append(pages._jdf.queryExecution().executedPlan().toString()) or write(spark, pages, name))
    assert catalogue.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert len(plans) == 4 and not any("Exchange" in p for p in plans)


def test_cards_without_an_end_take_linear_time(spark):
    started = '<div class="project"> <a href="u">'
    page = started + '</a> <span class="date">' * 40_000 + " x " + started + 'T &amp;amp; <b>t</b></a>\n<span class="date"> &amp;nbsp;2024&amp;#45;01-02 </span> <p class="desc">a</p> <p>b\n</p> </div>'
    at = time.time()
    got = readers.finish(readers.card_records(spark.createDataFrame([("f", page), ("g", page.split(" x ")[0])], "file string, value string"), " X &amp;  Y "), "csir_nml", "rd").select("file", "title", "abstract", "filing_date", "applicants").collect()
    assert time.time() - at < 30
    # A card that lacks its end takes that of a later one, as any text may stand between.
    assert [(r.file, r.abstract, r.applicants) for r in got] == [("f", "a</p> <p>b", ["X & Y"])]
    # References of a date are decoded twice.
    card = spark.createDataFrame([("f", page.split(" x ")[1])], "file string, value string")
    assert [(r.title, r.filing_date) for r in readers.finish(readers.card_records(card, "X"), "csir_nml", "rd").collect()] == [("T &amp; <b>t</b>", "2024-01-02")]
