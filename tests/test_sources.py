import json

import pytest

from corvane.plans.engine import ingest
from corvane.sources import journal, readers
from corvane.operators import quality, sinks
from corvane.streaming.harvest import harvest_stream

EXPORT = [
    {"publication_number": "IN201811000001A", "title_localized": [{"text": "Leaching of &amp; ore", "language": "en"}], "abstract_localized": [{"text": " A  way "}], "assignee": [{"name": "Acme Ltd"}, {"name": "Acme Ltd"}], "inventor": [{"name": "A. Person"}], "ipc": [{"code": "C22B 3/04"}, {"code": ""}], "publication_date": 20190101, "filing_date": 20180105},
    {"publication_number": "IN201811000002B", "legal_status": " Granted ", "filing_date": None},
    {"publication_number": "  "},
]
BIBLIO = """<html><div class="biblio" data-docid="IN201811000001"><span class="title">Leaching <!-- x --></span><span class="applicant">Acme</span>
<span class="ipc">C22B3/04</span><span class="filing-date">20180105</span></div>
<div class="biblio" data-docid="WO1"><span class="title">Second</span><span class="ipc">none</span></div>
"""
CARDS = """<div class="project"> <a href="http://lab.example/1">Pilot &amp; plant</a>
<span class="date">2024-05-01</span> <p class="desc">Cobalt
work</p> </div><div class="project"><a href="http://lab.example/1">Again</a><span class="date"></span><p class="desc"></p></div>"""
WORKS = {"results": [{"id": "W1", "title": "Study", "publication_date": "2023-02-03", "primary_location": {"landing_page_url": "http://doi.example/1"}, "authorships": [{"institutions": [{"display_name": "U One"}, {"display_name": "U Two"}]}, {"institutions": []}]}, {"id": "W2", "title": None, "primary_location": None, "authorships": []}]}


@pytest.fixture
def landed(tmp_path):
    paths = {}
    for source, text in {"google_patents": "\n\n".join(map(json.dumps, EXPORT)), "patentscope": BIBLIO, "csir_nml": CARDS, "openalex": json.dumps(WORKS)}.items():
        (tmp_path / source).write_text(text)
        paths[source] = str(tmp_path / source)
    return paths


def test_each_reader(spark, landed):
    rows = {s: readers.reader(s)(spark, p, fetched_at="2025-01-02").orderBy("line").collect() for s, p in landed.items()}
    g = rows["google_patents"]
    assert [(r.appl_no, r.legal_status, r.title, r.filing_date) for r in g] == [("IN201811000001A", "Published", "Leaching of & ore", "2018-01-05"), ("IN201811000002B", "Granted", "", "")]
    assert g[0].applicants == ["Acme Ltd"] and g[0].ipc_codes == ["C22B 3/04"] and g[0].source_url.endswith("/IN201811000001A") and g[1].applicants == []
    p = rows["patentscope"]
    assert [(r.appl_no, r.applicants, r.ipc_codes, r.filing_date) for r in p] == [("IN201811000001", ["Acme"], ["C22B3/04"], "2018-01-05"), ("WO1", [], [], "")]
    c = rows["csir_nml"]
    assert [(r.title, r.abstract, r.filing_date, r.applicants, r.kind) for r in c] == [("Pilot & plant", "Cobalt work", "2024-05-01", ["CSIR-NML"], "rd"), ("Again", "", "", ["CSIR-NML"], "rd")]
    o = rows["openalex"]
    assert [(r.source_url, r.applicants, r.title, r.kind) for r in o] == [("http://doi.example/1", ["U One", "U Two"], "Study", "publication"), ("W2", [], "", "publication")]
    assert all(r.fetched_at == "2025-01-02" and r.source_id == s for s, x in rows.items() for r in x)
    with pytest.raises(KeyError):
        readers.reader("nowhere")


def test_pipeline_keeps_the_first_and_a_repeat_adds_nothing(spark, landed, tmp_path):
    records, stats = ingest(spark, landed, "2025-01-02")
    by = {r.source_id: r for r in stats.collect()}
    assert (by["total"].parsed, by["total"].deduped, by["total"].duplicates) == (8, 7, 1) and by["csir_nml"].duplicates == 1
    assert by["csir_nml"].completeness == 1.0 and by["google_patents"].completeness == pytest.approx(0.7)
    assert {r.source_id for r in quality.incomplete_sources(stats).collect()} == {"google_patents", "patentscope", "openalex"}
    assert [r.title for r in records.where("source_id = 'csir_nml'").collect()] == ["Pilot & plant"]
    sinks.write_store(records, str(tmp_path / "store"))
    stored = readers.records_jsonl(spark, str(tmp_path / "store/part-*"))
    assert stored.count() == 7 and journal.new_candidates(records, stored).count() == 0
    assert readers.records_jsonl(spark, str(tmp_path / "nothing*")).count() == 0
    with pytest.raises(ValueError):
        ingest(spark, {})


LISTING = """<table><tr><th>1</th></tr><tr><td>1</td><td> 38/2026 </td><td>18/09/2026</td><td>x</td><td>
<form method="post" action="/IPOJournal/Journal/ViewJournal"><input type="hidden" name="FileName" value="a&amp;b|1" /><button type="submit"> Part <b>I</b></button></form>
<form action="/IPOJournal/Journal/ViewJournal"><input name="FileName" value="c" /><button>Part IV - Designs</button></form></td></tr>
<tr><td>2</td><td>total</td><td></td><td></td><td></td></tr><tr><td>3</td><td>37/2025</td><td>11/09/2025</td><td></td><td></td></tr></table>"""

JOURNAL = """front matter (12) none
(12) PATENT APPLICATION PUBLICATION (21) Application No.202611000001 A
(19) INDIA
(22) Date of filing of Application :05/01/2026 (43) Publication Date : 18/09/2026
(54) Title of the invention : RECOVERY OF LITHIUM
FROM BRINE

(51) International
C22B
26/12, 1)SOME PERSON
:C01D15/08
(71)Name of Applicant :
1)Acme Metals Ltd
Address of Applicant :12, Some Road, 1)not a name
B09B 3/00,
2)Beta Labs
(72)Name of Inventor :
1)First Person
:01/01/1900 2)Second Person
(57) Abstract :
A method is given.
No. of Pages : 12 No. of Claims : 3
The Patent Office Journal No. 38/2026 Dated 18/09/2026 101
\x0c(12) PATENT APPLICATION PUBLICATION no number here
(12) PATENT APPLICATION PUBLICATION (21) Application No. 202611000002
(54) Title of the invention : A CHAIR (51) x
(57) Abstract : Legs."""


def test_journal_listing(spark, tmp_path):
    from corvane.plans import jobs

    (tmp_path / "l.html").write_text(LISTING)
    listed = journal.list_journals(spark, str(tmp_path / "l.html")).cache()
    rows = listed.orderBy("row").collect()
    assert [(r.journal_no, r.published) for r in rows] == [("38/2026", "18/09/2026"), ("37/2025", "11/09/2025")]
    assert [(p.label, p.file_name) for p in rows[0].parts] == [("Part I", "a&b|1"), ("Part IV - Designs", "c")] and rows[1].parts == []
    assert [r.slug for r in journal.application_parts(listed).collect()] == ["38-2026_Part-I"]
    assert journal.select_journals(listed, since=2026).count() == 1 and journal.select_journals(listed, latest=1).first().journal_no == "38/2026"
    assert journal.select_journals(listed, numbers=["37/2025"]).count() == 1
    plan = lambda **k: sorted((r.journal_no, r.published, r.slug) for r in jobs.journal_plan(spark, str(tmp_path / "l.html"), **k).collect())
    assert plan() == [("38/2026", "18/09/2026", "38-2026_Part-I")] == plan(since=2026) and plan(numbers=["37/2025"]) == []
    assert [x[0] for x in plan(all_parts=True, latest=None)] == ["38/2026"] * 2
    journal.check_allowed(spark.createDataFrame([("c",)], "file_name string"), listed)
    with pytest.raises(PermissionError):
        journal.check_allowed(spark.createDataFrame([("../etc",)], "file_name string"), listed)


def test_journal_records_and_candidates(spark, tmp_path):
    (tmp_path / "j.txt").write_text(JOURNAL)
    found = journal.read_journal(spark, str(tmp_path / "j.txt"), "38/2026", "Part I")
    a, b = found.orderBy("line").collect()
    assert (a.appl_no, a.kind_code, a.title, a.abstract) == ("202611000001", "A", "RECOVERY OF LITHIUM FROM BRINE", "A method is given.")
    assert (a.filing_date, a.publication_date, a.pages, a.claims, a.legal_status) == ("2026-01-05", "2026-09-18", 12, 3, "Published")
    assert a.applicants == ["Acme Metals Ltd", "Beta Labs"] and a.inventors == ["First Person", "Second Person"]
    assert a.ipc_codes[:3] == ["C22B 26/12", "C01D 15/08", "B09B 3/00"] and a.source_url.endswith("#38/2026/Part-I/202611000001")
    assert (b.appl_no, b.kind_code, b.title, b.abstract, b.pages, b.applicants) == ("202611000002", "A", "A CHAIR", "Legs.", None, [])
    kept = journal.candidates(found).collect()
    assert [(r.appl_no, r.candidate_reason.keywords, r.candidate_reason.ipc) for r in kept] == [("202611000001", ["lithium"], ["C01D", "C22B"])]


def test_incremental_harvest(spark, tmp_path):
    landing = tmp_path / "in/journal_no=38-2026/journal_part=I"
    landing.mkdir(parents=True)
    (landing / "a.txt").write_text(JOURNAL)
    run = lambda: harvest_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "archive"), str(tmp_path / "ck")).awaitTermination()
    run()
    run()
    (landing / "b.txt").write_text(JOURNAL.replace("202611000001", "202611000009"))
    (landing / "c.txt").write_text(JOURNAL)
    run()
    stored = readers.records_jsonl(spark, str(tmp_path / "store/part-*"))
    assert sorted(r.appl_no for r in stored.collect()) == ["202611000001", "202611000009"]
    assert spark.read.json(str(tmp_path / "archive")).count() == 6


TORN = [
    "(21) Application No.{n} A\n(54) Title of the invention : T {n}\n\n(57) Abstract : lithium\n",
    "(21) Application No.\n {n} A\n(54) Title of the invention : T {n}\n(51) x (57)\nAbstract\n:\nlithium",
    "(21)\nApplication No.{n}\nA\n(54) Title of the invention : T {n}\n \n(57) Abstract : lithium",
    "(21) Application No.{n} A\n(54)\nTitle of the invention : T\n{n}\n\n(57) Abstract : lithium",
    "(21) Application No.{n} A\n(54) Title of the invention\n:\nT {n}\n\n(22)\nDate of filing of Application\n:\n05/01/2026 (43) Publication Date :\n18/09/2026 (57) Abstract : lithium No.\nof Pages\n: 4 No. of\nClaims : 2",
]


def test_fields_torn_over_lines(spark, tmp_path):
    foot = "\nThe Patent Office Journal No.\n38/2026\nDated 18/09/2026\n12\f"
    (tmp_path / "j.txt").write_text("front" + "".join("(12)\nPATENT APPLICATION PUBLICATION " + b.format(n=202611000001 + k) + foot for k, b in enumerate(TORN)))
    got = journal.read_journal(spark, str(tmp_path / "j.txt"), "38/2026", "Part I").orderBy("appl_no").collect()
    assert [(r.appl_no, r.title, r.kind_code, r.abstract) for r in got] == [(str(202611000001 + k), f"T {202611000001 + k}", "A", "lithium") for k in range(5)]
    assert (got[4].filing_date, got[4].publication_date, got[4].pages, got[4].claims) == ("2026-01-05", "2026-09-18", 4, 2) and got[0].pages is None


def test_harvest_survives_a_kill_and_equals_the_batch_run(spark, tmp_path):
    landing, store = tmp_path / "in/journal_no=38-2026/journal_part=I", str(tmp_path / "store")
    landing.mkdir(parents=True)
    texts = {f"f{k}.txt": JOURNAL.replace("202611000001", str(202611000001 + k % 4)).replace("BRINE", f"BRINE {k}") for k in range(8)}

    def run(before=None):
        harvest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "archive"), str(tmp_path / "ck"), 2, before).awaitTermination()

    def killed(number):
        if number == 1:
            raise RuntimeError("killed")

    for name, text in list(texts.items())[:6]:
        (landing / name).write_text(text)
    # What a batch job stored before counts as stored.
    (tmp_path / "store").mkdir()
    (tmp_path / "store/part-0.json").write_text('{"source_url": "' + journal.LISTING_URL + '#38-2026/I/202611000003", "appl_no": "202611000003"}\n')
    with pytest.raises(Exception, match="killed"):
        run(killed)
    run()
    for name, text in list(texts.items())[6:]:
        (landing / name).write_text(text)
    run()
    run()
    rows = readers.records_jsonl(spark, store + "/part-*").collect()
    assert sorted(r.appl_no for r in rows) == [str(202611000001 + k) for k in range(4)]
    assert spark.read.json(str(tmp_path / "archive")).count() == 16
    # No batch's plan reads the store: it may even be gone.
    (tmp_path / "store").rename(tmp_path / "moved")
    (landing / "late.txt").write_text(JOURNAL.replace("202611000001", "202611000077") + JOURNAL)
    run()
    assert [r.appl_no for r in readers.records_jsonl(spark, store + "/part-*").collect()] == ["202611000077"]
