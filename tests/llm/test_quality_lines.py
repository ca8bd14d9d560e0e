import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import quality_lines as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab \n\t\x0b\x1c\x1d\x85\xa0 é|#.", max_size=120), st.lists(st.sampled_from(["a", "b", "c", "é\xa0", "\n", "|"]), max_size=200).map(" ".join)))
def test_figures_match_brute_force(text):
    assert q.judge(text)[:6] == brute(text)


PROSE = "The river ran past the old mill and turned to the south, where nobody had lived for many years{}."


def prose(n):
    return "\n".join(" ".join(f"w{i}x{j}" for j in range(14)) + "." for i in range(n))


def test_rules():
    fails = {
        "Home": "punctuation",
        "Home | News | Sport | About us.": "navigation",
        "wo### that%%% is$$$ all.": "symbols",
        "THIS IS A LINE THAT NOBODY WANTS TO READ.": "shouting",
        " ".join(["the"] * 12) + ".": "repetition",
        "Licensed under the Apache License, Version 2.0.": "boilerplate",
        "Please read our Privacy Policy.": "boilerplate",
    }
    for line, rule in fails.items():
        assert q.failed_rule(line, line.split()) == rule, line
    for line in (PROSE.format(""), "« Où est-il ? »", 'He said "No."', "Das ist gut!", "これは文です。", "Ends with space.  \r", "(All of it.)"):
        assert q.failed_rule(line, line.split()) is None, line


def test_verdicts():
    assert q.judge(prose(8))[6]
    assert not q.judge("\n".join(["Home | News | Sport | Weather | Money"] * 20))[6]
    half = prose(8) + "\n" + "\n".join(f"menu item number {i}" for i in range(8))
    assert q.judge(half)[6] and "menu" not in q.cleaned(half)
    mostly = prose(3) + "\n" + "\n".join(f"menu{i} item{i} number{i} of{i}" for i in range(40))
    assert not q.judge(mostly)[5] and not q.judge(mostly)[6]


def test_documents(spark):
    long = prose(4000)
    rows = [(1, prose(8), "kept"), (1, prose(8), "kept"), (2, None, None), (3, "", "x"), (None, prose(9), "y"), (5, long, "z"), (6, "Menu\nHome", "z"), (7, prose(8) + "\nHome", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in q.judge_documents(df).collect()}
    assert got[(2, 0)] == got[(3, 0)] == (True, False) and got[(5, len(long.split()))] == (False, True)
    assert q.judge_documents(df).count() == len(rows)
    kept = q.clean_documents(df).collect()
    assert [r.doc_id for r in kept] == [1, 1, None, 5, 7] and kept[0] == df.first()
    assert [r.text.endswith("Home") for r in q.clean_lines(df).collect()] == [False] * 5
    empty = df.limit(0)
    assert q.judge_documents(empty).collect() == q.clean_documents(empty).collect() == q.clean_lines(empty).collect() == []


def test_quality_labels_are_met(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    rows = q.judge_documents(docs).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_any_number_of_closing_marks_and_any_length():
    for n in (0, 11, 12, 40):
        line = 'He said "No.' + '"' * n
        assert q.failed_rule(line, line.split()) is None
        assert q.failed_rule(line + "x", line.split()) == "punctuation"
    furniture = ["Alle Rechte vorbehalten.", "Nous utilisons des cookies.", "Lea la política de privacidad.", "Accept cookies to read more and follow us. " * 20 + "Accept cookies."]
    for line in furniture:
        assert q.failed_rule(line, line.split()) == "boilerplate", line
    # One phrase in a long paragraph is no furniture, however long that is.
    for n in (3, 10, 300):
        line = PROSE.format("") * n + " He would read more of it later."
        assert q.failed_rule(line, line.split()) is None


def test_every_phrase_has_its_hint():
    alternatives = re.sub(r"\(\?:([^)]*)\)\??", lambda m: m[1].split("|")[0], q.PHRASES.pattern).split("|")
    assert len(alternatives) > 60 and min(map(len, q.HINTS)) >= 1 and "" not in q.HINTS
    for a in alternatives:
        phrase = re.sub(r"\[(.)[^\]]*\]", r"\1", a).replace("\\d{4}", "2024").replace("\\d+", "7").replace(" ?", "").replace("\\", "")
        phrase = phrase.replace("?", "")
        assert q.PHRASES.search(phrase), (a, phrase)
        assert any(h in phrase for h in q.HINTS), phrase
