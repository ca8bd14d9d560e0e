"""The audit against the definition, computed densely with Python integers."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import divergence

WORDS = ["the", "The", "été", "straße", "x", "zebra", "apple", "apples", "naïve", "日本", "q"]


def brute(rows, least=3, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}

    def shares(count, lang):
        total = sum(count[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in groups.items()}
    whole = {lang: shares(sum((c for g, c in groups.items() if g[0] == lang), Counter()), lang) for lang in kept}
    out = []
    for (lang, source), own in p.items():
        far = [(sum((own[t] - q[t]) ** 2 // q[t] for t in own), b) for (a, b), q in p.items() if a == lang and b != source]
        telling = [((own[t] - whole[lang][t]) ** 2 // whole[lang][t], t) for t in own if groups[lang, source][t] and own[t] > whole[lang][t]]
        for part, found in (("pair", far), ("term", telling)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def made(n):
    words = lambda i: " ".join(WORDS[(i * k + k * k) % len(WORDS)] + ("" if k % 3 else f" t{'abcdefg'[(i + k) % 7]}") for k in range(1, 3 + i % 17))
    return [(["en", "de", None][i % 3], [f"s{i % 5}", None, ""][0 if i % 11 else i % 3], words(i)) for i in range(n)]


@pytest.mark.parametrize(("top", "leaf"), [(200, 4096), (3, 1), (1, 0)])
def test_audit_follows_the_definition(spark, top, leaf):
    rows = [*made(150), ("xx", "a", "only once"), ("xx", "b", None), ("xx", "c", ""), ("en", "big", "the " * 50_000), ("en", "big", "the-zebra_apple{été}\n\t,"), ("solo", "s", "w w"), ("solo", "s", "w"), ("solo", "s", "w")]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows), top, leaf).collect()))
    assert got == brute(rows, top=top)


def test_ties_are_parted_by_bytes(spark):
    # Values differ in high and low bits, many are tied, and tied items share long beginnings.
    items = [("g", 1 << 60, "a"), ("g", 7, "zz"), *[("g", 5, f"prefix{i:04d}") for i in range(300)], ("g", 5, "prefi"), ("g", 5, "pré"), *[("h", 0, f"{i}é") for i in range(40)], ("small", 3, "x"), ("small", 3, "")]
    rows = spark.createDataFrame(items, "g string, v long, item string").repartition(7)
    want = []
    for g in ("g", "h", "small"):
        own = sorted((r for r in items if r[0] == g), key=lambda r: (-r[1], r[2].encode()))
        want += [(*r, k) for k, r in enumerate(own[:25], 1)]
    for leaf in (0, 8, 4096):
        assert sorted(map(tuple, divergence.radix_top(rows, ["g"], "v", "item", 25, leaf).collect())) == sorted(want)


def test_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(10**13, 3 * 10**13 + 7), (8_999_999_999, 10**10), (0, 0), (4, 5)], "n long, total long")
    got = [r[0] for r in rows.select(divergence._share("n", "total")).collect()]
    assert got == [1 + 10**9 * (n + 1) // t if t else 1 for n, t in ((10**13, 3 * 10**13 + 7), (8_999_999_999, 10**10), (0, 0), (4, 5))]


def test_small_steps_change_nothing(spark, monkeypatch):
    rows = made(60)
    want = brute(rows)
    counted = list(divergence._count_terms(iter(frame(spark, [(a or "", b or "", c) for a, b, c in rows]).toArrow().to_batches())))
    assert sum(b.num_rows for b in counted) > 0
    monkeypatch.setattr(divergence, "PAIRS", 5)
    kept = divergence.term_counts(frame(spark, rows))
    groups = divergence.group_shares(frame(spark, rows), kept)
    by_term = kept.join(groups, ["lang", "source"]).select("lang", "term", "sid", divergence._share("n", "total").alias("p"), "base").orderBy("lang", "term").toArrow()
    small = Counter()
    for batch in divergence._pair_sums(iter(by_term.to_batches(max_chunksize=3))):
        for lang, a, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            small[lang, a, b] += v
    monkeypatch.setattr(divergence, "PAIRS", 10**6)
    whole = Counter()
    for batch in divergence._pair_sums(iter(by_term.to_batches())):
        for lang, a, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole[lang, a, b] += v
    assert small == whole and want


def test_clashing_columns_and_empty_tables(spark):
    docs = frame(spark, made(40))
    extra = docs.withColumns({"term": F.lit("t"), "n": F.lit(1), "rank": F.lit(0), "__need": F.lit(2), "sid": F.lit(3)})
    assert sorted(map(tuple, divergence.audit(extra).collect())) == sorted(map(tuple, divergence.audit(docs).collect())) == brute(made(40))
    assert divergence.audit(docs.limit(0)).count() == 0
    assert sorted(map(tuple, divergence.audit(frame(spark, [("a", "x", None), ("a", "y", "")])).collect())) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
