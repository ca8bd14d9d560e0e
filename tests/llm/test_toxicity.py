import itertools
import math
import random
import zlib

import numpy as np
import pytest

from corvane.llm import toxicity as t


def test_nearest_matches_brute_force():
    rng = np.random.default_rng(2)
    n_terms = 40

    def vector():
        terms = np.sort(rng.choice(n_terms, rng.integers(0, 7), replace=False))
        w = rng.random(len(terms)) + 0.1
        return terms, w / (np.linalg.norm(w) or 1)

    vectors = [vector() for _ in range(700)]
    vectors += vectors[:80]  # ties
    index = t.Index.build(vectors, [i % 2 for i in range(len(vectors))], list(range(len(vectors))), n_terms)
    dense = np.zeros((len(vectors), n_terms))
    for place, i in enumerate(index.ids):
        dense[place, vectors[i][0]] = vectors[i][1]
    for terms, w in [vector() for _ in range(150)] + vectors[:20]:
        q = np.zeros(n_terms)
        q[terms] = w
        for skip in (-1, 3):
            scores = dense @ q
            want = [p for p in np.lexsort((np.arange(len(scores)), -np.round(scores, 12))) if scores[p] > 1e-12 and p != skip][: t.NEIGHBOURS]
            places, cosines = index.nearest(terms, w, skip=skip)
            assert places.tolist() == want and np.allclose(cosines, scores[want])


def auc(score, label):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(score, label) if x for b, y in zip(score, label) if not y]
    return sum(pairs) / len(pairs)


def test_held_out_rows_are_told_apart(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = t.fit(docs, labels)
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in model.index.ids)
    rows = t.score_documents(docs.join(labels, "doc_id").where(t.held_out(labels["doc_id"])), model).join(labels, "doc_id").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert np.mean((s >= 0.5) == y) > 0.97 and auc(s, y) > 0.94 and all(r.predicted == (r.score >= 0.5) for r in rows)
    # Calibrated: in each half of the scores the mean is near the share of toxic rows.
    for part in (s < 0.5, s >= 0.5):
        assert abs(s[part].mean() - y[part].mean()) < 0.1
    assert all(e.cosine <= 1 + 1e-9 for r in rows for e in r.evidence)


SCHEMA = "doc_id long, text string, score double, toxic int"


def small(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(200):
        words = [rng.choice(["sun", "tree", "river", "bread", "table", "walk"]) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(words), 0.0, 0))
        labels.append((i, int(i % 4 == 0)))
    labels += [(5, None), (None, 1), (10**6, 1), (0, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_odd_rows(spark):
    docs, labels = small(spark)
    model = t.fit(docs, labels)
    odd = spark.createDataFrame([(1, "vile sun", 1.0, 1), (2, None, 1.0, 1), (3, "", 1.0, 1), (4, "sun " * 200000, 1.0, 1), (None, "rotten tree walk", 1.0, 1), (1, "vile sun", 1.0, 1), (7, "日本 1234", 1.0, 1)], SCHEMA)
    got = t.score_documents(odd, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got] == [1, 0, 0, 0, 1, 1, 0] and got[0] == got[5] and got[1].score == got[2].score
    assert [r.text for r in t.drop_toxic(odd, model).collect() if r.text] == ["sun " * 200000, "日本 1234"]
    assert t.score_documents(odd.limit(0), model).collect() == []


def test_every_telling_term_is_kept(spark):
    words = ["".join(w) for w in itertools.product("abcdefghijk", repeat=3)]
    rows = [(i, " ".join(words) if i % 4 == 0 else "sun tree", 0.0, 0) for i in range(200)]
    model = t.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert set(words) <= set(model.number) and len(words) == 1331


@pytest.mark.parametrize("case", ["no labels", "one class", "no documents"])
def test_nothing_to_learn(spark, case):
    docs, labels = small(spark)
    if case == "no documents":
        docs = docs.limit(0)
    labels = labels.limit(0) if case == "no labels" else labels.where("toxic = 0") if case == "one class" else labels
    model = t.fit(docs, labels)
    assert all(r.score <= 0.5 and r.predicted == 0 for r in t.score_documents(small(spark)[0], model).collect())


def brute_scores(model, texts, examples, everything):
    """Scores of texts by plain Python over the examples (text, label) in the index's order and all texts of the corpus."""
    import re
    from collections import Counter

    def counts(text):
        found, rest = Counter(), 0
        for w in re.findall("[a-zA-Z\x80-\U0010ffff]+", text):
            w = w.lower()
            own = [x for x in (w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n)) if x in model.number]
            found.update(own)
            rest += not own
        return found | ({None: rest} if rest else {})

    df = Counter(x for text in everything for x in counts(text) if x)
    idf = {x: math.log((1 + len(everything)) / (1 + df[x])) + 1 for x in model.number} | {None: 1.0}

    def unit(text):
        w = {x: (1 + math.log(n)) * idf[x] for x, n in counts(text).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    known = [(unit(text), label, text) for text, label in examples]
    out = []
    for text in texts:
        q = unit(text)
        cosines = [(sum(v * e.get(x, 0.0) for x, v in q.items()), p) for p, (e, _, other) in enumerate(known) if other != text]
        near = sorted(((-round(c, 12), p) for c, p in cosines if c > 1e-12))[:25]
        weights = [(1 / (max(0, 1 + c) + 0.05), known[p][1]) for c, p in near]
        share = (sum(w * y for w, y in weights) + 0.5 * model.base) / (sum(w for w, _ in weights) + 0.5)
        out.append(1 / (1 + math.exp(-model.slope * math.log(share / (1 - share)) - model.offset)))
    return out


def test_query_matches_brute_force(spark, sf_dir):
    from corvane.llm import queries

    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = t.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert sorted(model.index.ids) == sorted(toxic) and len(model.number) > 1
    got = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, sf_dir).collect()}
    want = brute_scores(model, text.values(), [(text[i], toxic[i]) for i in model.index.ids], list(text.values()))
    assert len(got) == len(text)
    for i, s in zip(text, want, strict=True):
        assert abs(got[i].score - s) < 1e-9 and got[i].predicted == (s >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_no_example_of_the_same_text_votes(spark):
    rows = [(i, "vile sun tree" if i % 4 == 0 else f"sun tree walk {'bread' if i % 2 else 'river'}", 0.0, 0) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    model = t.fit(docs, labels)
    assert all(model.index.labels[p] == 0 for p, _ in t._scorer(model)("vile sun tree")[1])
    evidence = {r.doc_id: r.evidence for r in t.score_documents(docs, model).collect()}
    assert all(not e.toxic for e in evidence[0])
