import math
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as p
from corvane.llm import quality_lines, sentencepiece_codec, simhash, toxicity
from corvane.llm.common import written
from corvane.llm.queries import piece_model


def groups_of(rows):
    fps = {i: int.from_bytes(simhash.fingerprint(t.encode()), "big") for i, t in rows}
    parent = {f: f for f in fps.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(list(parent), np.uint64)
    for f in values:
        for g in values[np.bitwise_count(values ^ f) <= 3].tolist():
            parent[find(int(f))] = find(g)
    out = defaultdict(list)
    for i, f in fps.items():
        out[find(f)].append(i)
    return out.values()


def test_stages_match_brute_force(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    frames = {"documents": docs}
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, sf), "test")
        frames[name] = docs
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else docs.collect()
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None

    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = toxicity.fit(frames["documents"], spark.read.parquet(f"{sf}/labels.parquet"))
    score = toxicity._scorer(model)
    source = {r.doc_id: (r.text, r.source) for r in frames["documents"].collect()}
    assert sorted(i for i, _ in kept["toxicity"]) == sorted(i for i, (t, _) in source.items() if score(t)[0] < 0.5)

    want = {i: quality_lines.cleaned(t) for i, t in kept["toxicity"] if quality_lines.judge(t)[6]}
    assert dict(kept["quality rules"]) == want and len(kept["quality rules"]) == len(want)
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0 and len(source[i][0].split()) >= 60]
    assert sum(i in want for i in clean) >= 0.98 * len(clean)

    assert sorted(i for i, _ in kept["SimHash near-dedup"]) == sorted(min(g) for g in groups_of(kept["quality rules"]))
    assert dict(kept["SimHash near-dedup"]).items() <= want.items()

    mixed = kept["mixing sources to target weights"]
    have = dict(kept["SimHash near-dedup"])
    assert all(have[i] == t for i, t in mixed) and max(Counter(i for i, _ in mixed).values()) <= 3
    words, total, largest = Counter(), Counter(), Counter()
    for i, t in have.items():
        total[source[i][1]] += len(t.split())
        largest[source[i][1]] = max(largest[source[i][1]], len(t.split()))
    for i, t in mixed:
        words[source[i][1]] += len(t.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    target, capped = {}, set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = [s for s in total if s not in capped]
        target = {s: 3 * total[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in total}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    assert all(abs(words[s] - target[s]) <= largest[s] for s in total) and math.isclose(sum(target.values()), sum(total.values()))

    encoded = kept["SentencePiece encoding and decoding"]
    codec = sentencepiece_codec.Codec(piece_model())
    assert len(encoded) == len(mixed) and all(r.decoded_equal for r in encoded)
    assert all(codec.decode(np.array(r.ids)) == have[r.doc_id] for r in encoded[:200])


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert out.count() > 0 and out.where("not decoded_equal").count() == 0


def test_first_stages_match_independent_code(spark, sf_dir):
    """Toxicity against plain Python, line rules against SQL, each over its own input."""
    import duckdb

    from test_toxicity import brute_scores

    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    scores = brute_scores(model, text.values(), [(text[i], toxic[i]) for i in model.index.ids], list(text.values()))
    kept = written(p.drop_toxic(spark, docs, sf_dir), "test")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in zip(text, scores, strict=True) if s < 0.5)
    db = duckdb.connect()
    rows = kept.select("doc_id", "text").toPandas()
    db.register("documents", rows)
    good = sorted(r[0] for r in db.execute(f"SELECT doc_id FROM ({quality_lines.ORACLE_SQL}) WHERE kept").fetchall())
    assert sorted(r.doc_id for r in p.clean_lines(spark, kept, sf_dir).collect()) == good
