import random
import zlib

import numpy as np

from quillon.llm import quality


def corpus(n=600):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "ka lo mi te ru sa no vi".split() for b in "ran del pos tim gor".split()]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        if bad:
            body = [w.upper() + "!!" for w in body] if i % 8 else [w for w in body[:6] for _ in range(9)]
        rows.append((i, " ".join(body), "en", "s"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_no_leak_of_labels(spark, tmp_path):
    rows, labels = corpus()
    rows += [(9001, None, None, None), (9002, "", "en", "s"), (None, "x", "en", "s"), (9003, "word " * 30_000, "en", "s"), rows[0]]
    held = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0}

    def run(where, labels):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        return quality.query(spark, where).collect()

    got = run(str(tmp_path / "a"), labels + [(None, 1, 0), (5, None, 0), labels[1]])
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600} == held
    truth = {i: q for i, q, _ in labels}
    hits = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in held]
    assert np.mean(hits) >= 0.95
    turned = run(str(tmp_path / "b"), [(i, 1 - q if i in held else q, t) for i, q, t in labels])
    assert sorted((r.doc_id or -1, r.score) for r in got) == sorted((r.doc_id or -1, r.score) for r in turned)


def test_one_class_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for labels in (none, one):
        scores = {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality.score(docs.limit(0), quality.fit(docs, one)).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logit = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < quality.sigmoid(logit)).astype(float)
    assert 2.5 < quality.fit_temperature(3 * logit, y) < 3.6


def test_sums_reach_the_driver_once_and_in_small_rows(spark, monkeypatch):
    texts = [t for _, t, *_ in corpus(240)[0]]
    sample = spark.createDataFrame([(t,) for t in texts], "text string").repartition(quality.FIT_PARTS)
    words = {w for t in texts for w in t.split()}
    tokens = sorted(words | {quality.shape(w) for w in words} | {f"unused{i}" for i in range(300)})
    own = np.concatenate([np.zeros((1, quality.DIMENSIONS), np.float32), quality.index_vectors(tokens)])
    taken, collect = [], type(sample).collect

    def seen(df):
        rows = collect(df)
        taken.extend(len(r.sums) for r in rows)
        return rows

    monkeypatch.setattr(type(sample), "collect", seen)
    got = quality._context(sample, tokens, own)
    want, ids = np.zeros(own.shape), quality.TokenIds(tokens)
    quality.add_context(want, [x for t in texts for x in ids.of(t)], own)
    assert np.abs(want).max() > 1 and np.allclose(got, want, rtol=1e-4, atol=1e-3)
    assert sum(taken) == own.nbytes and max(taken) <= 1 << 16
