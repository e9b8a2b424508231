import re

import corpus_pipeline
from tests.llm.test_quality import corpus
from tests.llm.test_shingle_join import brute


def test_stages(spark, tmp_path):
    rows, labels = corpus(240)
    base = "one plain sentence about nothing in particular that is long enough to have many shingles in it and goes on for a while with words"
    extra = [(1000, base), (1001, base), (1002, base + " more"), (1003, "only password=b7db7aa4a5fcc78305 here"), (1004, None), (1005, ""), (1006, base + " token: 'abcdefabcdefabcdef12' end of it all"), (1001, base)]
    docs = [(i, t, "en", "s", len(t)) for i, t, *_ in rows] + [(i, t, "en", "s", len(t or "")) for i, t in extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [read]
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        assert seen[-1].columns == read.columns and seen[-1].schema == read.schema
    good, single, clean = ([tuple(r) for r in d.collect()] for d in seen[1:])
    truth = {i: q for i, q, _ in labels}
    kept = {r[0] for r in good}
    assert sum(truth[i] == (i in kept) for i in truth) >= 0.95 * len(truth) and set(good) <= {tuple(d) for d in docs}
    pairs = [(r[0], r[1]) for r in good]
    groups = brute(pairs, 5, 80)
    want = sorted({(c if n else d) for (d, _), (n, c) in zip(pairs, groups, strict=True)})
    assert sorted(r[0] for r in single) == want
    assert len(clean) == len(single)
    for before, after in zip(sorted(single), sorted(clean), strict=True):
        assert before[0] == after[0]
        if before[1] and "password=" in before[1]:
            assert after[1] == "only [SECRET] here" and after[4] == len(after[1])
        elif not before[1] or not re.search("[0-9a-f]{16}|token", before[1]):
            assert before == after
    pieces = corpus_pipeline.packing_stage(spark, seen[3], str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in clean}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_unrelated_components_that_share_the_smallest_id(spark, tmp_path):
    one = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    docs = [(7, one), (8, one + " more"), (7, other), (9, other + " more"), (7, "third text with no copy at all")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = corpus_pipeline.near_duplicate_stage(spark, df, str(tmp_path)).collect()
    assert sorted(map(tuple, left)) == sorted([docs[0], docs[2], docs[4]])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ["score", "found", "base", "_text", "_text_hash", "Text", "_kept", "hash", "clean", "changed", "c0", "n", "cid", "text_hash", "row"]


def test_each_stage_carries_columns_of_any_name(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, and names that the stages use themselves."""
    rows, labels = corpus(120)
    docs = [(i, t, "en", "s", len(t)) for i, t, *_ in rows]
    docs += [(None, None, None, None, None), (None, None, None, None, None), (500, "", None, "s", 0), (501, "password=b7db7aa4a5fcc78305 " + "word " * 20_000, "en", None, 100_028)]
    docs += [(None, "some text without any id", "en", "s", 24)] * 2 + [docs[3]]
    more = [f"x{i}" for i in range(len(CLASHING))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    df = spark.createDataFrame([(*d, *more) for d in docs], schema)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns, name
        got = [tuple(r) for r in got.collect()]
        assert {r[5:] for r in got} == {tuple(more)}, name
        want = [tuple(r) for r in stage(spark, plain, str(tmp_path)).collect()]
        assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr), name
        if name == "near_duplicates":
            assert sum(r[0] is None and r[1] is None for r in got) == 1 and sum(r[1] == "" for r in got) == 1
        if name == "secrets":
            assert len(got) == len(docs) and [r for r in got if r[0] == 501][0][1].startswith("[SECRET] word") and [r for r in got if r[0] == 501][0][4] == 100_009
    pieces = corpus_pipeline.packing_stage(spark, df, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id is None) == sum(r.doc_tokens for r in pieces if r.doc_id is None and r.start == 0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0
