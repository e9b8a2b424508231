import random
import re

import pytest

from quillon.llm import shingle_join


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    """(n, component) per row, by all pairs."""
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(len(s[i]), least.get(find(i)) if s[i] else rows[i][0]) for i in range(len(rows))]


def check(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS n", "1 AS cid", "2 AS h")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_groups(df, words=k, percent=percent).collect())
    want = sorted((d is None, d, n, c) for (d, _), (n, c) in zip(rows, brute(rows, k, percent), strict=True))
    assert got == want


def corpus(seed, families=6, per=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = rng.choices(vocabulary, k=25)
    rows, number = [], 100
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([12, 40, 90, 150]))
        for _ in range(per):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary) if rng.random() < 0.8 else words[0].upper()
            if rng.random() < 0.3:
                words = boiler + words
            rows.append((number, " ".join(words)))
            number += 1
    rows += [(number + i, " ".join(rng.choices(vocabulary, k=30) + boiler)) for i in range(15)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_components_equal_all_pairs(spark, seed, k, percent):
    extra = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "one two"), (7, "one\x0btwo"), (8, "one\xa0two"), (9, "É a b"), (10, "é a b"),
             (None, "null id here now"), (11, "null id here now"), (12, "same row"), (12, "same row"), (13, "a b c d e f g"), (13, "other text under one id")]
    check(spark, corpus(seed) + extra + [(50, "ab " * 5000), (51, "ab " * 5001)], k, percent)


def test_chain_of_links_without_a_centre(spark):
    words = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join([f"y{j}" for j in range(i)] + words[i:])))
    check(spark, rows, 3, 90)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shingle_join.near_groups(df).count() == 0


@pytest.mark.parametrize(("seed", "k", "percent"), [(3, 3, 90), (4, 5, 80)])
def test_links_equal_all_pairs(spark, seed, k, percent):
    """Every link, also between texts that other links join already."""
    rows = corpus(seed, families=4, per=10) + [(1, None), (2, ""), (4, "one"), (5, "One"), (6, "one two"), (12, "same row"), (12, "same row")]
    rows += [(None, "null id here now"), (11, "null id here now"), (13, "a b c d e f g"), (13, "other text under one id")]
    long = [f"z{i}" for i in range(200)]
    rows += [(60 + i, " ".join(long[:-1] + [f"end{i}"])) for i in range(4)]
    s = [sets(t, k) for _, t in rows]

    def linked(i, j):
        both = len(s[i] & s[j])
        return i != j and s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both)

    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((d is None, d, len(s[i]), sum(bool(linked(i, j)) for j in range(len(rows)))) for i, (d, _) in enumerate(rows))
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.n_links) for r in shingle_join.link_counts(df, words=k, percent=percent).collect())
    assert got == want
    pairs, members = shingle_join.near_links(df, words=k, percent=percent)
    listed = [(r.a, r.b) for r in pairs.collect()]
    distinct = list({x for x in s if x})
    index = [s.index(x) for x in distinct]
    assert len(listed) == len(set(listed)) == sum(bool(linked(i, j)) for i in index for j in index) // 2
    assert all(a < b for a, b in listed) and members.where("cid IS NOT NULL").select("cid").distinct().count() == len(distinct)
