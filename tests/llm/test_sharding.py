import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import sharding


def check(spark, rows, spread=None):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size long, shard long").repartition(5)
    got = sharding.shard(df).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, total = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if spread:
        mean = sum(total.values()) / 24
        assert all(abs(total[s] - mean) <= spread * mean for s in range(24)), total
    return got


def test_near_equal_bytes_with_a_hot_text_and_long_ones(spark):
    rows = [(i, "hot text " * 5) for i in range(2000)] + [(10_000 + i, f"w{i} " * (i % 50)) for i in range(4000)] + [(90_000, "x" * 9000)]
    check(spark, rows, 0.06)


def test_equal_texts_stay_together_where_they_fit(spark):
    rows = [(i, f"text {i // 3} " * 4) for i in range(3000)]
    got = check(spark, rows, 0.06)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert max(map(len, shards.values())) == 1


def test_nulls_repeats_and_empty(spark):
    check(spark, [(None, None), (None, None), (5, "a"), (5, "a"), (5, "b"), (6, "")])
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_rows_alike_in_every_respect(spark, doc_id):
    """A third and more of the table is one record repeated: shards are near equal all the same."""
    rows = [(doc_id, "one text that is repeated")] * 12_000 + [(100 + i, f"other text {i}") for i in range(8000)]
    got = check(spark, rows, 0.06)
    assert len({r.shard for r in got}) == 24


def test_records_far_larger_than_a_range(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, "x" * int(rng.choice([30, 300, 30_000], p=[0.8, 0.19, 0.01]))+ str(i)) for i in range(6000)], 0.2)


def test_places_by_key_and_tie():
    """Against the plain order of pairs."""
    rng = np.random.default_rng(1)
    cuts = sharding.Cuts(rng.integers(0, 20, 30), rng.integers(0, 1 << 31, 30))
    keys, ties = rng.integers(-3, 25, 3000), rng.integers(0, 1 << 31, 3000)
    keys[:30], ties[:30] = cuts.keys, cuts.ties
    splitters = list(zip(cuts.keys.tolist(), cuts.ties.tolist()))
    assert cuts.place(keys, ties).tolist() == [sum(s <= (k, t) for s in splitters) for k, t in zip(keys.tolist(), ties.tolist())]
