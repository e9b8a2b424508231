import math
import random

import pytest

from quillon.llm import top_k


def brute(rows, k=10, every=100):
    """Every row counts; the products of all rows of a query id are ranked together."""
    seen = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = {}
    for q, a in seen:
        if q % every == 0:
            found.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in seen if i != q)
    return sorted((q, r, i, -s) for q, scored in found.items() for r, (s, i) in enumerate(sorted(scored)[:k], 1))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 150)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 4)
    monkeypatch.setattr(top_k, "STEP_ROWS", 40)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    return sorted(tuple(r) for r in top_k.top_k(df).collect())


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(2)
    f = lambda x: struct_float(x)
    rows = [(i, [f(rng.gauss(0, 1) * (0.1 + i % 7)) for _ in range(20)]) for i in range(900)]
    rows += [(1000 + i, [f(0.5)] * 20) for i in range(300)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (None, [1.0] * 20), (2100, []), (2200, [f(3.0)] * 4), rows[5], rows[5], rows[100], (300, [f(0.25)] * 20)]
    assert run(spark, rows) == brute(rows)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (3, [0.5, 0.25]), (200, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_large_components_are_exact(spark):
    rows = [(0, [float(1 << 18), 3.0]), (1, [float(1 << 18), 1.0]), (2, [float(1 << 18), 2.0])]
    assert run(spark, rows) == brute(rows)


def test_a_third_of_the_rows_alike_also_under_one_id(spark):
    rng = random.Random(5)
    f = struct_float
    rows = [(i, [f(rng.gauss(0, 1)) for _ in range(8)]) for i in range(600)]
    rows += [(7, [f(1.5)] * 8)] * 400 + [(7, rows[9][1]), (1, rows[0][1]), (1, rows[0][1])]
    assert run(spark, rows) == brute(rows)


def test_scores_beyond_64_bits_are_cut_but_ranked_wide(spark):
    rows = [(0, [3e30, 1.0]), (1, [1e30, 0.0]), (2, [2e30, 0.0]), (3, [-1e30, 0.0]), (4, [-2e30, 5.0]), (5, [0.0, 2.0])]
    got = run(spark, rows)
    assert [(r, i) for _, r, i, _ in got] == [(1, 2), (2, 1), (3, 5), (4, 3), (5, 4)]
    assert [s for *_, s in got] == [(1 << 63) - 1, (1 << 63) - 1, 1024 * 2048, -(1 << 63), -(1 << 63)]


def test_blocks_out_of_reach_are_left_out(spark):
    """Needs and lengths: what a query does not reach is never scored, and the answer stays exact."""
    need = top_k.need_of(top_k.np.array([10.0, -1.0, 5.0, float("-inf")]), top_k.np.array([2.0, 2.0, 0.0, 1.0]))
    assert need[0] == pytest.approx(5) and need[1] == need[3] == float("-inf") and need[2] == float("inf")


def test_no_row_holds_a_block_and_queries_go_out_in_rounds(spark, monkeypatch):
    """What is written between the steps are single vectors, whatever the size of the table; several rounds give the same rows."""
    monkeypatch.setattr(top_k, "ROUND_BYTES", 8 * 20 * 4, raising=False)
    widest = []

    class Watched(top_k.Scratch):
        def keep(self, df):
            kept = super().keep(df)
            for name, kind in kept.dtypes:
                if kind == "binary" or kind.startswith("array"):
                    size = top_k.F.octet_length(name) if kind == "binary" else 8 * top_k.F.size(name)
                    widest.append(kept.agg(top_k.F.max(size)).first()[0] or 0)
            return kept

    monkeypatch.setattr(top_k, "Scratch", Watched)
    rng = random.Random(8)
    rows = [(i, [struct_float(rng.gauss(0, 1) * (0.2 + i % 3)) for _ in range(20)]) for i in range(1100)]
    rows += [(1100 + i, [struct_float(1.25)] * 20) for i in range(200)]
    assert run(spark, rows) == brute(rows)
    assert max(widest) == 8 * 20
