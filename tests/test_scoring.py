import pytest

from quillon.functions import scoring as S


def raw(truth, answer, question="what will the weather be"):
    return S.raw_score(question.encode(), truth.encode(), answer.encode())


def test_exact_text_is_near_one_and_any_other_is_lower():
    truth = "Heavy rain of 12 mm is expected in Lisbon on Tuesday"
    assert raw(truth, truth) >= 0.98 and raw(truth, truth.upper()) >= 0.98
    less = raw(truth, "Heavy rain is expected in Lisbon")
    assert 0.3 < less < raw(truth, truth) and raw(truth, "The committee adjourned") < 0.2


def test_negation_wrong_figures_and_dilution_cost():
    truth = "The bridge carries 40 trains daily"
    assert raw(truth, "The bridge carries 40 trains daily and more") > raw(truth, "The bridge never carries 40 trains daily")
    assert raw(truth, "bridge carries 40 trains") > raw(truth, "bridge carries 55 trains")
    assert raw(truth, "carries forty trains daily bridge") > 0.8


def test_bridge_number_words_and_endings():
    a, b = S.read_tokens(b"NASA launched"), S.read_tokens(b"the National Aeronautics Space Administration")
    assert S.bridged(a, b)[0] == {0}
    t = S.read_tokens(b"seven landed 22C, not warm. fine")
    assert t.word[0] == b"7" and t.alt[1] == b"lande" and t.stem[1] == b"land" and t.alt[2] == b"22"
    assert t.negated == [False, False, False, False, True, False]


@pytest.mark.parametrize("lane", ["check", "forecast"])
def test_slots_stay_in_their_band(lane):
    for value in (0.0, 0.01, 0.5, 0.93, 1.0):
        got = S.tie_slot(value, 12345, lane)
        width = S.ZERO_SLOTS if value == 0 else S.HIGH_WIDTH[lane] if value >= 0.9 else S.LOW_WIDTH[lane]
        assert 0 <= got < 1 and abs(got - value) <= width / 1e6


def test_known_hashes_and_contrast():
    assert S.fnv64(b"foobar") == 0x85944171F73967E8
    assert S.contrast(1.0) == 1.0 and S.contrast(0.0) == 0.0
    grid = [S.contrast(i / 1000) for i in range(1001)]
    assert grid[910] < grid[950] < grid[990]


def test_sql_function_and_empty_answers(spark):
    S.register_functions(spark)
    row = spark.sql("SELECT rank_answer('q', 'the red barn', 'the red barn') AS a, rank_answer('q', 'the red barn', '') AS b, rank_answer(NULL, NULL, NULL) AS c").first()
    assert row.a > 0.8 and row.b < 0.001 and row.c < 0.001


def test_clauses_keep_figures_whole_and_overlap_uses_the_question(spark):
    from pyspark.sql import functions as F

    from quillon.functions import text as X
    from quillon.operators import textpairs as P

    df = spark.createDataFrame([(1, "not 1,000 or 3.14 gain. loss")], "k int, t string")
    marks = {r.token: r.negated for r in P.negated(df, "k", "t").collect()}
    assert marks == {"not": False, "1,000": True, "or": True, "3.14": True, "gain": True, "loss": False}
    pairs = spark.createDataFrame([(1, "alpha beta gamma", "alpha", "beta")], "k int, a string, t string, q string")
    r = P.overlap(pairs, ["k"], "a", "t", "q").first()
    w = lambda n: 1 + 0.06 * n
    x = w(5) / (w(5) + 0.35 * w(4) + w(5))
    assert abs(r.precision - x * (2 - x)) < 1e-9 and r.recall == 1
    found = spark.createDataFrame([("In 2020 Oslo sold 1,500 k of 3 million to Rome 7 far away from any of the others 9",)], "t string")
    values = found.select(X.figure_values(F.col("t")).alias("v")).first().v
    assert [(v.value, v.scale) for v in values] == [(2020.0, 0), (1500_000.0, 3), (3_000_000.0, 6), (7.0, 0), (9.0, 0)]
    named = found.select(P.entity_figures(F.col("t")).alias("f")).first().f
    assert [(f.figure, f.entity) for f in named] == [("2020", "In"), ("1,500", "Oslo"), ("3", "Rome"), ("7", "Rome")]


def test_bridges():
    """Against every pair of tokens; 2,048 acronyms cost no more than their number."""
    import random
    import re
    import time

    def every_pair(a, b):
        content = [i for i in range(len(b.word)) if b.weight[i] > 0.5]
        ours, theirs = set(), set()
        for i, token in enumerate(a.raw):
            if re.fullmatch(rb"[A-Z]{2,4}", token):
                key = token.lower()
                named = {j for j, w in enumerate(b.raw) if w[:1].isupper() and len(w) > len(key) and w.lower().startswith(key)}
                runs = [content[x : x + len(key)] for x in range(len(content) - len(key) + 1)]
                found = named | {j for run in runs if bytes(b.raw[j].lower()[0] for j in run) == key for j in run}
                ours |= {i} if found else set()
                theirs |= found
        return ours, theirs

    draw = random.Random(5)
    word = lambda: draw.choice([str.lower, str.upper, str.title])("".join(draw.choice("abé1") for _ in range(draw.randint(1, 5))))
    for _ in range(300):
        a, b = (S.read_tokens(" ".join(word() for _ in range(draw.randint(0, 12))).encode()) for _ in range(2))
        assert S.bridged(a, b) == every_pair(a, b)
    many = S.read_tokens(b" ".join(bytes([65 + i % 26, 65 + i // 26 % 26, 65 + i % 7]) for i in range(2048)))
    start = time.process_time()
    S.bridged(many, many)
    assert time.process_time() - start < 0.5


def test_axes_are_read_in_one_pass(spark, tmp_path):
    from quillon.plans.catalogue import QUERIES

    spark.createDataFrame([(3, "Not a rise, yes. It fell; a fake"), (7, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["polarity_axes"](spark, str(tmp_path))
    assert {(r.item_id, r.axis, r.sign, r.mixed) for r in got.collect()} == {(3, "direction", -1, False), (3, "verdict", 1, False), (3, "authenticity", -1, False)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
