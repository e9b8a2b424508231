"""Catalogue queries over conversations and documents: tokens, grams, overlap and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.facts import CLEAR, CLOUDY, SIGNAL, WET
from quillon.functions.tables import AXES, NEGATORS, NUMERALS, SCALES, STOPWORDS
from quillon.operators import textpairs as P
from quillon.plans.catalogue import register
from quillon.session import table

_W = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
_TOKEN = rf"(?:{_W}*[0-9][.,])*[0-9]{_W}*|{_W}+"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NUM = "CASE low " + " ".join(f"WHEN '{w}' THEN '{d}'" for w, d in NUMERALS.items()) + " ELSE low END"
_PAIRS = """SELECT a.conv_id, b.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'"""


def _tokens_sql(source: str, keys: str, text: str, most: str = "[1:2048]") -> str:
    """SQL for the token table: keys, pos from 0, token, word, numeric, stem, weight."""
    return f"""
  SELECT *, CASE WHEN numeric THEN word WHEN n >= 7 AND low LIKE '%ing' THEN left(low, length(low) - 3)
      WHEN n >= 6 AND (low LIKE '%ed' OR low LIKE '%ly' OR low LIKE '%es') THEN left(low, length(low) - 2)
      WHEN n >= 5 AND low LIKE '%s' THEN left(low, length(low) - 1) ELSE low END AS stem,
    CASE WHEN numeric THEN word WHEN n >= 5 AND low LIKE '%ed' THEN left(low, length(low) - 1)
      WHEN regexp_matches(token, '^[0-9]') THEN replace(regexp_extract(token, '^[0-9.,]+'), ',', '') ELSE low END AS alt,
    CASE WHEN numeric THEN 3.0 WHEN word IN {_IN(STOPWORDS)} THEN 0.12 WHEN regexp_matches(token, '[\\x{{80}}-\\x{{10FFFF}}]') THEN 0.5
      ELSE 1.0 + 0.06 * least(12, n) + CASE WHEN NOT (pos = 0 AND opens) AND regexp_matches(token, '^[A-Z]') THEN 1.3 ELSE 0 END END AS weight
  FROM (SELECT *, {_NUM} AS word, octet_length(encode(token)) AS n,
      (regexp_matches(token, '[0-9]') AND NOT regexp_matches(token, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]')) OR low IN {_IN(NUMERALS)} AS numeric
    FROM (SELECT *, replace({_LOW('token')}, ',', '') AS low FROM (
      SELECT {keys}, opens, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM (
        SELECT {keys}, regexp_matches({text}, '^[A-Za-z0-9]') AS opens, regexp_extract_all({text}, '{_TOKEN}'){most} AS toks FROM {source}))))"""


@register("bm25_pairs", rf"""
WITH p AS ({_PAIRS}), t AS (SELECT conv_id, turn,
    list_filter(list_transform(regexp_extract_all(question, '[\p{{L}}\p{{N}}]+'), lambda x: {_LOW('x')}), lambda x: octet_length(encode(x)) >= 2)[1:256] AS q,
    list_filter(list_transform(regexp_extract_all(answer, '[\p{{L}}\p{{N}}]+'), lambda x: {_LOW('x')}), lambda x: octet_length(encode(x)) >= 2)[1:256] AS d FROM p),
n AS (SELECT conv_id, turn, unnest(q) AS term, d, len(q) AS nq, len(d) AS nd FROM t),
f AS (SELECT *, len(list_filter(d, lambda x: x = term)) AS tf, 1.5 * (0.25 + 0.75 * nd / ((nq + nd) / 2.0)) AS norm FROM n)
SELECT conv_id, turn, round(least(1, sum(tf * 2.5 / (tf + norm)) / (max(nq) * 2.5)), 6) AS score FROM f GROUP BY conv_id, turn""")
def bm25_pairs(spark, sf_dir):
    pairs = P.conversation_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", X.bm25_terms(F.col("question")).alias("q"), X.bm25_terms(F.col("answer")).alias("d")).select("conv_id", "turn", F.round(X.bm25(F.col("q"), F.col("d")), 6).alias("score"))


@register("token_weights", f"""
WITH t AS ({_tokens_sql('documents', 'doc_id', 'text', '')})
SELECT doc_id, count(*) AS n, round(CAST(sum(weight) AS DOUBLE), 4) AS total, count(*) FILTER (WHERE weight > 0.5) AS content, count(*) FILTER (WHERE numeric) AS figures FROM t GROUP BY doc_id""")
def token_weights(spark, sf_dir):
    """Whole texts: the score's cap on tokens does not apply."""
    read = table(spark, sf_dir, "documents").select("doc_id", X.weights(F.col("text"), None).alias("w")).where(F.size("w") > 0)
    count = lambda test: F.size(F.filter("w", test)).cast("bigint")
    return read.select(
        "doc_id", F.size("w").cast("bigint").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, w: a + w), 4).alias("total"),
        count(lambda w: w > 0.5).alias("content"), count(lambda w: w == 3.0).alias("figures"),
    )


@register("stem_alt", f"""
WITH t AS ({_tokens_sql('conversations', 'conv_id, turn', 'text')})
SELECT stem, alt, count(*) AS n FROM t GROUP BY stem, alt""")
def stem_alt(spark, sf_dir):
    return P.token_rows(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").groupBy("stem", "alt").agg(F.count("*").alias("n"))


@register("number_words", f"""
WITH t AS ({_tokens_sql('documents', 'doc_id', 'text', '')})
SELECT doc_id, count(*) FILTER (WHERE numeric) AS figures, count(*) FILTER (WHERE low IN {_IN(NUMERALS)}) AS spelled, coalesce(string_agg(word, '|' ORDER BY pos) FILTER (WHERE low IN {_IN(NUMERALS)}), '') AS words FROM t GROUP BY doc_id""")
def number_words(spark, sf_dir):
    """Spelled numbers of whole documents, as digits."""
    read = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.TOKEN), F.lit(0)).alias("t")).where(F.size("t") > 0)
    spelled = F.filter("t", lambda t: F.regexp_replace(X.ascii_lower(t), ",", "").isin(*NUMERALS))
    return read.select("doc_id", F.size(F.filter("t", X.is_numeric)).cast("bigint").alias("figures"), F.size(spelled).cast("bigint").alias("spelled"), F.array_join(F.transform(spelled, X.normal_form), "|").alias("words"))


def _grams_sql(column: str, n: int) -> str:
    flat = rf"regexp_replace({_LOW(column)}, '[^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')"
    return f"list_distinct(list_transform(range(1, greatest(length({flat}) - {n - 1}, 0) + 1), lambda i: substring({flat}, i, {n})))"


@register("char_gram_dice", f"""
WITH p AS ({_PAIRS}), g AS (SELECT conv_id, turn, {_grams_sql('question', 3)} AS a, {_grams_sql('answer', 3)} AS b FROM p)
SELECT conv_id, turn, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice, round(len(list_intersect(a, b)) * 1.0 / len(a), 6) AS inside FROM g""")
def char_gram_dice(spark, sf_dir):
    pairs = P.conversation_pairs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", X.char_grams(F.col("question"), 3).alias("a"), X.char_grams(F.col("answer"), 3).alias("b"))
    return pairs.select("conv_id", "turn", F.round(X.dice(F.col("a"), F.col("b")), 6).alias("dice"), F.round(X.containment(F.col("a"), F.col("b")), 6).alias("inside"))


@register("content_bigram_dice", f"""
WITH t AS ({_tokens_sql('conversations', 'conv_id, turn, role', 'text')}), c AS (SELECT conv_id, turn, role, stem || ' ' || lead(stem) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM t WHERE weight > 0.5),
s AS (SELECT conv_id, turn, role, list(DISTINCT g) FILTER (WHERE g IS NOT NULL) AS gs FROM c GROUP BY ALL)
SELECT a.conv_id, b.turn, round(2.0 * len(list_intersect(a.gs, b.gs)) / (len(a.gs) + len(b.gs)), 6) AS dice FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'
WHERE len(a.gs) > 0 AND len(b.gs) > 0""")
def content_bigram_dice(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    grams = P.content_bigrams(P.token_rows(turns, ["conv_id", "turn", "role"], "text"), ["conv_id", "turn", "role"])
    sets = grams.groupBy("conv_id", "turn", "role").agg(F.collect_set("bigram").alias("g"))
    user = sets.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("g").alias("a"))
    reply = sets.where("role = 'assistant'").select("conv_id", "turn", F.col("g").alias("b"))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.dice(F.col("a"), F.col("b")), 6).alias("dice"))


_NEGATED_SQL = rf"""
  SELECT *, coalesce(max(CASE WHEN word IN {_IN(NEGATORS)} THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, clause ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) = 1 AS negated FROM (
    SELECT item_id, clause, pos, {_NUM} AS word FROM (SELECT item_id, clause, unnest(range(len(toks))) AS pos, replace({_LOW('unnest(toks)')}, ',', '') AS low FROM (
      SELECT item_id, clause, regexp_extract_all(translate(part, chr(57344) || chr(57345), '.,'), '{_TOKEN}') AS toks FROM (
        SELECT item_id, unnest(range(len(parts))) AS clause, unnest(parts) AS part FROM (SELECT item_id, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g'), '([0-9]),([0-9])', '\1' || chr(57345) || '\2', 'g'), '[,;!?:.]+') AS parts FROM src)))))"""
_SOURCE_SQL = """src AS (SELECT doc_id AS item_id, CASE doc_id % 4 WHEN 0 THEN 'It is not true that prices rose. ' WHEN 1 THEN 'No, the claim is false, never confirmed: ' WHEN 2 THEN 'Yes, real growth without loss. ' ELSE '' END || coalesce(text, '') AS text FROM documents)"""


def _claims(spark, sf_dir):
    lead = F.element_at(F.array(*(F.lit(x) for x in ("It is not true that prices rose. ", "No, the claim is false, never confirmed: ", "Yes, real growth without loss. ", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))


@register("negation_marks", f"WITH {_SOURCE_SQL}, t AS ({_NEGATED_SQL}) SELECT item_id, count(*) AS n, count(*) FILTER (WHERE negated) AS negated FROM t GROUP BY item_id")
def negation_marks(spark, sf_dir):
    return P.negated(_claims(spark, sf_dir), "item_id", "text").groupBy("item_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("negated"), 1)).alias("negated"))


def _axis_sql(axis: str) -> str:
    a, b = AXES[axis]
    return f"""SELECT item_id, '{axis}' AS axis, arg_min(s, (clause, pos)) AS sign, count(DISTINCT s) > 1 AS mixed FROM (
      SELECT item_id, clause, pos, CAST(CASE WHEN negated THEN -1 ELSE 1 END * CASE WHEN word IN {_IN(a)} THEN 1 WHEN word IN {_IN(b)} THEN -1 END AS INTEGER) AS s FROM t) WHERE s IS NOT NULL GROUP BY item_id"""


@register("polarity_axes", f"WITH {_SOURCE_SQL}, t AS ({_NEGATED_SQL}) " + " UNION ALL ".join(_axis_sql(a) for a in AXES))
def polarity_axes(spark, sf_dir):
    return P.polarities(P.negated(_claims(spark, sf_dir), "item_id", "text"), "item_id", list(AXES)).select("item_id", "axis", "sign", "mixed")


@register("precision_recall_f", f"""
WITH p AS (SELECT a.conv_id, b.turn, coalesce(c.text, '') AS asked, a.text AS truth, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'
  LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1),
a AS ({_tokens_sql('p', 'conv_id, turn', 'answer')}), t AS ({_tokens_sql('p', 'conv_id, turn', 'truth')}), q AS ({_tokens_sql('p', 'conv_id, turn', 'asked')}),
af AS (SELECT DISTINCT conv_id, turn, unnest([word, stem, alt]) AS form FROM a), tf AS (SELECT DISTINCT conv_id, turn, unnest([word, stem, alt]) AS form FROM t), qf AS (SELECT DISTINCT conv_id, turn, unnest([word, stem, alt]) AS form FROM q),
ah AS (SELECT a.conv_id, a.turn, a.pos, a.weight, bool_or(f.form IS NOT NULL) AS hit FROM a LEFT JOIN tf f ON a.conv_id = f.conv_id AND a.turn = f.turn AND f.form IN (a.word, a.stem, a.alt) GROUP BY ALL),
aq AS (SELECT a.conv_id, a.turn, a.pos, bool_or(f.form IS NOT NULL) AS asked FROM a LEFT JOIN qf f ON a.conv_id = f.conv_id AND a.turn = f.turn AND f.form IN (a.word, a.stem, a.alt) GROUP BY ALL),
th AS (SELECT t.conv_id, t.turn, t.pos, t.weight, bool_or(f.form IS NOT NULL) AS hit FROM t LEFT JOIN af f ON t.conv_id = f.conv_id AND t.turn = f.turn AND f.form IN (t.word, t.stem, t.alt) GROUP BY ALL),
pr AS (SELECT conv_id, turn, sum(CASE WHEN hit THEN weight ELSE 0 END) / sum(CASE WHEN NOT hit AND asked THEN 0.35 * weight ELSE weight END) AS x FROM ah JOIN aq USING (conv_id, turn, pos) GROUP BY ALL),
re AS (SELECT conv_id, turn, sum(CASE WHEN hit THEN weight ELSE 0 END) / sum(weight) AS r FROM th GROUP BY ALL),
j AS (SELECT conv_id, turn, x * (2 - x) AS p, r FROM pr JOIN re USING (conv_id, turn))
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN 0.36 * p + r = 0 THEN 0 ELSE 1.36 * p * r / (0.36 * p + r) END, 6) AS blend FROM j""")
def precision_recall_f(spark, sf_dir):
    """Each answer against its user turn as the truth, with the turn before that as the question."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("asked"))
    pairs = P.conversation_pairs(turns).withColumnRenamed("question", "truth").join(asked, ["conv_id", "turn"], "left")
    found = P.overlap(pairs, ["conv_id", "turn"], "answer", "truth", "asked")
    return found.select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "blend")))


@register("normalized_dupes", f"""
WITH n AS (SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: {_LOW('x')}), ' ')) AS k FROM documents)
SELECT k, min(doc_id) AS first, count(*) AS n FROM n GROUP BY k HAVING count(*) > 1""")
def normalized_dupes(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(X.normal_text(F.col("text")), "UTF-8")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")


@register("fnv32_hash", """
SELECT item_id, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST(('0x' || b) AS BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261) AS h FROM benchmark""")
def fnv32_hash(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.fnv32(F.col("text")).alias("h"))


def _spaced_sql(column: str) -> str:
    return rf"' ' || regexp_replace({_LOW(column)}, '[^A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+', '  ', 'g') || ' '"


_COUNT = lambda words: f"CAST(len(regexp_extract_all(t, ' (?:{'|'.join(words)}) ')) AS BIGINT)"


@register("word_counts", f"""
WITH t AS (SELECT doc_id, {_spaced_sql('text')} AS t FROM documents)
SELECT doc_id, {_COUNT(WET['check'])} AS wet, {_COUNT(CLEAR['check'])} AS clear, {_COUNT(CLOUDY['check'])} AS cloudy FROM t""")
def word_counts(spark, sf_dir):
    """Words of wet, clear and cloudy weather in each document."""
    lists = {"wet": WET["check"], "clear": CLEAR["check"], "cloudy": CLOUDY["check"]}
    return table(spark, sf_dir, "documents").select("doc_id", *(X.whole_word_count(F.col("text"), w).cast("bigint").alias(n) for n, w in lists.items()))


@register("signal_gate", f"""
WITH t AS (SELECT doc_id, {_spaced_sql('text')} AS t FROM documents)
SELECT doc_id, regexp_matches(t, ' (?:{'|'.join(SIGNAL['check'])}) ') AS current, regexp_matches(t, ' (?:{'|'.join(SIGNAL['forecast'])}) ') AS forecast FROM t""")
def signal_gate(spark, sf_dir):
    """Whether a document speaks of the weather, by the words of each lane."""
    said = lambda lane: X.whole_word_count(F.col("text"), SIGNAL[lane]) > 0
    return table(spark, sf_dir, "documents").select("doc_id", said("check").alias("current"), said("forecast").alias("forecast"))


@register("figure_values", rf"""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{X.FIGURE}')) AS m FROM documents),
v AS (SELECT doc_id, CAST(replace(regexp_extract(m, '^[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) AS n, {_LOW("regexp_extract(m, '([A-Za-z]*)$', 1)")} AS s FROM f)
SELECT doc_id, count(*) AS figures, max(n * CASE s {" ".join(f"WHEN '{w}' THEN 1e{p}" for w, p in SCALES.items())} ELSE 1e0 END) AS largest, count(*) FILTER (WHERE s IN {_IN(SCALES)}) AS scaled FROM v GROUP BY doc_id""")
def figure_values(spark, sf_dir):
    """Figures of each document with their scale words applied."""
    read = table(spark, sf_dir, "documents").select("doc_id", X.figure_values(F.col("text")).alias("v")).where(F.size("v") > 0)
    return read.select("doc_id", F.size("v").cast("bigint").alias("figures"), F.array_max(F.transform("v", lambda v: v["value"])).alias("largest"), F.size(F.filter("v", lambda v: v["scale"] > 0)).cast("bigint").alias("scaled"))


@register("close_figures", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + (l_linenumber - 3) / 400.0) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN greatest(abs(a), abs(b)) = 0 THEN true ELSE abs(a - b) / greatest(abs(a), abs(b)) <= 0.005 END AS close FROM p""")
def close_figures(spark, sf_dir):
    """Whether two figures lie within half a percent of the larger."""
    a = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.close(a, a * (1 + (F.col("l_linenumber") - 3) / 400.0)).alias("close"))


@register("entity_figures")
def entity_figures(spark, sf_dir):
    """Each figure of a document with the capitalised word nearest to it (tests hold it to literal results)."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(P.entity_figures(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.figure", "f.entity")
