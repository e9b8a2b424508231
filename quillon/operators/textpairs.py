"""Operators over text pairs: token tables, weighted overlap, negation and polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as X


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    user = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    reply = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"])


def token_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per token: pos, token, word, stem, alt, weight, negator, scale."""
    rows = df.select(*keys, F.col(text).rlike(r"^[A-Za-z0-9]").alias("_opens"), F.posexplode(X.tokens(F.col(text))).alias("pos", "token"))
    first = (F.col("pos") == 0) & F.col("_opens")
    return rows.select(
        *keys,
        "pos",
        "token",
        X.normal_form(F.col("token")).alias("word"),
        X.stem(F.col("token")).alias("stem"),
        X.alternate(F.col("token")).alias("alt"),
        X.weight(F.col("token"), first).alias("weight"),
        X.is_negator(F.col("token")).alias("negator"),
        X.scale(F.col("token")).alias("scale"),
    )


def token_array(text: Column, most: int | None = X.MOST_TOKENS) -> Column:
    """The tokens of a text in place: an array of word, stem, alt, weight, numeric; ``most`` is the score's cap, None reads all."""
    opens = F.coalesce(text.rlike(r"^[A-Za-z0-9]"), F.lit(False))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(X.TOKEN), F.lit(0)) if most is None else X.tokens(text, most)

    def token(t: Column, i: Column) -> Column:
        return F.struct(
            X.normal_form(t).alias("word"), X.stem(t).alias("stem"), X.alternate(t).alias("alt"), X.weight(t, (i == 0) & opens).alias("weight"), X.is_numeric(t).alias("numeric")
        )

    return F.transform(found, token)


def token_forms(tokens: Column) -> Column:
    """Every word, stem and alternate form in an array of tokens."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.array(t["word"], t["stem"], t["alt"]))))


def overlap(pairs: DataFrame, keys: list[str], answer: str, truth: str, question: str) -> DataFrame:
    """Weighted precision, recall and their blend. A token matches on word, stem or alternate form; answer tokens that only
    the question has count a third. Row by row: nothing is exploded, joined or shuffled."""
    rows = pairs.select(*keys, token_array(F.col(answer)).alias("_a"), token_array(F.col(truth)).alias("_t"), token_array(F.col(question)).alias("_q"))
    rows = rows.select(*keys, "_a", "_t", *(token_forms(F.col(f"_{c}")).alias(f"_{c}f") for c in "atq"))
    matches = lambda t, forms: F.arrays_overlap(F.array(t["word"], t["stem"], t["alt"]), F.col(forms))
    add = lambda tokens, of: F.aggregate(tokens, F.lit(0.0), lambda total, t: total + of(t))
    hit = lambda forms: lambda t: F.when(matches(t, forms), t["weight"]).otherwise(0.0)
    asked_only = lambda t: F.when(matches(t, "_tf"), t["weight"]).when(matches(t, "_qf"), 0.35 * t["weight"]).otherwise(t["weight"])
    sums = rows.select(
        *keys, add("_a", hit("_tf")).alias("hit"), add("_a", asked_only).alias("total"), add("_t", hit("_af")).alias("found"), add("_t", lambda t: t["weight"]).alias("wanted")
    )
    x = F.coalesce(F.try_divide(F.col("hit"), F.col("total")), F.lit(0.0))
    both = sums.withColumn("precision", x * (2 - x)).withColumn("recall", F.coalesce(F.try_divide(F.col("found"), F.col("wanted")), F.lit(0.0)))
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("blend", F.coalesce(F.try_divide(1.36 * p * r, 0.36 * p + r), F.lit(0.0)))


def content_bigrams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stems of neighbouring content tokens, stopwords skipped."""
    order = Window.partitionBy(*keys).orderBy("pos")
    return rows.where("weight > 0.5").withColumn("after", F.lead("stem").over(order)).where("after IS NOT NULL").select(*keys, F.concat_ws(" ", "stem", "after").alias("bigram"))


#: Where a clause ends; a comma or point between digits belongs to its figure.
CLAUSE_END = r"(?:[;!?:]|(?<![0-9])[,.]|[,.](?![0-9]))+"


def negated(df: DataFrame, key: str, text: str, reach: int = 4) -> DataFrame:
    """Tokens within the reach of a negator in their own clause: one row per token with its mark."""
    clauses = df.select(key, F.posexplode(F.split(F.col(text), CLAUSE_END)).alias("clause", "part"))
    whole = F.regexp_extract_all(F.coalesce("part", F.lit("")), F.lit(X.TOKEN), F.lit(0))
    rows = clauses.select(key, "clause", F.posexplode(whole).alias("pos", "token")).withColumn("word", X.normal_form(F.col("token")))
    near = Window.partitionBy(key, "clause").orderBy("pos").rowsBetween(-reach, -1)
    return rows.withColumn("negated", F.coalesce(F.max(X.is_negator(F.col("token"))).over(near), F.lit(False)))


def polarities(rows: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Per axis the sign of the first decisive token, turned by negation, and whether both signs occur; the rows are read once for all axes."""

    def sign(axis: str) -> Column:
        for_it, against = X.axis_words(axis)
        one = F.when(F.col("word").isin(*for_it), 1).when(F.col("word").isin(*against), -1)
        return F.struct(F.lit(axis).alias("axis"), F.when(F.col("negated"), -one).otherwise(one).alias("sign"))

    decisive = rows.where(F.col("word").isin(*(w for a in axes for words in X.axis_words(a) for w in words)))
    signed = decisive.select(key, F.struct("clause", "pos").alias("at"), F.explode(F.array(*map(sign, axes))).alias("x")).select(key, "at", "x.axis", "x.sign").where("sign IS NOT NULL")
    return signed.groupBy(key, "axis").agg(F.min_by("sign", "at").alias("sign"), (F.min("sign") != F.max("sign")).alias("mixed"))


def entity_figures(text: Column, reach: int = 4) -> Column:
    """Figures of a text with the nearest capitalised word within so many tokens, the earlier of two; figures without one are left out."""
    words = X.tokens(text)
    named = lambda t: t.rlike("^[A-Z]") & ~X.is_numeric(t)

    def nearest(i: Column) -> Column:
        around = F.transform(F.array(*(F.lit(side * d) for d in range(1, reach + 1) for side in (-1, 1))), lambda d: F.get(words, i + d))
        return F.get(F.filter(around, lambda t: F.coalesce(named(t), F.lit(False))), F.lit(0))

    figures = F.filter(F.transform(words, lambda t, i: F.when(t.rlike("^[0-9]"), F.struct(t.alias("figure"), nearest(i).alias("entity")))), lambda f: f.isNotNull())
    return F.filter(figures, lambda f: f["entity"].isNotNull())
