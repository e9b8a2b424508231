"""N-gram Jaccard join with grouped prefixes, and the groups of documents that its links make.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with one set form a class, and all work is on
classes. The steps:

1. Sieve. Of each set only the smallest hashes are looked at, a few more than the prefix that a link must share. Whoever
   shares too few of them with anybody has no link and is done: this is most of a corpus.
2. Prefixes. Over the classes that are left, shingles are counted. The most frequent ones, at most ``FREQUENT`` of them, are
   put last, by how many classes have them; all others come first, by hash. Any one order of all shingles makes prefixes that
   linked sets must share; this one keeps hot shingles out of them, and needs no shuffle of the sets.
3. Groups. Classes with identical prefixes and size form one group; prefixes are posted once per group, and a shingle that
   only one group posts is dropped.
4. Hubs. For each posted shingle the group in which it stands earliest is the hub. Members are verified against one hub's
   first member, and the links found give first components.
5. The rest. Posted shingles whose groups lie in one component need no more work. For the others, groups (now split by
   component) outside the shingle's largest component meet the groups of other components, under the length and position
   filters; pairs that pass are expanded to members and verified. Pairs within one component are never formed, so a large
   family of near copies costs about its size, and no link between components is lost.

That is near_groups(). The join itself is near_links(): after step 3 all groups that share a posted shingle meet, also inside
a component, and every pair of classes that passes is verified; link_counts() derives each row's number of links from it. Its
cost grows with the number of links, thus with the square of the distinct texts in a family.

Tables that a later step joins are written first, so both sides of a join are plain exchanges, which adaptive execution can
split where one key has very many rows. Each is deleted once no later step reads it.

Defined cases: texts without words, and null texts, have no set, link with nothing and form components of their own; texts
with fewer words than a shingle have one shingle, the whole sequence; rows are documents, so repeated rows are linked
copies, and rows that share an id but not the text are judged apart; null ids are allowed (a component's id is the smallest
id that is not null); an empty table gives an empty result; other columns are ignored. Texts are read whole. Sets are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.batches import map_batches
from quillon.llm.components import components
from quillon.llm.worker import LONGEST_KEPT, claim, entry_bytes
from quillon.session import Scratch, table, tidy

WORDS, PERCENT = 5, 80
QUERY_WORDS, QUERY_PERCENT = 3, 90
#: Bytes of word hashes that a Python worker keeps.
CACHE_BYTES = 32 << 20
#: A list of ids is broadcast up to this many rows; beyond that it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: So many of the most frequent shingles are put last; their list goes to the driver and to the workers, 16 bytes each.
FREQUENT = 1 << 19
#: Shingles of fewer classes than this are never put last.
LEAST_FREQUENT = 8


class WordHashes(dict):
    """word -> hash; forgotten when the words take more than ``CACHE_BYTES``, and never kept when long."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            self.held += entry_bytes(word) + 32
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[word] = h
        return h

    def forget(self) -> None:
        self.clear()
        self.held = 0


_HASHES = WordHashes()


def claim_hashes() -> None:
    """Word hashes are kept for the life of a Python worker, or until another operator needs the room."""
    claim("shingle_join", _HASHES.forget)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; only A-Z are lower-cased, only ASCII white space separates."""
    found = text.encode("utf-8").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i : len(h) - n + 1 + i] + np.uint64(i + 1))
    return np.unique(_mixed(total))


def most_missing(n, percent: int):
    """How many shingles of a set of size n a link can lack: n - ceil(percent * n / 100)."""
    return n - (percent * n + 99) // 100


def sieve_extra(n, percent: int):
    """Hashes looked at beyond the prefix."""
    return (most_missing(n, percent) + 1) // 2


def _sets(df: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, text_hash, n, cid, hashes: the whole set, or what the sieve looks at.

    A class that a task has met before gets no hashes again, so copies are gone before anything is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        claim_hashes()
        met: set[int] = set()
        nothing = np.empty(0, np.uint64)
        for batch in batches:
            sizes, ids, parts = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, words)
                cid = int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))
                sizes.append(len(s))
                ids.append(cid)
                if cid in met:
                    parts.append(nothing)
                    continue
                met.add(cid)
                parts.append(s if whole else s[: most_missing(len(s), percent) + 1 + sieve_extra(len(s), percent)])
            flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "text_hash", "n", "cid", "hashes"],
            )

    return map_batches(df.select("doc_id", "text_hash", "text"), work, "doc_id bigint, text_hash bigint, n bigint, cid bigint, hashes array<bigint>")


def _semi(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """df's rows whose column is in wanted; wanted is broadcast only when it was counted and is small."""
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(wanted) if small else wanted, column, "left_semi")


def _overlap_needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """The least overlap of a link: ceil(percent * (a + b) / (100 + percent))."""
    return F.floor((percent * (n_a + n_b) + 100 + percent - 1) / F.lit(100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links."""
    one = lambda c: sets.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"set_{c}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return met.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _sieve(read: DataFrame, words: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, n, cid of every row; and one text_hash for each class that shares enough of its smallest hashes."""
    looked = scratch.keep(_sets(read, words, percent, False).withColumn("row", F.monotonically_increasing_id()))
    rows = looked.where("n > 0").select("row", "cid", F.explode("hashes").alias("h"))
    common = scratch.keep(rows.groupBy("h").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high").select("h"))
    met = rows.select("row", "h").join(common, "h", "left_semi").groupBy("row").agg(F.count("*").alias("met"))
    small = looked.where("n > 0 AND size(hashes) > 0").select("row", "cid", "n", "text_hash")
    least = F.floor((percent * F.col("n") + 99) / 100)
    left = small.join(met, "row").where(F.col("met") > sieve_extra_column(least, percent))
    wanted = scratch.keep(left.groupBy("cid").agg(F.min("text_hash").alias("text_hash")).select("text_hash"))
    seen = scratch.keep(looked.drop("hashes", "row"))
    scratch.drop(looked, common)
    return seen, wanted


def _survivors(read: DataFrame, wanted: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """cid, n, hashes: the whole sets of the classes that the sieve left."""
    sets = _sets(_semi(read, wanted, "text_hash"), words, percent, True).where(F.size("hashes") > 0)
    return scratch.keep(sets.select("cid", "n", "hashes").dropDuplicates(["cid"]))


def frequent(sets: DataFrame, most: int, scratch: Scratch) -> np.ndarray:
    """The most frequent shingles, most frequent last: all with a count above the least power of two that leaves at most ``most``."""
    counted = scratch.keep(
        sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") >= LEAST_FREQUENT)
    )
    power = F.floor(F.log2("df")).cast("int")
    sizes = counted.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
    taken, least = 0, None
    for r in sizes:
        taken += r["count"]
        if taken > most:
            break
        least = r["power"]
    rows = counted.where(power >= least).toPandas() if least is not None else None
    scratch.drop(counted)
    if rows is None:
        return np.empty(0, np.int64)
    return rows.sort_values(["df", "h"])["h"].to_numpy(np.int64)


def _prefixes(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """cid, n, g, prefix: the shingles of each prefix in order; g is the group of equal prefix and size.

    Written without the sets; the list of frequent shingles is bounded by ``FREQUENT``.
    """
    hot = frequent(sets, FREQUENT, scratch)
    by_hash = np.argsort(hot, kind="stable")
    sent = sets.sparkSession.sparkContext.broadcast((hot[by_hash], by_hash.astype(np.int32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, rank = sent.value
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            late = np.full(len(flat), -1, np.int64)
            if len(known) and len(flat):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                late = np.where(known[at] == flat, rank[at], -1)
            prefixes, groups = [], []
            for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
                h, order = flat[end - n : end], late[end - n : end]
                kept = np.lexsort((h, order))[: most_missing(n, percent) + 1]
                prefixes.append(h[kept])
                groups.append(xxhash.xxh3_64_intdigest(prefixes[-1].tobytes(), seed=n & 0xFFFFFFFF))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(groups, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))],
                ["cid", "n", "g", "prefix"],
            )

    made = scratch.keep(map_batches(sets.select("cid", "n", "hashes"), work, "cid bigint, n bigint, g bigint, prefix array<bigint>"))
    sent.destroy()
    return made


def _posts(prefixed: DataFrame, scratch: Scratch) -> DataFrame:
    """g, n, h, pos: a row for each shingle that a group posts and another one posts too."""
    groups = prefixed.select("g", "n", "prefix").dropDuplicates(["g"])
    every = scratch.keep(groups.select("g", "n", F.posexplode("prefix").alias("pos", "h")))
    several = scratch.keep(every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    posts = scratch.keep(every.join(several, "h", "left_semi").select("g", "n", "h", "pos"))
    scratch.drop(every, several)
    return posts


def all_links(read: DataFrame, wanted: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Every link (a, b), a < b, between classes."""
    sets = _survivors(read, wanted, words, percent, scratch)
    prefixed = _prefixes(sets, percent, scratch)
    posts = _posts(prefixed, scratch)
    members = prefixed.select("cid", "g")
    x, y = (posts.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("g", "n", "pos"))) for side in "xy")
    across = (
        x.join(y, "h")
        .where(F.col("g_x") < F.col("g_y"))
        .where(_passes(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), percent))
        .select("g_x", "g_y")
        .distinct()
    )
    met = scratch.keep(across.unionByName(members.groupBy("g").count().where("count > 1").select(F.col("g").alias("g_x"), F.col("g").alias("g_y"))))
    expanded = (
        met.join(members.select(F.col("g").alias("g_x"), F.col("cid").alias("a")), "g_x")
        .join(members.select(F.col("g").alias("g_y"), F.col("cid").alias("b")), "g_y")
        .where((F.col("g_x") != F.col("g_y")) | (F.col("a") < F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    links = scratch.keep(_verified(expanded, sets, percent))
    scratch.drop(sets, prefixed, posts, met)
    return links


def class_links(read: DataFrame, wanted: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes that join them to the components of the full join."""
    sets = _survivors(read, wanted, words, percent, scratch)
    prefixed = _prefixes(sets, percent, scratch)
    posts = _posts(prefixed, scratch)
    members = scratch.keep(prefixed.select("cid", "g"))
    scratch.drop(prefixed)
    hubs = scratch.keep(posts.groupBy("h").agg(F.min(F.struct("pos", "n", "g")).alias("hub")))
    near = scratch.keep(
        posts.join(hubs, "h")
        .where(F.col("g") != F.col("hub.g"))
        .where(_passes(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
        .groupBy("g")
        .agg(F.min(F.struct("hub.pos", "hub.n", "hub.g")).alias("hub"))
        .select("g", F.col("hub.g").alias("hub"))
    )
    first_of = scratch.keep(members.groupBy("g").agg(F.min("cid").alias("first")))
    to_own = members.join(first_of, "g").select(F.col("cid").alias("a"), F.col("first").alias("b"))
    to_hub = members.join(near, "g").join(first_of.select(F.col("g").alias("hub"), F.col("first").alias("b")), "hub").select(F.col("cid").alias("a"), "b")
    star = scratch.keep(to_own.unionByName(to_hub).where("a <> b").distinct())
    first_links = scratch.keep(_verified(star, sets, percent))
    scratch.drop(hubs, near, first_of, star)
    tidy(scratch.spark)
    roots = components(first_links, scratch)
    tidy(scratch.spark)

    # Groups are split by the component of their members, under numbers of their own.
    known = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = scratch.keep(known.withColumn("part", F.xxhash64("g", "root")))
    parts = scratch.keep(known.select("g", "root", "part").distinct())
    placed = scratch.keep(posts.join(parts, "g").select("h", "n", "pos", "root", "part"))
    largest = scratch.keep(
        placed.groupBy("h", "root")
        .agg(F.count("*").alias("k"))
        .groupBy("h")
        .agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots"))
        .where("roots > 1")
        .select("h", F.col("most.root").alias("main"))
    )
    mixed = scratch.keep(placed.join(largest, "h"))
    scratch.drop(posts, members, parts, placed, largest)
    x = mixed.where("root <> main").select("h", *(F.col(c).alias(f"{c}_x") for c in ("n", "pos", "root", "part")))
    y = mixed.select("h", "main", *(F.col(c).alias(f"{c}_y") for c in ("n", "pos", "root", "part")))
    pairs = scratch.keep(
        x.join(
            y,
            (x["h"] == y["h"])
            & (F.col("root_x") != F.col("root_y"))
            & ((F.col("root_y") == F.col("main")) | (F.col("part_x") < F.col("part_y")))
            & _passes(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), percent),
        )
        .select("part_x", "part_y")
        .distinct()
    )
    expanded = (
        pairs.join(known.select(F.col("part").alias("part_x"), F.col("cid").alias("a")), "part_x")
        .join(known.select(F.col("part").alias("part_y"), F.col("cid").alias("b")), "part_y")
        .select("a", "b")
    )
    links = scratch.keep(first_links.unionByName(_verified(expanded, sets, percent)))
    scratch.drop(sets, first_links, known, mixed, pairs)
    return links


def sieve_extra_column(n: Column, percent: int) -> Column:
    return F.floor((n - F.floor((percent * n + 99) / 100) + 1) / 2)


def _passes(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether sets whose first common shingle stands at these positions can be a link."""
    close = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return close & (F.least(n_a - pos_a, n_b - pos_b) >= _overlap_needed(n_a, n_b, percent))


def _read(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))


def near_links(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The whole join: (a, b), a < b, for every two classes that are linked, and doc_id, text_hash, n_shingles, cid per row.

    Rows of one class (cid) are linked copies of each other, which the pairs do not list; rows without a set have no cid.
    """
    read = _read(df, doc_id, text)
    with Scratch(df.sparkSession) as scratch:
        seen, wanted = _sieve(read, words, percent, scratch)
        links = all_links(read, wanted, words, percent, scratch)
    return links, seen.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid"))


def link_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, n_links per row: how many other rows it is linked with, copies included."""
    links, rows = near_links(df, doc_id, text, words, percent)
    with Scratch(df.sparkSession) as scratch:
        sizes = scratch.keep(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("k")))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(sizes.select(F.col("cid").alias("b"), "k"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("k").alias("others"))
        counted = scratch.keep(sizes.join(others, "cid", "left").select("cid", (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    return rows.join(counted, "cid", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, root per row.

    The root is a class of the component and tells components apart that have the same smallest doc_id; null without a set.
    """
    read = _read(df, doc_id, text)
    with Scratch(df.sparkSession) as scratch:
        seen, wanted = _sieve(read, words, percent, scratch)
        links = class_links(read, wanted, words, percent, scratch)
        roots = components(links, scratch)
        classes = seen.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
        rooted = scratch.keep(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
        whole = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
        named = scratch.keep(rooted.join(whole, "root").select("cid", "component_id", "root"))
        scratch.drop(wanted, links, rooted, whole)
    return (
        seen.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
        .join(named, "cid", "left")
        .select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=QUERY_WORDS, percent=QUERY_PERCENT).select("doc_id", "n_shingles", "component_id")
