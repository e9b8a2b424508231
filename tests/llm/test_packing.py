import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import packing

TEXTS = [None, "", " ", "a", "two  spaces", " lead", "trail ", "x \n y", "tab\t z", "a\x1c b", "a <|endoftext|> b<|endoftext|>", "é ü    x",
         "don't 've  12 345,67\n\n\nnew", "w " * 4000, "longword" * 1500, "🙂 🙂‍🙂"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path())


def test_pieces_equal_the_library_on_any_text(library):
    rng = np.random.default_rng(4)
    atoms = ["ab", "Été", "x", ".", ",!", "$$$", "'s", "'", "\n", "\n\n", " ", "  ", "\t", "7", "42", "<|", "<|endoftext|>", "|>", "_", "-", "ß", "中", "\xa0", "\x1d", "é", "🙂"]
    texts = ["".join(rng.choice(atoms, rng.integers(1, 12))) for _ in range(6000)]
    got = packing.PieceIds(packing.default_path()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def verify(rows, want):
    """want: doc_id -> ids with the end id."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc_id, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[doc_id])
            assert bytes(r.ids) == np.array(want[doc_id][at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(want[doc_id])
    groups = defaultdict(list)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at == own[0].tier and at & (at - 1) == 0
        assert len({r.step_group for r in own}) == 1
        groups[own[0].step_group].append(at)
    for sizes in groups.values():
        assert len(set(sizes)) == 1 and sum(sizes) <= packing.STEP_TOKENS
    return sequences


def test_pieces_cover_documents_and_fill_windows(spark, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = TEXTS + docs + docs[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("tier", packing.F.lit("clash"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    verify(packing.pack(df.repartition(3)).collect(), want)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one two"), (5, "same"), (5, "same")], "doc_id bigint, text string").coalesce(1)
    rows = packing.digest(packing.pack(df)).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert any(r.doc_id is None for r in rows)


@pytest.mark.parametrize("blocks", [1, 4])
def test_blocks_leave_one_tail(blocks):
    rng = np.random.default_rng(1)
    docs = []
    for i in range(400):
        n = int(rng.choice([1, 5, 127, 128, 129, 500, 1024, 1025, 3000]))
        docs.append(packing.Document(i, rng.integers(0, 50_000, n).astype("<u4").tobytes(), n))
    packer = packing.Packer(7 << 40)
    rows = [r for k in range(blocks) for r in packer.block(docs[k::blocks])]
    before = packer.sequences
    rows += list(packer.end())
    assert packer.sequences - before <= 24
    Row = __import__("collections").namedtuple("Row", [x.split()[0] for x in packing.SCHEMA.split(",")])
    verify([Row(*r) for r in rows], {d.doc_id: np.frombuffer(d.ids, "<u4").tolist() for d in docs})
    assert sum(r[2] for r in rows) == sum(d.tokens for d in docs)
    assert zlib.crc32(docs[0].ids) == zlib.crc32(b"".join(r[3] for r in sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])))


def test_new_words_are_asked_for_many_at_a_time():
    rng = random.Random(4)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ABCDEÀÉÖßñø", "абвгдежз", "漢字仮名交文", "ءآأب", "ªºʰⅰ𝒜", "é"]
    words = ["".join(rng.choice(s) for _ in range(rng.randint(1, 12))) for s in letters for _ in range(150)] + ["x" * 300, "don't", "Ġ", "ĠĠa", "a1"]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 90]) + end for i, end in zip(range(0, len(words), 90), ["", "\n", " ", "  a b", " \n c"] * 9)]
    encoder = packing.PieceIds(packing.default_path())
    library, asked = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, parts, **options):
            asked.extend(parts)
            return library.encode_batch_fast(parts, **options)

    encoder.tokenizer = Counted()
    got = encoder.encode(texts)
    assert got == [packing.array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert len(asked) < len(set(words)) / 4
    encoder.forget()
    encoder.spaced[:] = False  # ids that don't show where words begin
    assert encoder.encode(texts) == got


def test_a_batch_of_texts_is_not_cut_all_at_once():
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(words[(i * j) % 500] for j in range(12_000)) for i in range(1, 71)]
    assert sum(map(len, texts)) < 4 << 20
    encoder = packing.PieceIds(packing.default_path())
    encoder.encode([" ".join(words)])
    tracemalloc.start()
    got = encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(map(len, got)) + (24 << 20)


def test_kept_pieces_are_bounded_by_the_caller(spark):
    texts = [" ".join(f"{w}{i}x" for w in range(4000)) for i in range(30)]
    small, large = packing.PieceIds(packing.default_path(), 1 << 20), packing.PieceIds(packing.default_path())
    for text in texts:
        assert small.encode([text]) == large.encode([text])
        assert small.held < 3 << 20
    assert large.held > 20 << 20
    df = spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string").coalesce(1)
    assert packing.pack(df, cache_bytes=1).collect() == packing.pack(df).collect()
