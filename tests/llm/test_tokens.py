"""Token output and packing: the library's ids, exact round trips and capacities."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strophe.llm import packing, tokens, vbyte

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.01"


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (WORDS, "words")])
def test_ids_are_the_library_s(path, kind):
    rng, own, ids = random.Random(3), tokens.Encoder(path, kind, limit=50_000), library(path)
    letters = "ab é'sßtß.,-  \n\t  12#AZ  \r\x0b\x1c\x85\xa0ж東<|²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(8000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "", " ", "  ", "\n", "a" * 5000, "it's they'll I'VE"]
    for t, got in zip(texts, [ids for part in own.slices(texts, chars=1000) for ids in part], strict=True):
        assert got.tolist() == ids(t), repr(t)
    assert own.ids("one more").tolist() == ids("one more")


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = vbyte.pack(values)
        assert len(control) == -(-n // 4)
        assert vbyte.unpack(control, data, n).tolist() == values.tolist()


def test_token_files(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    files = vbyte.write(docs, BYTES, "bytes", 0, block_tokens=20_000)
    got = {r["doc_id"]: r for r in vbyte.digest(vbyte.read(spark, files)).collect()}
    ids, start = library(BYTES), 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        own = [*ids(r["text"] or ""), 0]
        want = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == want
        start += len(own)
    ranks = spark.read.parquet(files.ranks).orderBy("rank").toPandas()
    assert ranks["rank"].tolist() == list(range(len(ranks)))


def test_file_edges(spark):
    schema = "doc_id long, text string, ids int, width string"
    df = spark.createDataFrame([(2, "b", 1, "x"), (1, None, 1, "x"), (None, "a", 1, "x"), (2, "", 1, "x"), (2, "b", 1, "x")], schema)
    rows = vbyte.read(spark, vbyte.write(df, BYTES, "bytes", 0)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (2, 4, 2), (2, 6, 2)]
    assert vbyte.digest(vbyte.read(spark, vbyte.write(df.limit(0), BYTES, "bytes", 0))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.zipf(1.4, 600), 100)
    capacity = np.array([100.0, 7, 4000.0])
    sequence, offset = packing.best_fit(lengths, capacity, np.array([1, 0.1, 0.1]), rule)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 7 and (own**2).sum() <= max(4000, own[0] ** 2)
        order = np.argsort(offset[sequence == s])
        assert offset[sequence == s][order].tolist() == np.r_[0, np.cumsum(own[order])[:-1]].tolist()


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    cut = packing.pieces(docs, WORDS, "words", 1)
    got = packing.pack(cut).toPandas()
    ids = library(WORDS)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        own = np.array([*ids(r["text"] or ""), 1], "<u4")
        for k, at in enumerate(range(0, len(own), 4096)):
            want[r["doc_id"], k] = (at, len(own[at : at + 4096]), zlib.crc32(own[at : at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 4096 and g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 4096 + 1


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 20_000, 3)], "doc_id long, text string, length int")
    got = packing.pack(packing.pieces(df, WORDS, "words", 1)).toPandas()
    assert got["length"].sum() == 3 + 20_001 and (got["length"] <= 4096).all()
    assert packing.pack(packing.pieces(df.limit(0), WORDS, "words", 1)).count() == 0


def test_many_words_are_encoded_once(monkeypatch):
    """The workers of the token files hold the pieces of 160,000 words until they come again."""
    monkeypatch.setattr(tokens, "_encoders", {})
    made, seen = tokens.encoder(BYTES, "bytes", vbyte.CACHE), []
    piece = made.pieces.make
    made.pieces.make = lambda x: seen.append(x) or piece(x)
    rng = random.Random(9)
    words = list({"".join(rng.choices("abcdefghij", k=9)) for _ in range(160_000)})
    text = " ".join(["start", *words])
    first = made.ids(text)
    count = len(seen)
    assert made.ids(text).tolist() == first.tolist()
    assert len(seen) == count == len(words) + 2  # the first one without a blank too


def test_a_worker_s_share_of_invented_words_is_encoded_once(monkeypatch):
    """A part of the large table has 600,000 pieces, half of which stand in the next part too."""
    monkeypatch.setattr(tokens, "_encoders", {})
    made, seen = tokens.encoder(BYTES, "bytes", vbyte.CACHE), [0]
    piece = made.pieces.make

    def counted(x):
        seen[0] += 1
        return piece(x)

    made.pieces.make = counted
    rng = random.Random(11)
    words = list({"".join(rng.choices("abcdefghij", k=9)) for _ in range(500_000)})
    text = " ".join(["start", *words])
    first = made.ids(text)
    assert np.array_equal(made.ids(text), first) and seen[0] == len(words) + 2  # the first one without a blank too


@pytest.mark.parametrize(("path", "kind"), [(BYTES, "bytes"), (WORDS, "words")])
def test_ids_gathered_in_groups_of_texts(path, kind, monkeypatch):
    monkeypatch.setattr(tokens, "GATHERED", 5)
    rng, ids = random.Random(4), library(path)
    texts = [" ".join(rng.choices(["word", "Wort,", "été.\nEt", "x1", "", "it's"], k=rng.choice([0, 1, 3, 5, 40]))) for _ in range(300)]
    for some in (texts, texts[:1], ["", ""], ["a b c d e", "f"]):
        assert [x.tolist() for x in tokens.Encoder(path, kind).batch(some)] == [ids(t) for t in some]
