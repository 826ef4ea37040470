import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quartzfolio.llm import pieces as pc
from quartzfolio.llm import queries
from quartzfolio.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pairs(tmp_path_factory):
    """For each kind of model, our encoder and the library's."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = pc.UNIGRAM
    for p in proto.pieces:  # flatter scores, so that long pieces are worth it
        if p.type == pc.NORMAL:
            p.score = -8 + max(p.score, -40_000.0) / 8000
    path = str(tmp_path_factory.mktemp("models") / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    return [(pc.Encoder(pc.load(x)), sentencepiece.SentencePieceProcessor(model_file=x)) for x in (PATH, path)]


TEXTS = ["", " ", "   a", "Hello  world\n x é🐘 \t", "\n\n", "aaaaaaaaaaaaa", "ab▁cd  ", "<s> <unk> <0x0A>", "日本語テキスト мир 안녕", "x" * 300, "the thing " * 50, "\x00﻿‍ a"]


@pytest.mark.parametrize("text", TEXTS)
def test_byte_pair_ids_are_those_of_the_library(pairs, text):
    ours, theirs = pairs[0]
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == theirs.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abethrsin ▁\n.,"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(pairs, text):
    ours, theirs = pairs[0]
    (ids,) = ours.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text)
    assert pc.decode(ours.m, ids) == text.replace("▁", " ")


def test_unigram_scores_are_those_of_the_library(pairs):
    ours, theirs = pairs[1]
    texts = [*TEXTS, "internationalisation of the understanding", "Ertion sheand thinblely onerent"]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        got, want = np.frombuffer(ids, "<u4").tolist(), theirs.encode(t)
        total = lambda x: sum(theirs.get_score(i) for i in x)
        assert got == want or (total(got) == pytest.approx(total(want)) and theirs.decode(got) == theirs.decode(want))


def test_documents(spark, sf_dir, pairs):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in queries.op6_pieces(spark, sf_dir).collect()}
    for r in docs.collect():
        want = np.array(pairs[0][1].encode(r["text"]), "<u4")
        g = got[r["doc_id"]]
        assert (g["n_pieces"], g["ids_crc32"], g["round_trip"]) == (len(want), zlib.crc32(want.tobytes()), True)
    assert len(got) == docs.count()


def test_odd_rows(spark):
    model = pc.load(PATH)
    rows = [(1, None, b"x"), (1, None, b"x"), (2, "", b"x"), (3, "a" * 2000 + " b", b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    out = docs.select("doc_id", "text", pc.encoded(docs, model).alias("ids"))
    got = out.withColumn("back", pc.decoded(out, model)).collect()
    assert [(r["text"], r["back"]) for r in got] == [(t, t) for _, t, _ in rows]
    assert [r["ids"] for r in got][:3] == [None, None, b""]
    assert out.where(F.lit(False)).count() == 0


def test_forgetting_changes_nothing(monkeypatch, pairs):
    monkeypatch.setattr(pc, "REMEMBERED", 5)
    fresh = pc.Encoder(pairs[0][0].m)
    texts = ["one two three four five six", "seven eight one two", "x" * 50]
    assert [fresh.encode([t])[0] for t in texts] == pairs[0][0].encode(texts)


def test_words_end_between_letters_and_signs():
    m = pc.load(PATH)
    assert m.signs_alone and m.words.findall("▁ab,▁▁c1d\n▁") == ["▁ab", ",", "▁▁c", "1", "d", "\n", "▁"]
    crossing = pc.Model(pc.BPE, [*m.pieces, "b,"], np.append(m.scores, -1.0), np.append(m.types, pc.NORMAL))
    assert not crossing.signs_alone and crossing.words.findall("▁ab,") == ["▁ab,"]


LATIN = st.text(alphabet=st.one_of(st.sampled_from("abethrsin  \n\t.,!_|0²×é"), st.characters(max_codepoint=255)), max_size=60)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), LATIN), max_size=8))
def test_latin_texts_together(pairs, texts):
    for ours, theirs in pairs[:1]:
        got = ours.encode(texts)
        assert [None if x is None else np.frombuffer(x, "<u4").tolist() for x in got] == [None if t is None else theirs.encode(t) for t in texts]
    unigram = pairs[1][0]
    assert [x for x, t in zip(unigram.encode(texts), texts, strict=True) if t] == unigram.of_words([unigram.m.words.findall(pc.BLANK + t.replace(" ", pc.BLANK)) for t in texts if t])


def test_latin_texts_are_split_without_the_expression(monkeypatch, pairs):
    ours = pc.Encoder(pairs[0][0].m)
    texts = [f"Some words, çà et là {i}!!\n  more_of them " + "-" * i for i in range(40)]
    merged = []
    monkeypatch.setattr(pc.Model, "merged", lambda self, x, *y: merged.append(len(x)))
    monkeypatch.setattr(ours.m, "words", None)
    monkeypatch.setattr(ours, "of_words", lambda split: [np.array(pairs[0][1].encode("x")).astype("<u4").tobytes() for _ in split])  # of more than sixteen signs
    short = texts[:15]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(short)] == [pairs[0][1].encode(t) for t in short]
    assert len(ours.encode(texts)) == 40 and sum(merged) == 0


@pytest.mark.parametrize("words", [1, 3, 1 << 19])
def test_small_tables_and_parts_change_nothing(monkeypatch, pairs, words):
    monkeypatch.setattr(pc, "MOST_WORDS", words)
    monkeypatch.setattr(pc, "TOGETHER", 30)
    monkeypatch.setattr(pc, "REMEMBERED", 2)
    texts = ["one two three four five six", None, "", "seven eight one two", " \n ", "y" * 50 + " one", "one \x00 two", "one ▁ two", "a" * 16 + " " + "b" * 17, "ÿ" * 3000]
    fresh, theirs = pc.Encoder(pairs[0][0].m), pairs[0][1]
    want = [None if t is None else theirs.encode(t) for t in texts]
    for _ in range(2):
        assert [None if x is None else np.frombuffer(x, "<u4").tolist() for x in fresh.encode(texts)] == want


@pytest.mark.parametrize("ranks", [1, 7, 10_000])
def test_neighbours_stay_apart_as_merging_says(ranks):
    """Also in models whose ranks are tied, or where a piece comes before its parts."""
    rng = np.random.default_rng(ranks)
    pieces = ["a", "b", "c"] + sorted({"".join(rng.choice(list("abc"), n)) for n in rng.integers(2, 6, 90).tolist()})
    m = pc.Model(pc.BPE, pieces, -rng.integers(0, ranks, len(pieces)).astype(float), np.full(len(pieces), pc.NORMAL))
    e = pc.Encoder(m)
    made = np.flatnonzero(e.stable)
    left, right = (x.ravel() for x in np.meshgrid(made, made))
    want = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        got = m.merged(np.array([[*e.chars_of[a], *e.chars_of[b]]], np.int64))[0]
        want.append(got[got >= 0].tolist() == [a, b])
    assert e.stay_apart(left, right).tolist() == want
    assert ranks == 1 or (any(want) and 0 < e.sorted.sum() < len(pieces))


def test_neighbours_of_a_trained_model_are_found_without_merging(monkeypatch, pairs):
    ours = pc.Encoder(pairs[0][0].m)
    made = np.array([i for i in ours.m.usable if ours.sorted[i]])
    assert len(made) > 0.99 * len(ours.m.usable)
    left, right = np.random.default_rng(6).choice(made, (2, 3000))
    got = ours.stay_apart(left, right)
    monkeypatch.setattr(ours, "sorted", np.zeros(len(ours.sorted), bool))
    assert ours.stay_apart(left, right).tolist() == got.tolist() and 0 < got.mean() < 1
