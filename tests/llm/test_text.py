"""Tokenizer, mixing, foul content: round trips, brute force, held-out accuracy, odd rows."""

import random

import pytest

pytest.importorskip("lodevec.llm")

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodevec.llm import foul, mixing, pretokens, tokenizer

ODD = ["", " ", "\n", None, "it's 'll  x\n\n y", "<|endoftext|> [PAD]", "a​b \U0001f600 猫٣ é", "\r\nx\t \ty ", "'s't're", "x" * 5000, " " * 3000 + "a", "ab" * 40000, "same", "same", "　a\xa0b", "''s '''ve 'D"]
DOCS = "doc_id long, text string, word string, chunk long, ids string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", 1, "i", " A\t" if i % 2 else "b") for i, t in enumerate(ODD)] + [(None, "x y", None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_pretokens_equal_the_pattern():
    pat = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = list("aZé1²'’ \n\t\r　.-猫٣\U0001f600s t ll re ve d m''  \x85\x1c")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    b, off = pretokens.buffer_of(pa.array(texts))
    at = pretokens.starts(b, off)
    raw, cut = b.tobytes(), np.searchsorted(at, off)
    for i, t in enumerate(texts):
        s = [*at[cut[i] : cut[i + 1]], off[i + 1]]
        assert [raw[x:y].decode() for x, y in zip(s, s[1:])] == pat.findall(t), repr(t)


@pytest.mark.parametrize("chunk", [50, 16 << 20])
def test_ids_equal_the_tokenizer(docs, hf, chunk):
    got = tokenizer.encode_corpus(docs, chunk_bytes=chunk).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = "x y" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == hf.encode(text, add_special_tokens=False).ids


def test_decoding_is_the_inverse(docs):
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs)).collect()
    assert {r.doc_id: r.text for r in back if r.doc_id is not None} == {i: t or "" for i, t in enumerate(ODD)}


def test_counts_and_empty_tables(docs, hf):
    n = {r.doc_id: r.n_tokens for r in tokenizer.token_counts(docs, ["doc_id"]).collect()}
    assert all(n[i] == len(hf.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD))
    none = docs.where("false")
    assert tokenizer.encode_corpus(none).count() == 0 and tokenizer.token_counts(none, ["doc_id"]).count() == 0


def test_mix_plan_and_copies(spark):
    rows = [(i, "tok " * 10, " Big " if i % 2 else "big") for i in range(300)] + [(1000 + i, "tok " * 10, "small") for i in range(20)] + [(5000, None, "small"), (5001, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("BIG ", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), ("none", None, None), (None, 0.5, 1)], "source string, target_share double, max_uses int")
    p = {r.src: r for r in mixing.mix_plan(d, t).collect()}
    assert set(p) == {"big", "small", "none"} and p["big"].tokens > 2900 and not p["big"].short and p["small"].short and p["none"].short and p["none"].rate == 2.0
    assert p["small"].rate == 3.0 and 0.4 < p["big"].rate < 0.6
    plan = mixing.mix_plan(d, t)
    a = mixing.emit(d, plan, seed=1)
    got = a.groupBy("src", "doc_id").agg(F.max("copy").alias("c"), F.count("*").alias("n")).collect()
    assert all(r.c == r.n <= {"big": 1, "small": 3}[r.src] for r in got)
    assert sum(r.n for r in got if r.src == "small") == 63
    assert 110 < sum(r.n for r in got if r.src == "big") < 230
    again = mixing.emit(d.repartition(7), plan, seed=1)
    assert a.exceptAll(again).count() == 0
    rep = {r.source: r for r in mixing.report(d, t).collect()}
    assert rep["none"].copies == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    empty = mixing.mix_plan(d.where("false"), t).collect()
    assert len(empty) == 3 and not any(r.short for r in empty)


def _corpus():
    rng = random.Random(3)
    plain = ["we load the bright sensor", "the window settles after 12 steps", "print(rows[:10])", "compare the valve with the river", "shut the lab before you leave"]
    bad = ["you are a stupid moron", "go kill yourself you idiot", "send nudes you slut", "all of them are vermin and must burn"]
    docs, labels = [], []
    for i in range(900):
        lines = [rng.choice(plain) for _ in range(rng.randint(3, 9))]
        foul_ = i % 5 == 0
        if foul_:
            lines.insert(rng.randrange(len(lines)), "# " + rng.choice(bad))
        docs.append((i, "\n".join(lines)))
        y = int(foul_) if rng.random() > 0.03 else 1 - int(foul_)
        labels.append((i, y if i % 97 else None))
    return docs, labels


def test_foul_held_out_and_disguised(spark):
    docs, labels = _corpus()
    disguised = ["x\n# yоu are a st#p#d m0r0n", "x\ngo kіll yourself you i-d-i-o-t", "x\nyou are a stuuuupid ｍｏｒｏｎ", "x\\nyou are a st\\u0443pid mor\\u043en", "x\n# y o u  a r e  a  s t u p i d  m o r o n", "x\n# y_o_u a_r_e a s_t_u_p_i_d m_o_r_o_n", "x\n# you are a\n# stupid moron", "compare the valve with the river"]
    extra = [(5000 + i, t) for i, t in enumerate(disguised)] + [(6000, None), (6001, ""), (6002, "  "), (6003, "a " * 60000)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([x for x in labels if x[0] < 600], "doc_id long, toxic int").withColumn("text", F.lit(1))
    s = {r.doc_id: r.score for r in foul.scores(d, lab).collect()}
    held = range(600, 900)
    wrong = sum((s[i] >= foul.FOUL) != (i % 5 == 0) for i in held)
    assert wrong <= 6
    assert all(s[5000 + i] >= foul.FOUL for i in range(7)) and s[5007] < foul.FOUL
    assert s[6000] == s[6001] == s[6002] == 0.0 and s[6003] < foul.FOUL
    p = foul.passages(d.where("doc_id in (600, 605, 601)"), lab).collect()
    text = dict(docs)
    assert all(text[r.doc_id][r.start : r.end] == r.passage for r in p)


def test_foul_wrapped_and_spaced_words():
    def sentences(t):
        h, _, sent, row, _, _, letters, of = foul.read(pa.array([t]))
        assert len(letters) == len(of) and len(row) == (sent.max() + 1 if len(sent) else 0)
        return sent.max() + 1 if len(sent) else 0, [int(x) for x in h]

    assert sentences("# so it is\n# no crime")[0] == 1 and sentences('"so it is\\n",\n  "no crime"')[0] == 1
    assert sentences("so it is.\nno crime")[0] == 2 and sentences("so it is\nNo crime")[0] == 2 and sentences("f(x)\n1 no crime")[0] == 2
    assert sentences("SO IT IS,\nNO CRIME")[0] == 1
    assert sentences("y_o_u m_o_r_o_n")[1] == sentences("you moron")[1]
    assert sentences("m o r o n")[1] == sentences("moron")[1]
    for t in ("", "\n", ".", "a", "# \n#"):
        sentences(t)


def test_foul_learns_from_unlabelled(spark):
    """Words that no labelled document holds are learnt from unlabelled ones, where known words stand beside them."""
    rng = random.Random(4)
    plain = ["we load the bright sensor", "the window settles soon", "print the first rows", "compare the valve with the river"]
    docs, labels = [], []
    for i in range(600):
        lines = [rng.choice(plain) for _ in range(5)]
        if i % 4 == 0:
            lines.append("you are a stupid moron" if i < 300 else "a stupid moron, du bleiches wurmgesicht")
        docs.append((i, "\n".join(lines)))
        if i < 300:
            labels.append((i, int(i % 4 == 0)))
    docs.append((900, "we load the bright sensor\ndu bleiches wurmgesicht"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    before = foul.scores(d, lab, guess_foul=0, guess_clean=0).where("doc_id = 900").first().score
    after = foul.scores(d, lab).where("doc_id = 900").first().score
    assert before < 0.1 and after > 3 * before


def test_foul_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "you moron"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in foul.scores(d, none).collect()] == pytest.approx([0.0, 0.0])
    assert foul.scores(d.where("false"), none).count() == 0


def test_rates_by_source(spark):
    d = spark.createDataFrame([(1, "a", " A "), (2, "b", "a"), (3, None, None)], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.src: r.n_docs for r in foul.rates(d, lab).collect()} == {"a": 2, None: 1}
