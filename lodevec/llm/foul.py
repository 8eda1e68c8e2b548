"""Abusive, hateful and sexual content: a score for each document and the passages behind it.

Method: multiple-instance learning. A document is a bag of sentences; a sentence has the
probability of a logistic model over its words; the document's is their noisy-or,
``1 - prod(1 - p)``. Only documents have labels: the gradient of the noisy-or tells which sentences
of a foul document carry it. Raters err, so the likelihood holds a share of wrong labels
(``WRONG_POSITIVE``, ``WRONG_NEGATIVE``). Sentences whose own probability is high are the passages.

Text is read as a person would read it: escapes of notebook files are resolved, full-width and
look-alike letters folded, invisible characters dropped, s_p_a_c_e_d letters joined; all vowels, the
digits and signs that stand for letters, and their repeats become one vowel mark, so that every
disguise of a word has the word's own skeleton. A line break is a sentence's end only where the sentence
does not go on behind it (comments and strings are wrapped). Features are hashed: words, word stems, pairs of
words, pairs with one between, runs of letters over the blanks; of scripts without spaces, characters and their pairs.
All of it is array work over a whole column at once, whole texts included.

A first model is fitted on at most ``FIT_FOUL + FIT_CLEAN`` labelled documents (lowest hash of the id;
weights restore the shares), in one task. It judges every document; at most ``GUESS_FOUL`` unlabelled ones
it holds for foul and ``GUESS_CLEAN`` it holds for clean (lowest hash again) join the labelled ones with
that guess as their label, and the model is fitted anew: words that stand beside the known ones, and rarer
forms and disguises of them, get their weight from there. All four bounds are parameters. Every document is then scored in one
narrow stage. The weights that travel are a fixed ``2 ** FEATURE_BITS`` numbers.

Defined results: null, empty and blank texts have score 0; a document with several labels counts with
their mean, null labels don't count; without any label at all every score is 0; repeated rows give a row
each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm import pretokens
from lodevec.sources.tables import code

FIT_FOUL = 1024
FIT_CLEAN = 3072
GUESS_FOUL, GUESS_CLEAN = 4096, 2048
SURE_GUESS = 0.5, 0.05  # scores from which, and below which, an unlabelled document teaches
FEATURE_BITS = 18
WRONG_POSITIVE, WRONG_NEGATIVE = 0.05, 0.08
LEAST_DOCS = 2
SURE_FOUL, SURE_CLEAN = 3.0, -1.5  # standard deviations
FOUL = 0.4  # score from which a document, or a sentence, counts as foul
RUN = 5  # letters of a letter run
LONGEST = 32  # words of a sentence; longer ones are cut
SLICE = 2 << 20

# Letters of other scripts that look like Latin ones.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
VOWELS = "aeiou"
MARK = ord("~")  # the vowel mark
AS_VOWEL = "0134@#%*"  # digits and signs that stand for vowels beside letters
SEPARATORS = " _-.+*"
ENDS = "\n.!?。！？\""
FULL_STOPS = ".!?。！？"
WRAPS = " \n\"',#>*.:"  # what may stand between the halves of a sentence that a line break parts
_LETTER, _WIDE, _AS_VOWEL, _DOLLAR, _SEP, _END = 1, 2, 3, 4, 5, 6


@functools.cache
def fold_table() -> np.ndarray:
    """Every code point's plain form; 0 drops it."""
    t = np.arange(0x110000, dtype=np.uint32)
    for c in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Cf", "Me"):
            t[c] = 0
            continue
        flat = "".join(x for x in unicodedata.normalize("NFKD", ch.lower()) if unicodedata.category(x) != "Mn")
        if len(flat) == 1:
            flat = LOOKALIKE.get(flat, flat)
            t[c] = ord(flat)
        elif flat[:1].isascii() and flat[:1].isalpha():
            t[c] = ord(flat[0])
    for c in range(ord("A"), ord("Z") + 1):
        t[c] = c + 32
    for c in (*range(0, 9), *range(14, 32)):
        t[c] = 0x20
    for c in (0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029):
        t[c] = 0x0A
    t[0x09] = t[0xA0] = t[0x3000] = 0x20
    t[0x200B : 0x2010] = 0
    t[0xDF] = ord("s")
    return t


@functools.cache
def kind_table() -> np.ndarray:
    """Class of each plain form."""
    k = np.zeros(0x110000, np.uint8)
    wide = pretokens.class_table() == pretokens.LETTER
    k[wide] = _WIDE
    k[ord("a") : ord("z") + 1] = _LETTER
    k[MARK] = 0
    for c in AS_VOWEL:
        k[ord(c)] = _AS_VOWEL
    k[ord("$")] = _DOLLAR
    for c in ENDS:
        k[ord(c)] = _END
    k[0] = _END  # a row's edge
    return k


def _unescape(cp: np.ndarray) -> np.ndarray | None:
    """Resolve ``\\uXXXX``, ``\\n`` and ``\\"`` of notebook files; returns the kept positions."""
    at = np.flatnonzero(cp[:-1] == 0x5C) if len(cp) > 1 else np.zeros(0, np.int64)
    if not len(at):
        return None
    keep = np.ones(len(cp), bool)
    nxt = cp[at + 1]
    line = at[nxt == 0x6E]
    cp[line] = 0x0A
    keep[line + 1] = False
    keep[at[nxt == 0x22]] = False
    u = at[(nxt == 0x75) & (at + 5 < len(cp))]
    if len(u):
        val, ok = np.zeros(len(u), np.uint32), np.ones(len(u), bool)
        for k in range(2, 6):
            c = cp[u + k]
            digit = (c >= 48) & (c <= 57)
            low = c | 0x20
            alpha = (low >= 97) & (low <= 102)
            ok &= digit | alpha
            val = (val << 4) | np.where(digit, c - 48, low - 87)
        u, val = u[ok], val[ok]
        cp[u] = np.where((val >= 0xD800) & (val < 0xE000), 0x20, val)
        for k in range(1, 6):
            keep[u + k] = False
    return keep


@functools.cache
def wrap_table() -> np.ndarray:
    """1 for what may stand inside a wrapped sentence, 2 for the end marks among it."""
    t = np.zeros(0x110000, np.uint8)
    for c in WRAPS:
        t[ord(c)] = 1
    for c in FULL_STOPS:
        t[ord(c)] |= 2
    return t


def _wrapped(folded, capital, wid, stop, cut) -> np.ndarray:
    """Words before which a line break is no sentence's end.

    It is none where no end mark follows the word before, nothing but comment and quotation marks stand
    between, and the next word goes on in small letters (or the word before was in capitals too).
    """
    k = np.flatnonzero(cut[1:])  # a cut between word k and k + 1
    if not len(k):
        return np.zeros(len(wid), bool)
    odd = np.cumsum(np.r_[0, (wrap_table()[folded] & 1) == 0])
    a, b = stop[k], wid[k + 1]
    ok = (odd[b] == odd[a]) & ((wrap_table()[folded[a]] & 2) == 0) & (~capital[b] | capital[a - 1])
    out = np.zeros(len(wid), bool)
    out[k[ok] + 1] = True
    return out


def read(text: pa.Array, places: bool = False):
    """Words of all rows: (hash of word, hash of stem, sentence no., row of each sentence, place of each word, rows,
    letters, sentence of each letter)."""
    b, off = pretokens.buffer_of(text)
    lead = (b & 0xC0) != 0x80
    cp = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = np.add.reduceat(np.append(lead, False).astype(np.int64), off[:-1]) if len(off) > 1 else np.zeros(0, np.int64)
    counts[np.diff(off) == 0] = 0
    if int(counts.sum()) != len(cp):  # bytes that are no UTF-8
        counts = np.array([len(b[i:j].tobytes().decode("utf-8", "replace")) for i, j in zip(off, off[1:])], np.int64)
    # rows are set apart by a zero
    n = len(counts)
    ends = np.cumsum(counts) + np.arange(n)
    out = np.zeros(len(cp) + n, np.uint32)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = cp
    edge = ~body
    place = np.arange(len(out), dtype=np.int64) if places else None
    keep = _unescape(out)
    folded = fold_table()[np.minimum(out, 0x10FFFF)]
    capital = (out >= ord("A")) & (out <= ord("Z"))
    folded[edge] = 0
    gone = (folded == 0) & ~edge
    if keep is not None:
        gone |= ~keep & ~edge
    if gone.any():
        folded, edge, capital = folded[~gone], edge[~gone], capital[~gone]
        place = place[~gone] if places else None
    kind = kind_table()[folded]
    # spaced-out letters: letter, separator, letter, separator, letter ...
    let = (kind == _LETTER) | (kind == _AS_VOWEL) | (kind == _DOLLAR)
    pad = np.concatenate([[False], kind == _LETTER, [False]])
    lone = let & ~pad[:-2] & ~pad[2:]
    lone &= kind == _LETTER
    cand = np.flatnonzero(np.isin(folded[1:-1], [ord(c) for c in SEPARATORS]) & lone[:-2] & lone[2:]) + 1 if len(folded) > 2 else np.zeros(0, np.int64)
    if len(cand):
        run = np.zeros(len(cand), bool)
        two = np.diff(cand) == 2
        run[1:] |= two
        run[:-1] |= two
        mark = folded[cand] != 0x20  # a blank between letters set apart by other marks is a word's end
        run[1:] &= mark[1:] | ~(two & mark[:-1])
        run[:-1] &= mark[:-1] | ~(two & mark[1:])
        cand = cand[run]
        if len(cand):
            k = np.ones(len(folded), bool)
            k[cand] = False
            folded, edge, kind, capital = folded[k], edge[k], kind[k], capital[k]
            place = place[k] if places else None
    # signs that stand for letters, beside a letter (through a run of signs)
    sign = (kind == _AS_VOWEL) | (kind == _DOLLAR)
    at = np.flatnonzero(sign)
    if len(at):
        first = np.r_[True, np.diff(at) > 1]
        run = np.cumsum(first) - 1
        s, e = at[first], at[np.r_[first[1:], True]]
        L = np.concatenate([[False], kind == _LETTER, [False]])
        ok = (L[s] | L[e + 2])[run]
        hit = at[ok]
        v = hit[kind[hit] == _AS_VOWEL]
        folded[v] = MARK
        kind[v] = _LETTER
        d = hit[kind[hit] == _DOLLAR]
        folded[d] = ord("s")
        kind[d] = _LETTER
    vowel = np.zeros(128, bool)
    vowel[[ord(c) for c in VOWELS]] = True
    isv = (folded < 128) & vowel[np.minimum(folded, 127)]
    folded[isv] = MARK
    same = np.zeros(len(folded), bool)
    same[1:] = (folded[1:] == folded[:-1]) & (kind[1:] == _LETTER) & (kind[:-1] == _LETTER)
    # runs: vowels to one, other letters only from three on
    drop = same & (folded == MARK)
    three = np.zeros(len(folded), bool)
    three[2:] = same[2:] & same[1:-1]
    again = np.flatnonzero(three)
    drop[again] = True
    drop[again - 1] = True
    if drop.any():
        folded, edge, kind, capital = folded[~drop], edge[~drop], kind[~drop], capital[~drop]
        place = place[~drop] if places else None
    # words: runs of letters; wide letters one by one
    latin = kind == _LETTER
    prev = np.concatenate([[False], latin[:-1]])
    begin = (latin & ~prev) | (kind == _WIDE)
    wid = np.flatnonzero(begin)
    if not len(wid):
        z, none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return z, z, none, none, none, n, z, none
    nxt = np.concatenate([~latin[1:], [True]])
    stop = np.where(kind[wid] == _WIDE, wid + 1, 0)
    lat = np.flatnonzero(latin & nxt) + 1
    stop[kind[wid] == _LETTER] = lat
    size = stop - wid
    inside = np.repeat(wid, size)
    total = np.cumsum(size)
    pos = np.arange(int(total[-1])) - np.repeat(total - size, size)
    power = np.cumprod(np.full(65, 0x100000001B3, np.uint64))
    vals = folded[inside + pos].astype(np.uint64) * power[np.minimum(pos, 64)]
    h = np.add.reduceat(vals, total - size)
    stem = np.add.reduceat(np.where(pos < 4, vals, 0).astype(np.uint64), total - size) + np.uint64(77)
    stem[size <= 4] = 0
    # sentences: cut at ends, at row edges, and every LONGEST words
    cuts = np.cumsum(kind == _END)
    sid = cuts[wid]
    row = np.cumsum(edge)[wid]
    cut = np.r_[True, sid[1:] != sid[:-1]]
    cut &= ~_wrapped(folded, capital, wid, stop, cut) | np.r_[True, row[1:] != row[:-1]]
    first = np.flatnonzero(cut)
    nth = np.arange(len(sid)) - np.repeat(first, np.diff(np.r_[first, len(sid)]))
    new = cut | (nth % LONGEST == 0)
    sent = np.cumsum(new) - 1
    return h, stem, sent, row[new], (place[wid] if places else np.zeros(0, np.int64)), n, folded[inside + pos].astype(np.uint64), np.repeat(sent, size)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def features(h: np.ndarray, stem: np.ndarray, sent: np.ndarray, letters: np.ndarray, of: np.ndarray):
    """(feature, sentence) of all words, stems, pairs and letter runs; feature families one after the other.

    Letter runs go over the blanks between words: spaced, joined and inflected forms share most of theirs.
    """
    mul = np.uint64(0xC2B2AE3D27D4EB4F)
    yield _hash(h, 1), sent
    s = stem != 0
    yield _hash(stem[s], 2), sent[s]
    for gap, salt in ((1, 3), (2, 4)):
        if len(h) > gap:
            ok = sent[gap:] == sent[:-gap]
            yield _hash(h[:-gap][ok] * mul + h[gap:][ok], salt), sent[gap:][ok]
    m = len(letters) - RUN + 1
    if m > 0:
        ok = of[:m] == of[RUN - 1 :]
        x = np.zeros(m, np.uint64)
        for k in range(RUN):
            x = x * np.uint64(0x100000001B3) + letters[k : k + m]
        yield _hash(x[ok], 5), of[:m][ok]


def sentence_logits(w: np.ndarray, bias: float, h, stem, sent, letters, of, n_sent: int) -> np.ndarray:
    z = np.full(n_sent, bias, np.float64)
    for f, s in features(h, stem, sent, letters, of):
        if len(s):
            z += np.bincount(s, w[f], n_sent)
    return z


def once(sig: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mask of the first of equal sentences in each row."""
    o = np.lexsort((sig, row))
    keep = np.zeros(len(row), bool)
    keep[o] = np.r_[True, (sig[o][1:] != sig[o][:-1]) | (row[o][1:] != row[o][:-1])] if len(row) else keep
    return keep


def signature(h: np.ndarray, sent: np.ndarray, n_sent: int) -> np.ndarray:
    """A number for the words of each sentence, in their order."""
    first = np.searchsorted(sent, np.arange(n_sent))
    nth = np.arange(len(h)) - first[sent]
    x = (h ^ (h >> np.uint64(31))) * (np.uint64(2) * nth.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(x, first) if n_sent else np.zeros(0, np.uint64)


def _noisy_or(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) by row: log(1 - p) = -log(1 + e^z)."""
    return -np.expm1(-np.bincount(row, np.logaddexp(0, z), n))


def bag(text: pa.Array):
    """The different sentences of each row: what ``read`` gives, later copies of a sentence within a row left out."""
    h, stem, sent, row, _, n, letters, of = read(text)
    k = once(signature(h, sent, len(row)), row)
    renum = np.cumsum(k) - 1
    w, c = k[sent], k[of]
    return h[w], stem[w], renum[sent[w]], row[k], n, letters[c], renum[of[c]]


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-4):
    """Weights and bias by full-batch Adam on the noise-aware noisy-or likelihood."""
    size = 1 << FEATURE_BITS
    w, bias = np.zeros(size), -5.0
    parts, rows, base, row0 = [], [], 0, 0
    n_docs, docs, foul = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
    for i, j in pretokens.slices(texts, SLICE):
        h, stem, sent, row, n, letters, of = bag(texts.slice(i, j - i))
        f, s = (np.concatenate(x) for x in zip((np.zeros(0, np.int32), np.zeros(0, np.int64)), *features(h, stem, sent, letters, of)))
        pair = np.unique(f.astype(np.int64) * n + row[s])  # a feature of a document
        fn, dn = pair // n, pair % n + row0
        n_docs += np.bincount(fn, minlength=size)
        docs += np.bincount(fn, weight[dn], size)
        foul += np.bincount(fn, (weight * y)[dn], size)
        parts.append((f, (s + base).astype(np.int32)))
        rows.append(row + row0)
        base += len(row)
        row0 += n
    if not base:
        return w.astype(np.float32), -50.0
    # features that say something: the labels of their documents differ from the average
    base_rate = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    sure = (foul - docs * base_rate) / np.sqrt(np.maximum(docs, 1e-9) * base_rate * (1 - base_rate))
    says = (n_docs >= LEAST_DOCS) & ((sure >= SURE_FOUL) | (sure <= SURE_CLEAN))
    f, s = (np.concatenate(x) for x in zip(*((f[says[f]], s[says[f]]) for f, s in parts)))
    row = np.concatenate(rows)
    del parts
    if not len(f):
        return w.astype(np.float32), -50.0
    o = np.argsort(f, kind="stable")
    f, s = f[o], s[o]
    uniq, start = np.unique(f, return_index=True)
    local = np.repeat(np.arange(len(uniq), dtype=np.int32), np.diff(np.r_[start, len(f)]))
    back = np.argsort(s, kind="stable")  # by sentence, for the forward sums
    fwd = local[back]
    some, s_start = np.unique(s[back], return_index=True)
    v, n = np.zeros(len(uniq)), len(texts)
    m1, m2, mb1, mb2 = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    q0, q1 = WRONG_POSITIVE, 1 - WRONG_NEGATIVE
    for t in range(1, rounds + 1):
        z = np.full(len(row), bias)
        z[some] += np.add.reduceat(v[fwd], s_start)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        doc = _noisy_or(z, row, n)
        q = q0 + (q1 - q0) * doc
        d_doc = -weight * (y / q - (1 - y) / (1 - q)) * (q1 - q0)
        g_s = (d_doc * (1 - doc))[row] * p
        g = np.add.reduceat(g_s[s], start) / weight.sum() + decay * v
        gb = g_s.sum() / weight.sum()
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        step = rate / (1 + t / 60)
        v -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
        bias -= step * (mb1 / (1 - 0.9**t)) / (np.sqrt(mb2 / (1 - 0.99**t)) + 1e-7)
    w[uniq] = v
    return w.astype(np.float32), float(bias)


def _fit(key, t):
    t = t.sort_by("doc_id")
    w, bias = train(t["text"].combine_chunks(), t["y"].to_numpy(), t["weight"].to_numpy())
    return pa.table({"bias": pa.array([bias], pa.float64()), "w": pa.array([w.tobytes()], pa.binary())})


def _text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _fit_on(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, float]:
    """The model of a bounded set of documents with their labels and weights."""
    got = _text(docs, "doc_id").join(F.broadcast(chosen), "doc_id").groupBy(F.lit(0).alias("one")).applyInArrow(_fit, "bias double, w binary").collect()
    return (np.frombuffer(bytes(got[0].w), np.float32), got[0].bias) if got else (np.zeros(1 << FEATURE_BITS, np.float32), -50.0)


def fit(docs: DataFrame, labels: DataFrame, fit_foul: int = FIT_FOUL, fit_clean: int = FIT_CLEAN, guess_foul: int = GUESS_FOUL, guess_clean: int = GUESS_CLEAN) -> tuple[np.ndarray, float]:
    """The model: weights by feature, and the bias."""
    from lodevec.session import stage, unstage

    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    y = stage(y.withColumn("h", F.xxhash64("doc_id")), "labels")
    n = {bool(r.foul): r.n for r in y.groupBy((F.col("y") >= 0.5).alias("foul")).agg(F.count("*").alias("n")).collect()}
    chosen = []
    for foul, most in ((True, fit_foul), (False, fit_clean)):
        of = y.where((F.col("y") >= 0.5) == F.lit(foul)).orderBy("h").limit(most)
        chosen.append(of.select("doc_id", "y", F.lit(max(1.0, n.get(foul, 0) / most)).alias("weight")))
    model = _fit_on(docs, chosen[0].unionByName(chosen[1]))
    if guess_foul + guess_clean == 0 or not model[0].any():
        unstage(y)
        return model
    # the other documents, as this model judges them: the sure ones of either kind teach it more
    first = docs.sparkSession.sparkContext.broadcast(model)
    g = _text(docs, "doc_id").where("doc_id is not null").mapInArrow(_score(first, ["doc_id"]), "doc_id long, score double")
    g = g.where((F.col("score") >= SURE_GUESS[0]) | (F.col("score") < SURE_GUESS[1])).join(y.select("doc_id"), "doc_id", "left_anti")
    g = stage(g.select("doc_id", (F.col("score") >= SURE_GUESS[0]).cast("double").alias("y"), F.lit(1.0).alias("weight"), F.xxhash64("doc_id").alias("h")), "guesses")
    for foul, most in ((1.0, guess_foul), (0.0, guess_clean)):
        chosen.append(g.where(F.col("y") == foul).orderBy("h").limit(most).drop("h"))
    both = chosen[0]
    for c in chosen[1:]:  # at most the four bounds in rows: small enough for any broadcast
        both = both.unionByName(c)
    model = _fit_on(docs, both)
    for done in (y, g):
        unstage(done)
    first.destroy()
    return model


def _score(model, extra: list[str]):
    def run(batches):
        w, bias = model.value
        for b in batches:
            t = pa.Table.from_batches([b])
            for i, j in pretokens.slices(t["text"], SLICE):
                part = t.slice(i, j - i)
                h, stem, sent, row, n, letters, of = bag(part["text"].combine_chunks())
                p = _noisy_or(sentence_logits(w, bias, h, stem, sent, letters, of, len(row)), row, n)
                yield from part.select(extra).append_column("score", pa.array(p)).to_batches()

    return run


def scores(docs: DataFrame, labels: DataFrame, extra: list[str] | None = None, **bounds) -> DataFrame:
    """``extra`` columns (``doc_id`` by default) and the score of each document."""
    extra = extra or ["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    cols = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return _text(docs, *extra).mapInArrow(_score(model, extra), f"{cols}, score double")


def _passages(model, least: float):
    def run(batches):
        w, bias = model.value
        for b in batches:
            t = pa.Table.from_batches([b])
            for i, j in pretokens.slices(t["text"], SLICE):
                part = t.slice(i, j - i)
                ids, texts = part["doc_id"].to_pylist(), part["text"].to_pylist()
                h, stem, sent, row, place, n, letters, of = read(part["text"].combine_chunks(), places=True)
                z = sentence_logits(w, bias, h, stem, sent, letters, of, len(row))
                starts = np.append(0, np.cumsum([len(x) + 1 for x in texts]))
                first = np.searchsorted(sent, np.arange(len(row)))
                last = np.searchsorted(sent, np.arange(len(row)), "right") - 1
                out = []
                for s in np.flatnonzero(z >= np.log(least / (1 - least))):
                    r = int(row[s])
                    lo = int(place[first[s]] - starts[r])
                    hi = int(place[last[s]] - starts[r])
                    while hi < len(texts[r]) and texts[r][hi].isalnum():
                        hi += 1
                    out.append((ids[r], lo, hi, texts[r][lo:hi], float(1 / (1 + np.exp(-z[s])))))
                c = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.float64())], names=["doc_id", "start", "end", "passage", "score"])

    return run


def passages(docs: DataFrame, labels: DataFrame, least: float = FOUL, **bounds) -> DataFrame:
    """``(doc_id, start, end, passage, score)``: the offending sentences, by code points of the text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    return _text(docs, "doc_id").mapInArrow(_passages(model, least), "doc_id long, start long, end long, passage string, score double")


def rates(docs: DataFrame, labels: DataFrame, least: float = FOUL) -> DataFrame:
    """``(src, n_docs, n_foul, rate, mean_score)`` for each source code, null included."""
    return rates_of(scores(docs, labels, ["source"]), least)


def rates_of(s: DataFrame, least: float = FOUL) -> DataFrame:
    """:func:`rates` of scored documents ``(source, score)``."""
    raw = s.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("score") >= least).cast("long")).alias("f"), F.sum("score").alias("s"))
    g = raw.groupBy(code("source").alias("src")).agg(F.sum("n").alias("n_docs"), F.sum("f").alias("n_foul"), F.sum("s").alias("s"))
    return g.select("src", "n_docs", "n_foul", (F.col("n_foul") / F.col("n_docs")).alias("rate"), (F.col("s") / F.col("n_docs")).alias("mean_score"))
