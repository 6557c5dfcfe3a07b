import hashlib
import random

import numpy as np
import pytest

from evidentia.llm.lattice import MODEL_FILE, SPACE, best, likelihoods, vocabulary
from evidentia.llm import sentencepiece_scan
from evidentia.llm.sentencepiece_scan import LITERAL, Encoder, combine, cut_points, decode, encode, encoded_and_decoded, marked, product, shortcut, states

MODEL = open(MODEL_FILE, "rb").read()


@pytest.fixture(scope="module")
def encoder():
    return Encoder(MODEL)


def brute(encoder, text):
    """Best score of a marked text without escapes, character by character."""
    vocab, piece = encoder.vocab, {encoder.vocab.pieces[i]: i for i in encoder.vocab.plain}
    reach = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - vocab.longest), j):
            if (p := piece.get(text[i:j])) is not None:
                reach[j] = max(reach[j], reach[i] + encoder.scores[p])
        if text[j - 1] not in piece:
            reach[j] = max(reach[j], reach[j - 1] + encoder.scores[vocab.byte_ids[list(text[j - 1].encode())]].sum())
    return reach[-1]


TEXTS = ["", " ", "a", "Hello world", "  two  spaces \n\ttab", "ünïcödé 漢字 🙂 text", SPACE, f"x{SPACE}y {LITERAL}z", "aaaa" * 50, "the cat " * 300, "\x00\x01"]


def test_best_is_the_brute_force_best(encoder):
    rng = random.Random(1)
    texts = [t for t in TEXTS if SPACE not in t and LITERAL not in t] + ["".join(rng.choice("thean ñ漢.") for _ in range(40)) for _ in range(30)]
    for t, ids in zip(texts, encoder.encode_all([marked(t) for t in texts]), strict=True):
        assert encoder.score(ids) == pytest.approx(brute(encoder, marked(t)), abs=1e-9)
        assert encoder.decode(ids) == t


def test_round_trip_of_every_text(encoder):
    for t in TEXTS:
        assert encoder.decode(encoder.encode_all([marked(t)])[0]) == t
    for t, (ids, raw) in zip(TEXTS, encoder.both(TEXTS), strict=True):
        assert ids.tolist() == encoder.encode_all([marked(t)])[0].tolist() and raw == encoder.decoded_bytes(ids) == t.encode()


def test_scan_over_chunks_equals_the_whole(encoder):
    rng = random.Random(2)
    for alphabet in ("thean ñ漢.", "thean", f"ab {SPACE}{LITERAL}"):
        t = marked("".join(rng.choice(alphabet) for _ in range(700)))
        at = cut_points(t, 64)
        chunks = [t[a:b] for a, b in zip(at, at[1:])]
        ahead = [t[b : b + encoder.states - 1].split(LITERAL)[0] for b in at[1:]]
        ms = [shortcut(encoder, c, a)[0] for c, a in zip(chunks, ahead, strict=True)]
        way, score = states(ms)
        whole = encoder.encode_all([t])[0]
        assert score == pytest.approx(encoder.score(whole), abs=1e-6)
        ids = [i for c, a, e, o in zip(chunks, ahead, way, way[1:]) for i in shortcut(encoder, c, a, (e, o))[1]]
        assert encoder.score(ids) == pytest.approx(score, abs=1e-6)
        assert encoder.decode(ids) == encoder.decode(whole)
        assert product(ms)[0, 0] == pytest.approx(score, abs=1e-6)
        left = combine(combine(ms[0], ms[1]), ms[2])
        right = combine(ms[0], combine(ms[1], ms[2]))
        assert np.allclose(left[np.isfinite(left)], right[np.isfinite(right)])


def test_chunked_documents_equal_unchunked(spark, monkeypatch):
    rows = [(i, "word and other things, " * n) for i, n in enumerate((0, 1, 40, 200))] + [(9, None), (9, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r["doc_id"]), r["n_chars"])
    monkeypatch.setattr(sentencepiece_scan, "BLOCK", 3)
    a = sorted(encode(docs, chunk=64).collect(), key=key)
    b = sorted(encode(docs).collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    for x, y in zip(a, b, strict=True):
        assert x["score"] == pytest.approx(y["score"], abs=1e-6)
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs, chunk=64)).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_texts_that_fall_into_words_need_no_chunks(spark, monkeypatch):
    """One way through a text of words, without transfer matrices; a text with a run too long for that goes by chunks, with the same score."""
    held, real = [], sentencepiece_scan.staged
    monkeypatch.setattr(sentencepiece_scan, "staged", lambda df, name: held.append(name) or real(df, name))
    words = [(i, t) for i, t in enumerate(("word and other things, " * 40, "  ünï 漢字 🙂" * 30, f"x{SPACE}y {LITERAL}z " * 50, " a  b\n" * 100))]
    runs = [(10, "ab" * 200 + " c" * 100), (11, "a" + " " * 300 + "b" * 90), (12, "x y" * 2000)]
    for rows, chunks in ((words, False), (runs, True)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r for r in encode(docs, chunk=64).collect()}
        assert ("chunks" in held) is chunks
        for r in encode(docs, chunk=1 << 20).collect():
            mine = got[r["doc_id"]]
            assert mine["score"] == pytest.approx(r["score"], abs=1e-6) and (mine["n_chars"], mine["decoded_sha256"]) == (r["n_chars"], r["decoded_sha256"])
            assert chunks or mine["ids"] == r["ids"]
            assert mine["decoded_sha256"] == hashlib.sha256(dict(rows)[r["doc_id"]].encode()).hexdigest()


def test_words_learnt_together_equal_words_alone(encoder):
    own = Encoder(MODEL)
    words = ["", "the", "thereon", "ñ漢", "🙂🙂", "x" * 100, "\x00", f"{LITERAL}0a"]
    own.learn(set(words), after=True)
    for w in words:
        ids, raw = own._after[w]
        assert np.frombuffer(ids, np.int32).tolist() == encoder.encode_all([SPACE + w])[0].tolist() and raw == encoder._spelt(np.frombuffer(ids, np.int32).tolist())


def test_digest(spark):
    docs = spark.createDataFrame([(1, "Größe", "extra"), (2, "", "x")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in encoded_and_decoded(docs).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256("Größe".encode()).hexdigest()
    assert encoded_and_decoded(docs.limit(0)).count() == 0


def test_likelihood_sums_all_segmentations(encoder):
    vocab, s = encoder.vocab, encoder.scores
    piece = {vocab.pieces[i]: i for i in vocab.plain}
    word = SPACE + "thereon"

    def total(at):
        if at == len(word):
            return 1.0
        return sum(np.exp(s[piece[word[at:j]]]) * total(j) for j in range(at + 1, len(word) + 1) if word[at:j] in piece)

    assert likelihoods(vocab, s, [word])[0] == pytest.approx(np.log(total(0)))
    assert vocabulary(MODEL) is vocabulary(MODEL) and best(vocab, s, []) == []
