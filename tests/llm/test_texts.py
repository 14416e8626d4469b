"""Token counts, piece encoding and language identification."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliospark.llm import language_id, pieces, sentencepiece_fst, token_counts

LETTERS = "abcdefghijklmnopqrstuvwxyzABCXYZ  \n\t'.,!?0123456789éàßÉİΣςſﬁ日本語한국🎉́​\xa0　<|>\x1c\x85"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = "doc_id long, text string, lang string, ids string, n_tokens string, score string"


def texts(n=1500):
    rng = random.Random(3)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)]
    return made + ["", "   ", "\n", "a<|endoftext|>b<|startoftext|>", "<|endoftext|>", "x" * 3000, "aaaa " * 50, "a  b   c    d", " " * 40 + "x", "it's we'll 'S"]


@pytest.fixture
def odd_docs(table):
    rows = [(1, None, "en", None, "x", "x"), (2, "", None, "x", None, None), (3, "one two", "en", "x", "x", "x"), (3, "one two", "en", "x", "x", "x")]
    return table([*rows, (None, "123 !", None, None, None, None), (5, "word " * 60_000, "de", None, None, None)], ODD)


def test_token_counts_equal_the_library():
    own = texts()
    counter = token_counts.Counter(token_counts.MergeTable(WORDS))
    expected = [len(e.ids) for e in Tokenizer.from_file(WORDS).encode_batch(own, add_special_tokens=False)]
    assert [n for run in token_counts.runs(own, 500) for n in counter.count(run)] == expected


def test_token_columns(odd_docs):
    path = WORDS
    got = token_counts.count_tokens(odd_docs, path, limit=2).collect()
    assert [(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got if r["doc_id"] != 5] == [(1, 0, False), (2, 0, False), (3, 2, False), (3, 2, False), (None, 4, True)]
    assert [r["n_tokens"] for r in got if r["doc_id"] == 5] == [60_000]
    assert token_counts.count_tokens(odd_docs.limit(0), path).count() == 0


def test_bpe_paths_equal_the_library():
    own = texts()
    model = pieces.load(MODEL)
    machine, back = sentencepiece_fst.Transducer(model), sentencepiece_fst.Inverse(model)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text, ids, found in zip(own, library.encode(own, num_threads=1), machine.encode(own)):
        assert found.tolist() == ids, text
        assert back.decode(found) == text
    for unit in own[:300]:  # the search of one unit and that of many
        assert [i for p in machine.path(unit) for i in machine.labels(p)] == np.frombuffer(machine.paths([unit])[0], np.int32).tolist()


def test_unigram_paths_are_shortest():
    """With log-probabilities every path is allowed; compare with all segmentations."""
    rng = random.Random(1)
    parts = ["<unk>"] + list("abc▁") + ["ab", "bc", "abc", "▁a", "▁ab", "ca", "aa"]
    model = pieces.PieceModel(parts, [0.0] + [-rng.uniform(1, 9) for _ in parts[1:]], [pieces.UNKNOWN] + [pieces.NORMAL] * (len(parts) - 1), False)
    machine = sentencepiece_fst.Transducer(model)
    score = dict(zip(parts, model.scores))
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
        whole = "▁" + text
        best = math.inf
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(whole)]
            split = [whole[a:b] for a, b in zip(at, at[1:])]
            if all(p in score for p in split):
                best = min(best, -sum(score[p] for p in split))
        assert -sum(model.scores[i] for i in machine.encode([text])[0].tolist()) == pytest.approx(best)


def test_piece_columns(spark, odd_docs):
    got = sentencepiece_fst.pieces(odd_docs, MODEL).collect()
    for r in got:
        assert r["decoded"] == (r["text"] or "")
    assert [len(r["ids"]) for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert sentencepiece_fst.pieces(odd_docs.limit(0), MODEL).count() == 0


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    rows = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"])}
    prob = np.r_[rng.uniform(0.01, 0.3, (len(rows), 3)), np.zeros((1, 3)), np.full((1, 3), language_id.FOREIGN)]
    words = ["a", "ab", "abab", "bbab", "xab", "a" * 50]
    got = language_id.Lattice(rows, words).forward(prob)[0]
    scorer = language_id.Scorer(language_id.Model(rows, ["x", "y", "z"], prob))
    for word, row in zip(words, got):
        w = "▁" + word
        sums = [np.ones(3)]
        for end in range(1, len(w) + 1):
            total = np.zeros(3)
            for start in range(end):
                p = rows.get(w[start:end])
                if p is not None or end - start == 1:
                    total += sums[start] * prob[len(rows) + 1 if p is None else p]
            sums.append(total)
        assert row == pytest.approx(np.log(sums[-1])) and scorer.long_word(word) == pytest.approx(row)


def test_expected_counts_are_derivatives():
    """Expected counts of a piece equal its probability times the derivative of the log-probability."""
    rng = np.random.default_rng(4)
    rows = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba"])}
    prob = np.r_[rng.uniform(0.05, 0.3, (len(rows), 2)), np.zeros((1, 2)), np.full((1, 2), language_id.FOREIGN)]
    words, weight = ["abab", "ba", "aabba"], rng.uniform(1, 3, (3, 2))
    lattice = language_id.Lattice(rows, words)
    counts = lattice.expected(prob, weight)
    total = lambda p: (lattice.forward(p)[0] * weight).sum(0)
    for i in range(len(rows)):
        moved = prob.copy()
        moved[i] *= 1 + 1e-6
        assert counts[i] == pytest.approx((total(moved) - total(prob)) / 1e-6, rel=1e-3, abs=1e-4)


def test_signs_that_are_no_letters():
    assert language_id.text_words("½ ² ① 12 _") == [] and language_id.text_words("A½b x²") == ["a", "b", "x"]
    model = language_id.Model({"▁": 0, "a": 1}, ["x", "y"], np.full((4, 2), 0.1))
    assert language_id.Scorer(model).predict(["½", "12 ² ①", "a"])[0] == ["und", "und", "x"]


def test_language_bounds(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i % 30}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, MODEL, words=3).languages) == 30
    with pytest.raises(ValueError, match="29 languages"):
        language_id.fit(docs, MODEL, languages=29)


def test_languages_held_out(spark, odd_docs):
    rng = random.Random(9)
    syllables = {"xx": ["ba", "do", "ki", "lu"], "yy": ["ent", "str", "ing", "ou"], "zz": ["ñá", "éo", "ía", "ba"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 40))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, MODEL)
    assert model.languages == ["xx", "yy", "zz"]
    got = language_id.identify(docs, model).withColumn("out", language_id.held_out()).where("out").collect()
    assert len(got) > 60 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd_docs, model).collect()}
    assert odd[1] == odd[2] == odd[None] == ("und", 0.0) and odd[3][0] in model.languages and 0 < odd[5][1] <= 1
    empty = language_id.fit(docs.limit(0), MODEL)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
