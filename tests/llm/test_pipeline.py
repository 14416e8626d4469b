"""The pipeline against a plain version of its stages, and the registered queries."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from foliospark.llm import ORACLES, QUERIES, language_id, quality


def corpus():
    rng = random.Random(11)
    syllables = {"xx": ["ba", "do", "ki", "lu", "tam"], "yy": ["ent", "str", "ing", "ou", "es"]}
    rows = []
    for i in range(300):
        lang = rng.choice(["xx", "yy"])
        words = ["".join(rng.choices(syllables[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(30, 200))]
        rows.append([i, " ".join(words), lang, rng.choice(["a", "b", None])])
    for i in range(300, 340):  # near copies
        rows.append([i, rows[i - 300][1] + " end", rows[i - 300][2], "b"])
    rows += [[400, None, "xx", "a"], [401, "", None, None], [402, "12 34 " * 60, "yy", "a"], [403, "same words again " * 40, "yy", "a"]]
    rows += [[404, " ".join(w + "$$$" for w in rows[0][1].split() * 3), "xx", "a"], rows[7], [None, rows[9][1] + " other", "xx", "a"]]
    rows += [[405, " ".join("".join(rng.choices("qwzjvxpgfc", k=rng.randrange(2, 9))) for _ in range(80)), "xx", "a"]]  # noise of letters
    return [(*r, len(r[1] or ""), "extra") for r in rows]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    now = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = corpus_pipeline.stored(stage(spark, now, ""), "test")
        assert now.columns == docs.columns, name
        counts.append(Counter((r["doc_id"], r["text"]) for r in now.collect()))
    whole = Counter((r[0], r[1]) for r in rows)
    no_letters = {400, 401, 402, 405}
    assert counts[0] == Counter({k: n for k, n in whole.items() if k[0] not in no_letters})
    gone = counts[0] - counts[1]
    for (i, text), _ in gone.items():
        n = len(text.split())
        assert n < 50 or i in (403, 404), i
    assert not counts[1] - counts[0] and (403, next(r[1] for r in rows if r[0] == 403)) not in counts[1]
    assert not any(i == 404 for i, _ in counts[1])
    for (i, text), n in counts[1].items():
        if i is not None and 300 <= i < 340:
            first = (i - 300, rows[i - 300][1])
            assert (counts[2][i, text] == 0) == (first in counts[1]), i
        elif i is None:
            assert counts[2][i, text] == 0 or (9, rows[9][1]) not in counts[1]
        else:
            assert counts[2][i, text] == 1  # the repeated row is a copy of itself
    mixed = corpus_pipeline.stored(corpus_pipeline.mixing_stage(spark, now, ""), "test")
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert mixed.columns == docs.columns and set(got) <= set(counts[2]) and all(n <= 2 * counts[2][k] for k, n in got.items())
    words = sum(len(k[1].split()) * n for k, n in got.items())
    before = sum(len(k[1].split()) * n for k, n in counts[2].items())
    assert abs(words - 1.5 * before) < 800
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by_id = {k[0]: k[1] for k in got}
    final = corpus_pipeline.pieces_stage(spark, mixed, "").collect()
    assert len(final) == sum(got.values())
    for r in final[:200]:
        assert r["ids"] == library.encode(by_id[r["doc_id"]]) and r["same_text"] and r["n_pieces"] == len(r["ids"])


def test_empty_table(spark):
    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_near_copies_are_judged_by_row(spark):
    words = [f"w{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(words[::-1])
    rows = [(1, text), (1, other), (None, text), (None, text + " end"), (2, text), (2, "own " + other[::-1]), (None, "short one"), (3, None)]
    got = corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text), (1, other), (2, "own " + other[::-1]), (None, "short one"), (3, None)], key=str)


def test_noise_goes_and_short_texts_stay(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 300]
    short = [(1000 + i, r[1].split()[0], r[2], "a", 1, "x") for i, r in enumerate(rows[:40])]
    rng = random.Random(3)
    noise = [(2000 + i, " ".join("".join(rng.choices("qwzjvxpgfc", k=6)) for _ in range(20)), "xx", "a", 1, "x") for i in range(40)]
    docs = spark.createDataFrame(rows + short + noise, "doc_id long, text string, lang string, source string, n_chars long, score string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert not any(i >= 2000 for i in kept) and sum(i >= 1000 for i in kept) >= 38 and sum(i < 1000 for i in kept) == 300


@pytest.mark.parametrize("name", QUERIES)
def test_registered_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES[name](spark, folder)
    key = rows.columns[0]
    source = {"page_id": "pages", "doc_id": "documents", "vec_id": "embeddings", "conv_id": "conversations"}[key]
    ids = {r[0] for r in spark.read.parquet(f"{folder}/{source}.parquet").select(key).collect()}
    got = rows.collect()
    assert {r[0] for r in got} - {-1} == ids
    assert len(got) == len(ids) * (8 if name.startswith("op12") else 1) + (name.startswith("op6"))


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and quality.D == 5 and language_id.UNDEFINED == "und"
