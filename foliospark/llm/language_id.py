"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word (its lower-case
letters after a mark of a word's start) is the sum over all its segmentations into pieces of the product of their
probabilities, by the forward algorithm; a text's is the product over its words. The language under which the text is
most probable is predicted; the score is its share among the languages, which are equally likely beforehand.

The model is fitted by expectation maximisation (forward and backward sums) on a bounded sample of labelled rows:
about ``sample`` texts per language, chosen by a hash of their id, and of their words the ``words`` most frequent of
each language, which are counted in Spark; runs of letters longer than ``PART`` are learned in parts. More than
``languages`` languages are an error. These bounds are arguments of ``fit``. All rows are scored, on their whole texts.

``surprise`` says how a text looks beside its language: its cost per letter (negative log-probability) over that of the
language's own sample. Texts of the language are near 1, noise of letters is far above.

Scoring is per text and shuffles nothing; words met before come from a table of bounded size. Defined cases: a null
text or one without a letter is ``und`` with score 0, and so is every text if there is nothing to learn from; a null id
counts as held out; rows with a null language are not learned from; equal probabilities go to the first language by
name; repeated rows and further columns stay; columns with the names of the result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.pieces import SPACE, load
from foliospark.llm.sentencepiece_fst import FACTOR, Index
from foliospark.llm.token_counts import runs
from foliospark.llm.words import whole_text

UNDEFINED = "und"
SAMPLE = 400
SAMPLE_WORDS = 15_000
MOST_LANGUAGES = 200
PART = 40
ROUNDS = 3
SMOOTH = 0.05
#: numbers (words times languages) and words kept between texts
KNOWN_CELLS, KNOWN = 2_000_000, 200_000
LONGEST_KNOWN = 40
#: characters of texts scored together, and words whose lattices are held at once
RUN, LATTICE = 600_000, 20_000
#: probability of a character that is no piece
FOREIGN = 1e-7
NUMERIC = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")


def text_words(text: str) -> list[str]:
    """Runs of letters in lower case. The standard pattern also takes signs like fractions, which part a run."""
    found = NUMERIC.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else LETTERS.findall(run))]


class Lattice:
    """Pieces of many words as arrays. Words of one length form a block: for every end and length of a piece its row."""

    def __init__(self, rows: dict[str, int], words: list[str], index: Index | None = None):
        self.words = words
        self.longest = max(map(len, rows), default=1)
        self.blocks = []
        index = index or (Index(rows) if rows else None)
        none = len(rows)  # the row of no piece; the next one is that of a foreign character
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(i)
        for n, members in by_length.items():
            deep = min(n, self.longest)
            text = "".join(SPACE + words[i] for i in members).encode("utf-32-le", "surrogatepass")
            chars = np.frombuffer(text, np.uint32).reshape(len(members), n).astype(np.uint64)
            at = np.full((len(members), n + 1, deep + 1), none, np.int32)
            hashed = np.zeros((len(members), n + 1), np.uint64)
            for size in range(1, deep + 1):
                # hashes of all parts of this size grow by one character
                hashed = hashed[:, :-1] * FACTOR + chars[:, size - 1 :] + np.uint64(1)
                found = index.find(hashed) if index else np.full(hashed.shape, -1)
                at[:, size:, size] = np.where(found >= 0, found, none + 1 if size == 1 else none)
            self.blocks.append((np.array(members), at))

    def forward(self, prob: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """Log-probabilities (words x languages) and per block, if kept, the scales of the forward sums."""
        out = np.empty((len(self.words), prob.shape[1]))
        kept = []
        for members, at in self.blocks:
            n, deep = at.shape[1] - 1, at.shape[2] - 1
            # forward sums are scaled to 1 at every place, so only their scales are held
            scale = np.ones((n + 1, len(members), prob.shape[1]))
            for end in range(1, n + 1):
                total = np.zeros((len(members), prob.shape[1]))
                carry = np.ones((len(members), prob.shape[1]))
                for size in range(1, min(end, deep) + 1):
                    total += prob[at[:, end, size]] / carry
                    carry = carry * scale[end - size]
                scale[end] = np.maximum(total, 1e-300)
            out[members] = np.log(scale[1:]).sum(0)
            if keep:
                kept.append(scale)
        return out, kept

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x languages) for words that occur ``weight`` (words x languages) times."""
        _, scales = self.forward(prob)
        counts = np.zeros_like(prob)
        for (members, at), scale in zip(self.blocks, scales):
            n, deep = at.shape[1] - 1, at.shape[2] - 1
            w = weight[members]
            beta = np.zeros((n + 1, len(members), prob.shape[1]))
            beta[n] = 1.0
            for end in range(n, 0, -1):
                # beta is scaled by the forward scales, so an arc's share is alpha * p * beta over the scales it spans
                span = scale[end].copy()
                for size in range(1, min(end, deep) + 1):
                    share = prob[at[:, end, size]] * beta[end] / span
                    beta[end - size] += share
                    np.add.at(counts, at[:, end, size].ravel(), share * w)
                    if end - size >= 1:
                        span = span * scale[end - size]
        return counts


class Model:
    """Piece rows, probabilities and costs per letter by language; as large as the vocabulary times the languages."""

    def __init__(self, rows: dict[str, int], languages: list[str], prob: np.ndarray, usual: np.ndarray | None = None):
        self.rows, self.languages, self.prob = rows, languages, prob
        self.usual = np.ones(len(languages)) if usual is None else usual


def learn(rows: dict[str, int], languages: list[str], words: list[str], weight: np.ndarray) -> Model:
    """Expectation maximisation from even probabilities; ``weight`` is words x languages."""
    lattice = Lattice(rows, words)
    size = np.array([len(p) for p in rows], float)
    prob = np.zeros((len(rows) + 2, len(languages)))
    prob[:-2] = (40.0**-size)[:, None]
    prob[-1] = FOREIGN
    for _ in range(ROUNDS):
        counts = lattice.expected(prob, weight)[:-2] + SMOOTH
        prob[:-2] = counts / counts.sum(0)
    letters = np.array([len(w) for w in words], float)
    logs = lattice.forward(prob, keep=False)[0] if words else np.zeros((0, len(languages)))
    usual = -(logs * weight).sum(0) / np.maximum((weight * letters[:, None]).sum(0), 1.0)
    return Model(rows, languages, prob, np.maximum(usual, 1e-9))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.index = Index(model.rows) if model.rows else None
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def long_word(self, word: str) -> np.ndarray:
        """The forward sums of one word, with a window as long as the longest piece."""
        rows, prob = self.model.rows, self.model.prob
        w, longest = SPACE + word, max(map(len, rows))
        recent = [np.ones(prob.shape[1])]
        log = np.zeros(prob.shape[1])
        for end in range(1, len(w) + 1):
            total = np.zeros(prob.shape[1])
            for size in range(1, min(end, longest) + 1):
                p = rows.get(w[end - size : end])
                if p is not None or size == 1:
                    total += recent[-size] * prob[len(rows) + 1 if p is None else p]
            total = np.maximum(total, 1e-300)
            log += np.log(total)
            recent = [r / total for r in recent[-longest + 1 :]] + [np.ones(prob.shape[1])]
        return log

    def log_probs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log-probability under each language, and its number of letters."""
        if len(self.known) > KNOWN or self.table.size > KNOWN_CELLS:
            self.known, self.table = {}, self.table[:0].copy()
        split = [text_words(t) for t in texts]
        known = self.known
        new = list({w for ws in split for w in ws if w not in known})
        short = [w for w in new if len(w) <= LONGEST_KNOWN]
        long = [w for w in new if len(w) > LONGEST_KNOWN]
        parts = [self.table]
        for at in range(0, len(short), LATTICE):
            parts.append(Lattice(self.model.rows, short[at : at + LATTICE], self.index).forward(self.model.prob, keep=False)[0])
        if long:
            parts.append(np.array([self.long_word(w) for w in long]))
        self.table = np.concatenate(parts)
        known.update(zip(short + long, range(len(known), len(known) + len(new))))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.table[list(map(known.__getitem__, ws))].sum(0)
        return out, np.array([sum(map(len, ws)) for ws in split])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and surprise of texts."""
        logs, letters = self.log_probs(texts)
        if not len(self.model.languages):
            return [UNDEFINED] * len(texts), [0.0] * len(texts), [float("inf")] * len(texts)
        best = logs.argmax(1)
        share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        any_word = letters > 0
        names = [self.model.languages[b] if ok else UNDEFINED for b, ok in zip(best, any_word)]
        cost = -logs[np.arange(len(texts)), best] / np.maximum(letters, 1) / self.model.usual[best]
        return names, np.where(any_word, share, 0.0).tolist(), np.where(any_word, cost, np.inf).tolist()


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(
    docs: DataFrame, path: str, sample: int = SAMPLE, text: str = "text", words: int = SAMPLE_WORDS, languages: int = MOST_LANGUAGES
) -> Model:
    """The model from rows (doc_id, text, lang) that are not held out; see the module for the sample's bounds."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col(text).isNotNull())
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages; give fit a larger bound")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], sample / r["n"])]) if sizes else None
    chosen = labelled.where(draw < share[F.col("lang")]) if sizes else labelled.where("false")
    letters = F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{1,{PART}}})"))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counted = (
        chosen.select("lang", F.explode(letters).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_k", F.row_number().over(often))  # words of a bounded sample
        .where(F.col("_k") <= words)
        .drop("_k")
        .toPandas()
    )
    rows = {p: i for i, p in enumerate(load(path).normal)}
    names = sorted(counted["lang"].unique())
    known = sorted(counted["word"].unique())
    weight = np.zeros((len(known), len(names)))
    at_word, at_lang = {w: i for i, w in enumerate(known)}, {x: i for i, x in enumerate(names)}
    weight[[at_word[w] for w in counted["word"]], [at_lang[x] for x in counted["lang"]]] = counted["n"]
    return learn(rows, names, known, weight)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and surprise."""
    made = ("lang_pred", "score", "surprise")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    # plain arrays, vocabulary times languages; executors need nothing installed
    shared = docs.sparkSession.sparkContext.broadcast((model.rows, model.languages, model.prob, model.usual))

    @F.pandas_udf("lang_pred string, score double, surprise double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            names, scores, surprises = [], [], []
            for run in runs(batch.tolist(), RUN):
                for whole, part in zip((names, scores, surprises), scorer.predict(run)):
                    whole += part
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float), "surprise": pd.Series(surprises, dtype=float)})

    return docs.withColumn("_p", predict(whole_text(text))).select(*docs.columns, *[f"_p.{c}" for c in made])
