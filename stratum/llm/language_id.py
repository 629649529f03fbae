"""Language identification: a linear-chain conditional random field labels the words of code-switched text.

Emission scores sum weights of a word's identity (lexicon), affixes and character n-grams; transitions are learned on
sequences spliced from lines of different languages. Chains are lines. Forward-backward gives each word's marginals; a
document's language has the greatest mean marginal, which is also its score. How surely its words are labelled, whatever
their languages, is told apart from that: the mean over words of each word's greatest marginal, words that share no feature
with what was learned counting 0.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.common import col, map_rows, ship, texts
from stratum.llm.crf import fit, forward_backward

#: Signs that `re` counts as parts of words though they are no letters: fractions, superscripts, Roman numerals and the like.
NUMERALS = {ord(c): " " for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
NUMERAL_SIGNS = frozenset(map(chr, NUMERALS))
WORD = re.compile(r"[^\W\d_]+")
REMEMBER = 400_000
UNDECIDED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sureness", T.DoubleType())])


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    text = text.lower()
    if not text.isascii() and not NUMERAL_SIGNS.isdisjoint(text):
        text = text.translate(NUMERALS)
    return WORD.findall(text)


def word_features(word: str) -> list[str]:
    """Lexicon entry, prefixes and suffixes of one to four letters, and all pairs and triples of letters."""
    marked = f"^{word}$"
    out = ["w=" + word, *(f"p={word[:n]}" for n in range(1, 5)), *(f"s={word[-n:]}" for n in range(1, 5))]
    return out + list({marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)})


def train(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, usable=None, max_docs: int = 2000,
    max_words: int = 100,
) -> dict:
    """The field, fitted on a bounded sample of labelled rows: max_docs rows of max_words words each.

    Of the rows that meet the condition `usable` and have text and language, each language gives an equal share, those of
    the least hashes of their ids, so that the sample does not depend on how the rows are dealt out. With more languages
    than max_docs, those of the most rows are learned. Of a row max_words consecutive words are taken, from a place that its
    hash names. Every word of a row bears the row's language. Only this fit is bounded; identify() reads whole texts.
    """
    ship(df.sparkSession)
    labelled = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull() & (F.lit(True) if usable is None else usable))
    labelled = labelled.select(col(lang_col).alias("lang"), col(text_col).alias("text"), F.xxhash64(col(id_col)).alias("hash"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_docs).collect()
    if not counts:
        return {"langs": [], "index": {}, "weights": np.zeros((0, 0)), "trans": np.zeros((0, 0))}
    share = max(1, max_docs // len(counts))
    known = df.sparkSession.createDataFrame([(r["lang"], max(1, r["n"] // (2 * share))) for r in counts], "lang string, one_in long")
    sample = labelled.join(F.broadcast(known), "lang").where(F.pmod("hash", "one_in") == 0).select("lang", "hash", "text")  # max_docs rows at most

    def stretch(batches):
        for batch in batches:
            words = [words_of(t) for t in texts(batch.column(2))]
            cut = [w[h % max(1, len(w) - max_words + 1) :][:max_words] for w, h in zip(words, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cut, pa.list_(pa.string()))], names=["lang", "hash", "words"])

    rows = sample.mapInArrow(stretch, "lang string, hash long, words array<string>").orderBy("hash", "words").limit(4 * max_docs).collect()
    taken: Counter = Counter()
    rows = [r for r in rows if r.words and (taken.update([r.lang]) or taken[r.lang] <= share)]
    langs = sorted({r.lang for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    pieces = sorted((r.lang, tuple(r.words)) for r in rows)
    counted = Counter(f for _, words in pieces for w in set(words) for f in word_features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, c in counted.items() if c > 1), 1)}
    rng = random.Random(7)
    stretches = []
    for lang, words in pieces:  # stretches of several words, spliced into switching sequences
        at = 0
        while at < len(words):
            n = rng.randint(4, 24)
            stretches.append((number[lang], words[at : at + n]))
            at += n
    rng.shuffle(stretches)
    known: dict[str, list[int]] = {}
    flat, bounds, gold, lengths = [], [0], [], []
    for i in range(0, len(stretches), 3):
        for lang, words in stretches[i : i + 3]:
            for w in words:
                if w not in known:
                    known[w] = [0, *(index[f] for f in word_features(w) if f in index)]
                flat += known[w]
                bounds.append(len(flat))
                gold.append(lang)
        lengths.append(sum(len(w) for _, w in stretches[i : i + 3]))
    if not lengths:
        return {"langs": [], "index": {}, "weights": np.zeros((0, 0)), "trans": np.zeros((0, 0))}
    weights, trans = fit(np.array(flat), np.array(bounds), np.array(gold), np.array(lengths), len(index) + 1, len(langs), epochs=3, batch=64)
    return {"langs": langs, "index": index, "weights": weights.astype(np.float32), "trans": trans.astype(np.float32)}


class Labeller:
    """A model with a bounded memory of words' emission scores; one a task."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model["langs"])), np.float32)
        self.met = np.zeros(0, bool)

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words, and whether any of their features was learned."""
        if len(self.rows) > REMEMBER:
            self.forget()
        fresh = [w for w in set(words) if w not in self.rows]
        if fresh:
            index, weights = self.model["index"], self.model["weights"]
            ids, sizes = [], []
            for w in fresh:
                found = [0, *(index[f] for f in word_features(w) if f in index)]
                ids += found
                sizes.append(len(found))
            made = np.add.reduceat(weights[np.array(ids)], np.cumsum(sizes) - sizes)
            self.rows.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
            self.scores = np.concatenate([self.scores, made])
            self.met = np.append(self.met, np.array(sizes) > 1)
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.scores[at], self.met[at]

    def words(self, given: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts, their marginals, whether any of their features was learned, and the number of words of each text."""
        words, lengths, sizes = [], [], []
        for text in given:
            before = len(words)
            for line in text.split("\n"):
                found = words_of(line)
                if found:
                    words += found
                    lengths.append(len(found))
            sizes.append(len(words) - before)
        if not words or not self.model["langs"]:
            return words, np.zeros((len(words), len(self.model["langs"]))), np.zeros(len(words), bool), np.array(sizes)
        lengths = np.array(lengths)
        emit, met = self.emissions(words)
        marginal, _, _ = forward_backward(emit, np.cumsum(lengths) - lengths, lengths, self.model["trans"])
        return words, marginal, met, np.array(sizes)

    def documents(self, given: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and sureness of each text."""
        _, marginal, met, sizes = self.words(given)
        langs, scores, sure = [UNDECIDED] * len(given), [0.0] * len(given), [0.0] * len(given)
        own = np.flatnonzero(sizes)
        if len(own) and marginal.shape[1]:
            at = (np.cumsum(sizes) - sizes)[own]
            mean = np.add.reduceat(marginal.astype(float), at) / sizes[own, None]
            single = np.add.reduceat(marginal.max(1).astype(float) * met, at) / sizes[own]
            for i, best, p, q in zip(own.tolist(), mean.argmax(1).tolist(), mean.max(1).tolist(), single.tolist()):
                langs[i], scores[i], sure[i] = self.model["langs"][best], min(1.0, max(0.0, p)), min(1.0, max(0.0, q))
        return langs, scores, sure


def identify(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with lang_pred, score and sureness (0 to 1). Null texts and texts without a letter get `und` and 0, as do all if
    nothing was learned. Of languages of equal score the first by name is taken. Rows that repeat get equal results, an
    empty table an empty one. Whole texts are read; one pass, no shuffle. Input columns of these names, in any case, are
    replaced.
    """

    def make():
        labeller = Labeller(model)
        return lambda column: list(labeller.documents(texts(column)))

    return map_rows(df, [text_col], RESULT, make, keep)
