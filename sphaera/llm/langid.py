"""Language identification by words first, with back-off to character n-grams.

A word that the model knows scores by its log frequency in each language. An unknown word scores by the
n-grams of the greatest length of which the model knows any, from six characters down to one, padded with a
space at both ends; each of the known ones counts alike. A text scores the mean over its words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.llm.common import staged, with_arrow_columns

#: The bound of the training sample: about so many labelled documents for each language.
DOCS_PER_LANGUAGE = 2000
#: A word or n-gram that a language has less often in the sample is not learnt. The model is bounded by the sample.
LEAST_COUNT = 3
#: Features that a task counts before it hands them on.
COUNTED_AT_ONCE = 100_000
LONGEST = 6
#: A frequency that a language lacks counts as this share of one occurrence.
MISSING = 0.1
#: Unknown words that a task remembers.
CACHE = 50_000
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (category L), lower case. Digits, number forms such as "½" and marks are none."""
    return _WORD.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def training_sample(docs: DataFrame, id: str, text: str, lang: str, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """About per_language labelled documents of each language, chosen by a hash of id and text."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id).alias("id"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    u = F.pmod(F.xxhash64(F.col("id").cast("string"), "lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(sizes), "lang").where(u < F.lit(float(per_language)) / F.col("n")).select("lang", "text")


def _word_counts(batches):
    """Partial counts of words by language, a bounded number of them at a time."""

    def given():
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "feature", "count"])

    found: Counter = Counter()
    for batch in (b.slice(i, 100) for b in batches for i in range(0, len(b), 100)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w, c in Counter(words_of(text)).items():
                found[lang, w] += c
        if len(found) >= COUNTED_AT_ONCE:
            yield given()
            found.clear()
    yield given()


def _gram_counts(batches):
    """Partial counts of the n-grams of distinct words (lang, feature, count), a bounded number of them at a time."""

    def given():
        columns = ([k[0] for k in found], [k[1] for k in found], [k[2] for k in found], list(found.values()))
        types = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "n", "feature", "count"])

    found: Counter = Counter()
    for batch in batches:
        for lang, word, count in zip(*(c.to_pylist() for c in batch.columns)):
            for n in range(1, LONGEST + 1):
                for g in grams_of(word, n):
                    found[lang, n, g] += count
            if len(found) >= COUNTED_AT_ONCE:
                yield given()
                found.clear()
    yield given()


class Model:
    """Counts of words (n is 0) and n-grams by language, as one Arrow table (lang, n, feature, count), and the
    totals of each language and n. Tasks make log frequencies of them."""

    def __init__(self, rows: pa.Table, totals: dict[tuple[str, int], int]):
        self.rows, self.totals = rows, totals
        self._made = None

    @classmethod
    def of(cls, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> "Model":
        return cls(pa.table(dict(zip(("lang", "n", "feature", "count"), map(list, zip(*rows))))), totals)

    def scorer(self):
        """A function from texts to their languages and scores, made once in each Python worker."""
        if self._made is None:
            self._made = self._scorer()
        return self._made

    def _scorer(self):
        langs = self.rows.column("lang").combine_chunks().dictionary_encode()
        names = sorted(langs.dictionary.to_pylist())
        code = np.array([names.index(x) for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()] if names else np.zeros(0, np.int64)
        length, count = self.rows.column("n").to_numpy(), self.rows.column("count").to_numpy()
        known: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        place = np.zeros(len(count), np.int64)
        size = 0
        for i, (n, f) in enumerate(zip(length.tolist(), self.rows.column("feature"))):
            place[i] = known[n].setdefault(f.as_py(), size)
            size += place[i] == size
        total = np.ones((LONGEST + 1, len(names)))
        for (lang, n), c in self.totals.items():
            if lang in names:
                total[n, names.index(lang)] = c
        # A small language's missing words must not look likelier than a large one's.
        least = MISSING / total.max(axis=1, initial=1)
        table = np.zeros((size, len(names)), np.float32)
        table[place] = least[length][:, None]
        table[place, code] = np.maximum(count / total[length, code], least[length])
        table = np.log(table)
        words, grams = known[0], known
        cache: dict[str, tuple[int, ...]] = {}

        def features(word: str) -> tuple[int, ...]:
            k = words.get(word)
            if k is not None:
                return (k,)
            found = cache.get(word)
            if found is None:
                found = ()
                for n in range(min(LONGEST, len(word) + 2), 0, -1):
                    get = grams[n].get
                    found = [k for k in map(get, grams_of(word, n)) if k is not None]
                    if found:
                        break
                if len(cache) >= CACHE:
                    cache.clear()
                cache[word] = found = tuple(found)
            return found

        def predict(texts):
            langs, scores = [], []
            for text in texts:
                counts = Counter(words_of(text))
                at, weight, seen = [], [], 0
                for w, c in counts.items():
                    f = features(w)
                    if f:
                        seen += c
                        at.extend(f)
                        weight.extend([c / len(f)] * len(f))
                if not counts or not names:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                mean = np.array(weight) @ table[at] / seen if seen else np.zeros(len(names))
                best = int(np.argmax(mean))
                langs.append(names[best])
                scores.append(float(1 / np.exp(mean - mean[best]).sum()))
            return langs, scores

        return predict


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE, least_count: int = LEAST_COUNT) -> Model:
    """Learn from a bounded sample of labelled documents (null labels and texts teach nothing).

    Spark counts words and n-grams; the driver gets those that occur at least ``least_count`` times. Rows that repeat
    teach again as often; very long texts teach whole; other columns are not looked at. An empty table, or one
    without labels, gives a model that tells nothing.
    """
    sample = training_sample(docs, id, text, lang, per_language).select("lang", "text")
    # Words repeat, so their n-grams are taken from each language's distinct words.
    words = sample.mapInArrow(_word_counts, "lang string, feature string, count long").groupBy("lang", "feature").agg(F.sum("count").alias("count"))
    words = staged(words, "words")
    grams = words.mapInArrow(_gram_counts, "lang string, n int, feature string, count long").groupBy("lang", "n", "feature").agg(F.sum("count").alias("count"))
    counts = staged(words.select("lang", F.lit(0).alias("n"), "feature", "count").unionByName(grams), "counts")
    totals = {(r["lang"], r["n"]): r["total"] for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    top = counts.where(F.col("count") >= least_count)
    # As Arrow, the model is a few megabytes on the driver, where rows would be hundreds.
    return Model(top.select("lang", "n", "feature", "count").toArrow(), totals)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). Texts that are null or have no letter are ``und`` with score
    0, and so is everything if the model learned from nothing. Ties go to the first language by name. Repeated rows
    come back as they came, columns named like a result are replaced, and very long texts are judged whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.scorer()

        def work(texts):
            langs, scores = predict(texts)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return with_arrow_columns(docs, [text], [("lang_pred", T.StringType()), ("score", T.DoubleType())], make)


def held_out(id: str = "doc_id", parts: int = 5):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts == 0, F.lit(False))
