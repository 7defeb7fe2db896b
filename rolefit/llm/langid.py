"""Language of texts: word-first backoff.

A text's words are its runs of letters, lower-cased. A known word adds its smoothed log frequency in each language. A
word that is not known is scored by its character n-grams with a mark at both ends: the longest length of which any
n-gram is known decides, and shorter ones are tried only if there is none; the mean over its known n-grams counts as the
word's score. The language with the largest sum (and log share of the rows) wins; ties go to the first by name.

The tables are fitted on a bounded sample (`at_most` rows for each language, by a hash of the text) and hold the commonest
`words` words and `grams` n-grams of each length for each language, so their size does not follow the corpus.
`und` with score 0 is returned for null texts, texts without a letter, and when there is no language to learn.
Rows with a null language are not learned from. Repeated rows get the same answer; columns of the same name as a result
are replaced, all others pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_sample, with_new
from .kernel import mix, slices, span_hashes

LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
MARK = 10  # stands for everything that is no letter, and so for both ends of a word


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


_letters: list[np.ndarray] = []


class Letters:
    """Code points of some texts with marks between the words, and the words' spans."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        data = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[data]
        edges = np.diff(np.concatenate(([False], is_letter, [False])).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.codes = np.where(is_letter, data, MARK)
        self.values = mix(self.codes.astype(np.uint64) + np.uint64(1))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lowered])))
        self.first = np.searchsorted(self.starts, bounds)

    def grams(self, length: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of the n-grams of the given words, marks included."""
        low, count = self.starts[words] - 1, self.ends[words] - self.starts[words] + 3 - length
        has = count > 0
        low, count, words = low[has], count[has], words[has]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return span_hashes(self.values, at, at + length), np.repeat(words, count)

    def string(self, start: int, end: int) -> str:
        return self.codes[start:end].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Tables:
    """Languages, log shares, and for words (0) and each n-gram length: sorted hashes and log frequencies."""

    languages: list[str]
    priors: np.ndarray
    parts: dict[int, tuple[np.ndarray, np.ndarray]]

    def look_up(self, part: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, logs = self.parts[part]
        if not len(known):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), int)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes, at

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text in each language, and whether it has a letter."""
        words, n = Letters(texts), len(self.languages)
        count = len(words.starts)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        out = np.tile(self.priors, (len(texts), 1))
        known, at = self.look_up(0, span_hashes(words.values, words.starts, words.ends))

        def add(of: np.ndarray, logs: np.ndarray) -> None:
            for k in range(n):
                out[:, k] += np.bincount(of, logs[:, k], len(texts))

        add(owner[known], self.parts[0][1][at[known]])
        left = np.flatnonzero(~known)
        for length in LENGTHS:
            if not len(left):
                break
            hashes, word = words.grams(length, left)
            hit, at = self.look_up(length, hashes)
            word, at = word[hit], at[hit]
            number = np.bincount(word, minlength=count)
            if len(word):
                add(owner[word], self.parts[length][1][at] / number[word][:, None])
            left = left[number[left] == 0]
        return out, np.diff(words.first) > 0


def fit(labelled: DataFrame, text: str, lang: str, at_most: int = 1500, words: int = 20_000, grams: int = 20_000, smooth: float = 0.5) -> Tables:
    """Tables from the rows of `labelled` whose language and text are not null."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(shares)
    if not languages:
        none = (np.zeros(0, np.uint64), np.zeros((0, 0)))
        return Tables([], np.zeros(0), {k: none for k in (0, *LENGTHS)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "part": [], "hash": [], "n": []}
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                mine = [t for t, x in zip(batch.column(0).to_pylist(), langs) if x == lang]
                for _, part in slices(pa.array(mine, pa.string())):
                    found = Letters(part.to_pylist())
                    every = np.arange(len(found.starts))
                    for k in (0, *LENGTHS):
                        hashes = found.grams(k, every)[0] if k else span_hashes(found.values, found.starts, found.ends)
                        value, n = np.unique(hashes, return_counts=True)
                        out["lang"] += [lang] * len(value)
                        out["part"] += [k] * len(value)
                        out["hash"] += value.view(np.int64).tolist()
                        out["n"] += n.tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())]))

    sample = fit_sample(rows, "text", at_most, "lang").select("text", "lang")
    counts = sample.mapInArrow(counted, "lang string, part int, hash bigint, n bigint").groupBy("lang", "part", "hash").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", "part").orderBy(F.col("n").desc(), "hash")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.when(F.col("part") == 0, words).otherwise(grams))
    found = best.select("lang", "part", "hash", "n").toArrow()  # bounded by languages x (words + 5 x grams)
    of = np.searchsorted(np.array(languages), np.array(found["lang"].to_pylist(), dtype=object).astype(str)) if len(found) else np.zeros(0, int)
    kind, value, n = (found[c].to_numpy() for c in ("part", "hash", "n"))
    parts = {}
    for k in (0, *LENGTHS):
        mine = kind == k
        known, at = np.unique(value[mine].view(np.uint64), return_inverse=True)
        table = np.full((len(known), len(languages)), smooth)
        np.add.at(table, (at, of[mine]), n[mine])
        parts[k] = (known, np.log(table / np.maximum(table.sum(0), smooth)))
    total = sum(shares.values())
    return Tables(languages, np.log(np.array([shares[x] / total for x in languages])), parts)


def detect(df: DataFrame, tables: Tables, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`df` with the language `lang` and the probability `score` that the tables give it."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    @F.arrow_udf("struct<lang:string,score:double>")
    def detected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for first, part in slices(texts, 1 << 20) if model.languages else ():
                sums, has = model.sums(part.to_pylist())
                best = sums.argmax(1)
                sure = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(has):
                    names[first + i], scores[first + i] = model.languages[best[i]], sure[i]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    both = detected(F.col(text))
    return with_new(df, {lang: both["lang"], score: both["score"]})
