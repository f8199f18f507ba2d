"""Language by words first, character n-grams for words not known.

Learning counts, for each language, the words (runs of letters, lower case) of a bounded sample of
rows and the n-grams of those words, padded by "<" and ">". A known word scores the log of its
smoothed frequency in each language. An unknown word takes the longest n-grams of which any is
known: the mean of their log frequencies; then the next shorter ones, down to single letters. A text
has the sum over its words; the score is the posterior share of the best language.

The sample: at most `sample_rows` rows of each language, those with the smallest hash of their key,
one row of each key. The model keeps the `words` most frequent words and `ngrams` n-grams of each
length, all of them where these are None, and leaves out what was seen less than `least_seen` times.

Shares alone accept any long text, as its words all speak for the same language, however little. The
stage `recognised` therefore also asks how well the text is known to its language: the mean, over
the text's words, of 1 for a known word and for others the share of their n-grams of the longest
lengths that the model holds.

Rows: null text or a text without a letter is "und" with score 0. Ties go to the language that is
first in order. With nothing to learn from, every row is "und". Repeated rows are predicted alike,
extra columns are ignored, whole texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import batch, held_out, kept_rows, pieces, saved

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
CACHE_ENTRIES = 50_000


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case. Signs that count as word characters without being letters
    (fractions, superscripts, Roman numerals) part words."""
    found = LETTERS.findall(text.lower())
    if text.isascii():
        return found
    return [x for run in found for x in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class LanguageModel:
    """Log-frequency vectors of words and n-grams; `langs` in order."""

    def __init__(self, langs: list[str], counts: list[dict[str, np.ndarray]], totals: list[np.ndarray]):
        """counts[0] are the words', counts[n] those of n-grams of ORDERS[n - 1]."""
        self.langs = langs
        self.places: list[dict[str, int]] = []  # rows of `logs`
        logs = [np.zeros((1, len(langs)), dtype=np.float32)]
        for found, total in zip(counts, totals):
            keys = list(found)
            start = sum(map(len, logs))
            self.places.append({k: start + i for i, k in enumerate(keys)})
            if keys:
                rows = np.log((np.array([found[k] for k in keys], dtype=float) + 0.5) / (total + 0.5 * (len(keys) + 1)))
                logs.append((rows - rows.mean(axis=1, keepdims=True)).astype(np.float32))
        self.logs = np.concatenate(logs)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.partly: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "partly": {}}

    def backed_off(self, word: str) -> tuple[int, ...]:
        """Of a word that is not known: the rows of its longest n-grams of which any is."""
        for places, order in zip(self.places[1:], ORDERS):
            known = tuple(places[g] for g in grams(word, order) if g in places)
            if known:
                return known
        return (0,)

    def share_of_known_grams(self, word: str) -> float:
        """Of a word's 4- and 5-grams."""
        own = [g in places for order, places in zip(ORDERS[:2], self.places[1:3]) for g in grams(word, order)]
        return sum(own) / len(own) if own else 0.0

    def known_share(self, text: str | None) -> float:
        """How well the text's words are known: 1 a known word, else the share of its long n-grams;
        0 without words."""
        return self._known_share(Counter(words_of(text)) if text else Counter())

    def _known_share(self, counts: Counter) -> float:
        words, partly = self.places[0], self.partly
        if len(partly) > CACHE_ENTRIES:
            partly.clear()
        total = 0.0
        for word, n in counts.items():
            if word in words:
                total += n
                continue
            share = partly.get(word)
            if share is None:
                share = partly[word] = self.share_of_known_grams(word)
            total += n * share
        return total / max(1, counts.total())

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, share, known share) of one text."""
        counts = Counter(words_of(text)) if text else Counter()
        return *self._predict(counts), self._known_share(counts)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self._predict(Counter(words_of(text)) if text else Counter())

    def _predict(self, counts: Counter) -> tuple[str, float]:
        """One weighted sum of rows: a known word weighs its count, the n-grams of an unknown word
        share the word's."""
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        places = list(map(self.places[0].get, counts))
        weights: list[float] = list(counts.values())
        if None in places:
            for i, word in enumerate(counts):
                if places[i] is None:
                    known = cache.get(word)
                    if known is None:
                        known = cache[word] = self.backed_off(word)
                    places[i] = known[0]
                    weights[i] = weight = weights[i] / len(known)
                    if len(known) > 1:
                        places += known[1:]
                        weights += [weight] * (len(known) - 1)
        total = np.array(weights, dtype=float) @ self.logs[places]
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def _most_frequent(counted: DataFrame, words: int | None, ngrams: int | None) -> DataFrame:
    """The most frequent items of each kind, ties in order of the items; all of a kind without limit.

    How many items have each count tells the least count that stays and how many of its items do, so
    only those are ordered."""
    limit = F.when(F.col("kind") == 0, F.lit(words)).otherwise(F.lit(ngrams))
    down = Window.partitionBy("kind").orderBy(F.desc("all")).rowsBetween(Window.unboundedPreceding, 0)
    tally = counted.groupBy("kind", "all").agg(F.count(F.lit(1)).alias("n"))  # a row for each count
    tally = tally.withColumn("room", limit - F.sum("n").over(down) + F.col("n")).filter("room is null or room > 0")
    tally = tally.select("kind", "all", F.when(F.col("room") < F.col("n"), F.col("room")).alias("room"))
    met = counted.join(tally, ["kind", "all"])
    tied = Window.partitionBy("kind").orderBy("item")
    some = met.filter("room is not null").withColumn("place", F.row_number().over(tied)).filter("place <= room")
    return met.filter("room is null").select(*counted.columns).unionByName(some.select(*counted.columns))


def learn(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 2000,
    words: int | None = 60_000,
    ngrams: int | None = 30_000,
    least_seen: int = 2,
) -> LanguageModel:
    """Learn from rows that aren't held out and have a language and a text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = rows.filter(~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    picked = known.select("key", "lang").withColumn("n", F.row_number().over(order))
    picked = picked.filter(F.col("n") <= sample_rows).select("key").distinct()
    sample = known.join(F.broadcast(picked), "key", "left_semi")
    # of a key's rows, that with the smallest digest: bounded by `sample_rows`, however often a key repeats
    one = F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("row")
    sample = sample.groupBy("key").agg(one).select("row.lang", "row.text")
    word_schema = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])
    gram_schema = pa.schema([("kind", pa.int32()), *word_schema])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):  # keeps the tallies of a task small
            by: dict[str, Counter] = {}
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(name, Counter()).update(words_of(body))
            for name, found in by.items():
                yield batch(word_schema, [name] * len(found), list(found), list(found.values()))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1, 1 << 19):
            by: dict[tuple[str, int], Counter] = {}
            for name, word, n in zip(*(c.to_pylist() for c in b.columns)):
                for kind, size in enumerate(ORDERS, start=1):
                    tally = by.setdefault((name, kind), Counter())
                    for g in grams(word, size):
                        tally[g] += n
            for (name, kind), found in by.items():
                k = len(found)
                yield batch(gram_schema, [kind] * k, [name] * k, list(found), list(found.values()))

    # n-grams are cut from each distinct word once, not from each of its occurrences
    found = sample.mapInArrow(count_words, "lang string, item string, n long")
    found = saved(found.groupBy("lang", "item").agg(F.sum("n").alias("n")), "language-words")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = found.repartition(width, "lang", "item").mapInArrow(count_grams, "kind int, lang string, item string, n long")
    cut = cut.groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counted = saved(found.select(F.lit(0).alias("kind"), "*").unionByName(cut), "language-counts")
    totals = counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in totals})
    at = {x: i for i, x in enumerate(langs)}
    sums = [np.zeros(len(langs)) for _ in range(len(ORDERS) + 1)]
    for r in totals:
        sums[r["kind"]][at[r["lang"]]] = r["n"]
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for x, i in at.items()]
    whole = counted.groupBy("kind", "item").agg(F.sum("n").alias("all"), *each).filter(F.col("all") >= least_seen)
    kept = _most_frequent(whole, words, ngrams).toArrow()
    kinds, items = kept["kind"].to_numpy(), kept["item"].to_pylist()
    rows = np.stack([kept[f"n{i}"].to_numpy() for i in at.values()], axis=1) if langs else np.zeros((0, 0))
    counts: list[dict[str, np.ndarray]] = [{} for _ in range(len(ORDERS) + 1)]
    for kind, item, row in zip(kinds.tolist(), items, rows):
        counts[kind][item] = row
    return LanguageModel(langs, counts, sums)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", *keep: Column) -> DataFrame:
    """The kept columns with lang_pred and score, one row for each row. The model, bounded by
    `learn`, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("text"))
    at = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            langs, scores = zip(*[shared.value.predict(x) for x in b.column(at).to_pylist()])
            columns = [*b.columns[:at], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


#: Least mean share of known words and long n-grams of a recognised text.
LEAST_KNOWN = 0.5


def recognised(
    docs: DataFrame, model: LanguageModel, least: float = 0.5, known: float = LEAST_KNOWN, text: str = "text"
) -> DataFrame:
    """The rows with a language whose share is over `least`, in words of which a share of `known` or
    more is known; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accept(bodies: list[bytes | None]) -> list[bool]:
        out = []
        for body in bodies:
            lang, score, share = shared.value.judge(body.decode() if body else None)
            out.append(lang != UNKNOWN and score > least and share >= known)
        return out

    return kept_rows(docs, text, accept)
