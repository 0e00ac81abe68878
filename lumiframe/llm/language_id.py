"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams, longest first:
the mean score of those of its 5-grams that are known, else of its 4-grams, and so on down to single characters.

The model is fitted on a bounded sample of labelled rows and keeps a bounded number of entries; the bounds are parameters of ``fit``:

* ``max_docs_per_lang``: about so many labelled documents a language, drawn by a hash of the id.
* ``max_words_per_lang``, ``max_grams_per_lang``: the most frequent words and n-grams of a language.
* ``max_entries``: words, and n-grams, times languages. Beyond it each language keeps fewer of both, never fewer languages: every label
  of the sample can be predicted, however many there are.

So what is broadcast has a fixed bound as long as there are fewer than 4,000 languages (its tables have one entry a language at least). Prediction is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import filter_rows, fresh, held_out, spread, table, text_batches

UNDETERMINED = "und"
MAX_DOCS_PER_LANG = 1_000
MAX_WORDS_PER_LANG = 20_000
MAX_GRAMS_PER_LANG = 40_000
MAX_ENTRIES = 16_000_000
MAX_N = 5
#: Scores of words that a task keeps for the texts to come, 32 MB.
CACHED_SCORES = 1 << 22
#: Evidence counts as that of at most so many words, so that scores of long texts aren't all 1.
EVIDENCE_WORDS = 12.0

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """Scores by language, centred: rows of two tables, found by word and by n-gram."""

    langs: list[str]
    words: dict[str, int]
    word_table: np.ndarray
    grams: dict[str, int]
    gram_table: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)
    _used: int = 0

    def word_scores(self, w: str) -> np.ndarray:
        """Log scores of one word in each language."""
        r = self.words.get(w)
        if r is not None:
            return self.word_table[r]
        padded = f"^{w}$"
        for n in range(MAX_N, 0, -1):
            src = padded if n > 1 else w
            known = [g for k in range(len(src) - n + 1) if (g := self.grams.get(src[k : k + n])) is not None]
            if known:
                return self.gram_table[known].mean(0)
        return np.zeros(len(self.langs))

    def _row(self, w: str) -> int:
        r = self._rows.get(w)
        if r is None:
            r = self._rows[w] = self._used
            self._table[r] = self.word_scores(w)
            self._used += 1
        return r

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); (``und``, 0) for a text without letters or a model without languages."""
        if not self.langs or not text:
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.langs)), 0
        ws = words_of(text)
        cached = max(1 << 10, min(1 << 17, CACHED_SCORES // len(self.langs)))
        step = min(cached, 1 << 14)
        for k in range(0, len(ws), step):
            part = ws[k : k + step]
            if self._table is None or self._used + len(part) > len(self._table):  # scores are cached up to a bound, then afresh
                self._rows.clear()
                self._table, self._used = np.zeros((cached, len(self.langs))), 0
            get, row = self._rows.get, self._row
            idx = [r if (r := get(w)) is not None else row(w) for w in part]
            total += self._table[idx].sum(0)
            n += len(part)
        if not n or not any(c.isalpha() for w in ws for c in w):
            return UNDETERMINED, 0.0
        z = total * min(1.0, EVIDENCE_WORDS / n)
        z = np.exp(z - z.max())
        best = int(np.argmax(z))  # ties: the first in alphabetical order
        return self.langs[best], float(z[best] / z.sum())


def _scores(tables: list[dict[str, int]], most: int, least: int = 2, alpha: float = 0.5) -> tuple[dict[str, int], np.ndarray]:
    """(row of each entry, centred log frequencies by language) of the ``most`` most frequent entries of each language that occur ``least`` times in it."""
    kept = sorted({w for t in tables for w, c in sorted(t.items(), key=lambda x: (-x[1], x[0]))[:most] if c >= least})
    counts = np.array([[t.get(w, 0) for w in kept] for t in tables], float).reshape(len(tables), -1).T
    total = np.array([sum(t.values()) for t in tables], float)
    logs = np.log(counts + alpha) - np.log(total + alpha * (len(kept) + 1))
    return {w: k for k, w in enumerate(kept)}, logs - logs.mean(1, keepdims=True)


def entries_per_lang(langs: int, most: int, max_entries: int = MAX_ENTRIES) -> int:
    """How many entries a language keeps, at least one: a table has a row for each kept entry and a column for each language."""
    return max(1, min(most, max_entries // max(1, langs) ** 2))


def fit_counts(by_lang: dict[str, dict[str, int]], max_words: int = MAX_WORDS_PER_LANG, max_grams: int = MAX_GRAMS_PER_LANG, max_entries: int = MAX_ENTRIES) -> Model:
    """The model of word counts by language. A word, or an n-gram, counts as known from its second occurrence on in some language."""
    langs = sorted(by_lang)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    rows, parts = {}, []
    max_words, max_grams = (entries_per_lang(len(langs), most, max_entries) for most in (max_words, max_grams))
    words, word_table = _scores([by_lang[g] for g in langs], max_words)
    for n in range(1, MAX_N + 1):
        tables = []
        for g in langs:
            t: dict[str, int] = defaultdict(int)
            for w, c in by_lang[g].items():
                src = f"^{w}$" if n > 1 else w
                for k in range(len(src) - n + 1):
                    t[src[k : k + n]] += c
            tables.append(t)
        own, table_ = _scores(tables, max(1, max_grams // MAX_N))
        base = sum(map(len, parts))
        rows |= {w: base + k for w, k in own.items()}
        parts.append(table_)
    return Model(langs, words, word_table, rows, np.concatenate(parts))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs_per_lang: int = MAX_DOCS_PER_LANG, max_words_per_lang: int = MAX_WORDS_PER_LANG, max_grams_per_lang: int = MAX_GRAMS_PER_LANG, max_entries: int = MAX_ENTRIES) -> Model:
    """Fits on rows whose language is known and whose id isn't held out, within the bounds that the module's text names; no language is left out."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id") & (F.col("lang") != UNDETERMINED))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row for each label
    if not sizes:
        return fit_counts({})
    words_kept = entries_per_lang(len(sizes), max_words_per_lang, max_entries)
    rates = {g: rate for g, n in sizes.items() if (rate := max_docs_per_lang / n) < 1}
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang")), F.lit(1.0)) if rates else F.lit(1.0)
    draw = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0) < rate

    def count(it):
        by: dict[str, Counter] = defaultdict(Counter)
        for b in text_batches(it, "text"):
            for g, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                by[g].update(words_of(t))
            if sum(map(len, by.values())) > 300_000:
                yield from _count_rows(by)
                by.clear()
        yield from _count_rows(by)

    counted = known.filter(draw).select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    w = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    rows = counted.withColumn("r", w).filter(F.col("r") <= words_kept).select("lang", "word", "n").toArrow().to_pydict()
    by_lang: dict[str, Counter] = {g: Counter() for g in sizes}
    for g, word, n in zip(rows["lang"], rows["word"], rows["n"], strict=True):
        by_lang[g][word] = n
    return fit_counts(by_lang, max_words_per_lang, max_grams_per_lang, max_entries)


def _count_rows(by: dict[str, Counter]):
    for g, c in by.items():
        if c:
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (other names where these are taken, see ``fresh``); texts are read whole, nothing else is looked at."""
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = sent.value
        for b in text_batches(it, text):
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, found with a probability of at least ``least``; columns untouched."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> list[bool]:
        return [g != UNDETERMINED and s >= least for g, s in map(sent.value.predict, texts)]

    return filter_rows(docs, text, keep)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document.

    Null texts and texts without letters are ``und`` with score 0; repeated rows each get a row; ties go to the first language in
    alphabetical order; an empty table, or one without labels, gives ``und`` throughout."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return identify(spread(docs.select("doc_id", "text", held_out().alias("held_out"))), model).select("doc_id", "held_out", "lang_pred", "score")
