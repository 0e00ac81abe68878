"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps each character to one character: letters are lowered, look-alikes of other scripts and digits that stand for
letters become Latin letters, and l counts as i; accents stay, since they tell words apart. Terms are whole words or stems that begin
a word; a word counts once, with its heaviest term; words inside an exception phrase don't count. The weights found are summed, normalised by the text's length in words, and calibrated to a
probability by a logistic curve.

Lexicon, weights and curve are fitted on a bounded sample of labelled rows (``max_docs_per_class``, drawn by a hash of the id). The
lexicon has at most ``max_terms`` terms, so what is broadcast has a fixed bound. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import discard, fresh, held_out, materialize, spread, table, text_batches

MAX_DOCS_PER_CLASS = 3_000
MAX_TERMS = 2_000
#: Least likelihood-ratio statistic of a term, and least number of toxic documents that hold it.
LEAST_G2, LEAST_DOCS = 30.0, 3
#: Terms are whole words and, written with an asterisk, stems: word beginnings of these lengths.
STEMS = range(5, 10)
#: Occurrences of a term that count in one document, for its weight.
PER_DOC = 5
THRESHOLD = 0.3

# Look-alikes, digits and signs that stand for Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "sore loser board", "hate crime law")

_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_WORD = re.compile(r"[^\W\d_]+")


class _Fold(dict):
    """Translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        low = c.lower()
        low = low if len(low) == 1 else c
        out = LOOKALIKES.get(low) or DIGITS.get(low)
        if out is None:
            wide = unicodedata.normalize("NFKC", low)  # full-width and styled letters; accents stay, they tell words apart
            out = LOOKALIKES.get(wide, wide) if len(wide) == 1 else low
        out = "i" if out == "l" else out
        if len(self) < 1 << 16:
            self[code] = ord(out)
        return ord(out)


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Same length as ``text``."""
    t = (text or "").translate(_FOLD)
    if any(s in t for s in SIGNS):
        t = _SIGN.sub(lambda m: SIGNS[m[0]], t)
    return t


@dataclass
class Model:
    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            found: dict[str, list] = {}
            for e in self.exceptions:
                found.setdefault(fold(e), [None, None, False])[2] = True
            for w, x in self.weights.items():
                found.setdefault(w.rstrip("*"), [None, None, False])[w.endswith("*")] = x
            a = ahocorasick.Automaton()
            for w, x in found.items():
                a.add_word(w, (len(w), *x))
            if len(a):
                a.make_automaton()
            self._machine = a
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest term at each word that has one, outside exception phrases."""
        a = self.machine()
        if not len(a) or not folded:
            return []
        hits: dict[int, tuple[int, float]] = {}
        spared, n = [], len(folded)
        for last, (size, whole, stem, phrase) in a.iter(folded):
            s, e = last - size + 1, last + 1
            if s and folded[s - 1].isalpha():
                continue
            ends = e == n or not folded[e].isalpha()
            if ends and phrase:
                spared.append((s, e))
            x = max(whole if ends and whole is not None else 0.0, stem or 0.0)
            if x > hits.get(s, (0, 0.0))[1]:
                hits[s] = e, x
        return [(s, e, x) for s, (e, x) in sorted(hits.items()) if not any(p <= s and e <= q for p, q in spared)]

    def features(self, text: str | None) -> tuple[float, float]:
        t = fold(text)
        w = sum(x for _, _, x in self.matches(t))
        return float(w > 0), math.log1p(100.0 * w / max(1, len(t.split())))

    def score(self, text: str | None) -> float:
        f = self.features(text)
        z = self.curve[0] + self.curve[1] * f[0] + self.curve[2] * f[1]
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Weighted logistic regression on two features by Newton steps; slopes are held at zero or above."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return math.log(p / (1 - p)), 0.0, 0.0
    use = [0, 1, 2]
    while True:
        a = np.column_stack((np.ones(len(y)), x))[:, use]
        b, reg = np.zeros(len(use)), np.diag([1e-6] + [ridge] * (len(use) - 1)) * w.sum() / len(w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + reg, a.T @ (w * (y - p)) - reg @ b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(3)
        out[use] = b
        if (out[1:] >= 0).all():
            return tuple(map(float, out))
        use = [0] + [k for k in use[1:] if out[k] >= 0]


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(text, toxic) of a bounded sample of the labelled rows that aren't held out, rows in it by class, and the rates drawn."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    rates = {k: min(1.0, most / n) for k, n in sizes.items()}
    rate = F.when(F.col("toxic") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    drawn = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("t")), F.lit(1_000_003)) / 1_000_003.0 < rate)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), sizes, rates


def fit(docs: DataFrame, labels: DataFrame, max_docs_per_class: int = MAX_DOCS_PER_CLASS, max_terms: int = MAX_TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Terms that toxic documents hold significantly more often, their log odds as weights, and the curve."""
    sample, _, rates = _sample(docs, labels, max_docs_per_class)

    def count(it):
        docs_with, times, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0, 0, 0]

        def rows():
            terms = [None, *(docs_with[0].keys() | docs_with[1].keys())]
            for k in (0, 1):
                docs_with[k][None], times[k][None] = n[k], n[2 + k]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[w] for w in terms], pa.int64()) for c in (*docs_with, *times)]], names=["term", "b", "a", "tb", "ta"])
            n[:] = [0] * 4
            for c in (*docs_with, *times):
                c.clear()

        for batch in text_batches(it, "text"):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for w, c in Counter(words := _WORD.findall(fold(t))).items():
                    own[w] += c
                    for k in STEMS:
                        if k > len(w):
                            break
                        own[w[:k] + "*"] += c
                docs_with[y].update(own.keys())
                times[y].update({w: min(c, PER_DOC) for w, c in own.items()})
                n[y] += 1
                n[2 + y] += len(words)
            if len(docs_with[0]) + len(docs_with[1]) > 400_000:
                yield from rows()
        yield from rows()

    sums = [F.sum(c).alias(c) for c in ("b", "a", "tb", "ta")]
    counts = materialize(sample.mapInArrow(count, "term string, b long, a long, tb long, ta long").groupBy("term").agg(*sums).filter(f"term is null or a >= {LEAST_DOCS}"), "terms")
    total = counts.filter("term is null").first()
    nb, na, ntb, nta = (float(total[c]) for c in ("b", "a", "tb", "ta")) if total else (0.0,) * 4
    share = (F.col("a") + F.col("b")) / F.lit(na + nb)
    term = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * share))).otherwise(0.0)
    rest = lambda k, n: F.when(F.col(k) < n, (n - F.col(k)) * F.log((n - F.col(k)) / (n * (1 - share)))).otherwise(0.0)
    scored = counts.filter("term is not null and char_length(term) >= 3").withColumn("g2", 2 * (term("a", na) + term("b", nb) + rest("a", na) + rest("b", nb)))
    rows = scored.filter((F.col("g2") >= LEAST_G2) & (F.col("a") * nb > 2 * F.col("b") * na)).orderBy(F.desc("g2"), "term").limit(max_terms).collect() if na and nb else []
    discard(counts)
    weights = {r["term"]: w for r in rows if (w := math.log((r["ta"] + 0.5) / (nta + 1)) - math.log((r["tb"] + 0.5) / (ntb + 1))) > 0}
    model = Model(weights, (0.0, 0.0, 0.0), exceptions)

    def measure(it):
        for b in text_batches(it, "text"):
            f = [model.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f]), pa.array([x for _, x in f]), b.column(1)], names=["hit", "density", "toxic"])

    seen = sample.mapInArrow(measure, "hit double, density double, toxic int").toArrow().to_pydict()
    y = np.array(seen["toxic"], float)
    w = np.array([1.0 / rates[int(k)] for k in y])
    model.curve = fit_curve(np.column_stack((seen["hit"], seen["density"])).reshape(-1, 2).astype(float), y, w / w.mean() if len(w) else w)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a score column (``toxicity``, another name where that is taken). Null and empty texts score as texts without a match."""
    name, at = fresh(docs, "toxicity"), docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = sent.value
        for b in text_batches(it, text):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t) for t in b.column(at).to_pylist()], pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document.

    Labels other than 0 and 1 and labels without a document are passed over; a document labelled twice counts as toxic if either
    label says so; without labels all scores are alike and low; repeated rows each get a row; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    s = score(spread(docs.select("doc_id", "text", held_out().alias("held_out"))), model)
    return s.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
