"""Spelling variants by a symmetric-delete join.

Two words differ by one inserted, deleted or replaced letter only if the word itself or one of its single deletions is among those of the
other. So every word emits itself and its distinct single deletions, as 64-bit hashes that are had for all places of a word
at once from two running sums; words are joined on equal hashes, and every pair that meets is verified on its letters. A key is shared by the words that have it with
one letter more, so a group is bounded by alphabet times length and needs no cap. Of a word's near words the most frequent one is its form,
if it is ``FACTOR`` times as frequent; roots are found by joining each word's furthest known form to that one's own, which doubles the steps each round.

Occurrences are counted a task at a time in a bounded table before they are shuffled, so frequent words meet as partial counts.

Defined cases: null and empty texts have no words; a null id is the empty string in a run's hash; repeated rows count again; ties between near words of equal
frequency go to the least in code-point order; an empty table gives no rows; extra columns are ignored; words of any length take part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, materialize, partitions, spread, table, text_batches
from lumiframe.llm.conversation import crc32_sql

#: Least letters and occurrences of a word, and how many times as frequent its form must be.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: One run in so many loses a letter, in the contract's query.
DAMAGED = 199
#: Bytes of distinct words that a task counts before it sends them on.
HELD = 32 << 20
#: The bytes of UTF-8 text that are a-z or U+00C0 to U+00FF, whose first byte is always C3.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BASE, _LETTER = np.random.default_rng(20_261).integers(1 << 62, 1 << 63, 2, np.uint64) | np.uint64(1)


def counts_of(text: str, doc_id: str, damaged: int | None) -> dict[bytes, int]:
    """Occurrences of each lower-cased run of letters of a text, with the runs that the hash of (id, run) picks short of a letter."""
    out: dict[bytes, int] = {}
    for w in _RUN.findall(text.encode().lower()):
        out[w] = out.get(w, 0) + 1
    if damaged:
        begun = zlib.crc32(f"{doc_id}:".encode())
        hurt = [w for w in out if zlib.crc32(w, begun) % damaged == 0]
        for w, n in [(w, out.pop(w)) for w in hurt]:
            letters = w.decode()
            at = zlib.crc32(w, begun) % len(letters)
            short = (letters[:at] + letters[at + 1 :]).encode()
            out[short] = out.get(short, 0) + n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int | None = None, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """(id, word, n) of the words of all documents, written; id is any number of its own. ``damaged``: see ``counts_of``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in text_batches(it, "text"):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in counts_of(t or "", i or "", damaged).items():
                    if len(w) >= letters and (w in found or len(w) >= 2 * letters or len(w.decode()) >= letters):
                        if w not in found:
                            found[w], held = 0, held + len(w) + 100
                        found[w] += n
                if held > HELD:
                    yield out()
                    found.clear()
                    held = 0
        yield out()

    src = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    words = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return materialize(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def keys_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, index) of each word and of its distinct single deletions, for words of one length at a time."""
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, at in by_length.items():
        step = max(1, (1 << 20) // n)
        for c in range(0, len(at), step):
            own = at[c : c + step]
            cp = np.frombuffer("".join(words[k] for k in own).encode("utf-32-le"), "<u4").reshape(len(own), n).astype(np.uint64)
            letter = (cp + np.uint64(1)) * _LETTER
            letter ^= letter >> np.uint64(29)
            power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, _BASE, np.uint64))))
            here = np.cumsum(letter * power, axis=1, dtype=np.uint64)
            shifted = np.cumsum(letter[:, 1:] * power[:-1], axis=1, dtype=np.uint64)  # letters after the first, one place earlier
            before = np.concatenate((np.zeros((len(own), 1), np.uint64), here[:, :-1]), axis=1)
            total = shifted[:, -1:] if n > 1 else np.zeros((len(own), 1), np.uint64)
            passed = np.concatenate((np.zeros((len(own), 1), np.uint64), shifted), axis=1)
            deleted = before + (total - passed)
            new = np.ones((len(own), n), bool)
            new[:, 1:] = cp[:, 1:] != cp[:, :-1]  # deleting either of two like letters gives the same
            row = np.broadcast_to(np.array(own)[:, None], new.shape)
            yield np.concatenate((here[:, -1], deleted[new])).view(np.int64), np.concatenate((np.array(own), row[new]))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) ids of the words that differ by exactly one letter, a < b, each pair once. ``words``: (id, word), written."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(it, "word", 1 << 20):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for key, at in keys_of(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at])], names=["key", "id"])

    sent = words.select("id", "word").mapInArrow(run, "key long, id long")
    sent = materialize(sent.repartition(partitions(words.sparkSession), "key"), "keys")
    met = sent.withColumnRenamed("id", "a").join(sent.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b").distinct()
    side = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"w{k}"))
    near = met.join(side("a"), "a").join(side("b"), "b").filter(F.levenshtein("wa", "wb", 1) == 1)
    out = materialize(near.select("a", "b"), "near")
    discard(sent)
    return out


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root) of every id of ``forms`` (id, form), which has no cycles: root is the last form that forms lead to."""
    cur = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        up = cur.select(F.col("id").alias("at"), F.col("root").alias("up"))
        new = materialize(cur.join(up, F.col("root") == F.col("at"), "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        discard(cur)
        cur = new.select("id", "root")
        cur._lumiframe_path = new._lumiframe_path
        if new.filter("moved").isEmpty():
            return cur
    raise RuntimeError(f"chains of forms didn't end in {most_rounds} rounds")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``vocabulary`` words: form is the near word of largest n (of equal ones the least), if that is
    ``factor`` times the word's own or more; root the last of the forms from there, or the word itself."""
    pairs = near_pairs(words)
    each = pairs.union(pairs.select("b", "a"))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    best = each.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("minus"), F.col("wb").alias("word"), F.col("b").alias("id"))).alias("best"))
    frequent = -F.col("best.minus") >= F.col("n") * factor
    told = words.join(best, F.col("id") == F.col("a"), "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("best"))
    told = materialize(told, "forms")
    up = roots(told.filter("best is not null").select("id", F.col("best.id").alias("form")))
    last = up.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return told.join(last, "id", "left").select("word", F.col("best.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), (-F.col("best.minus")).alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents after the contract's damage, with its form and root."""
    return variants(vocabulary(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), damaged=DAMAGED))


def oracle_sql() -> str:
    """The same by deletions as strings: words are near if one is a deletion of the other, or if both lack the same at one place."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{upper}', '{upper.lower()}') AS run FROM documents
    ), counted AS (
      SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL
    ), hashed AS (
      SELECT run, c, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted
    ), words AS (
      SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
      FROM hashed GROUP BY 1 HAVING length(word) >= {LETTERS} AND sum(c) >= {OCCURRENCES}
    ), deleted AS (
      SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
    ), near AS (
      SELECT a.word AS a, b.word AS b FROM deleted a JOIN deleted b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
      UNION SELECT word, d FROM deleted WHERE d IN (SELECT word FROM words)
      UNION SELECT d, word FROM deleted WHERE d IN (SELECT word FROM words)
    ), ranked AS (
      SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM near JOIN words ON b = word
    ), forms AS (
      SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= {FACTOR} * words.n THEN b END AS form, CASE WHEN ranked.n >= {FACTOR} * words.n THEN ranked.n END AS form_n
      FROM words LEFT JOIN ranked ON word = a AND k = 1
    ), chains AS (
      SELECT word, word AS root, 0 AS steps FROM words
      UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
    )
    SELECT word, form, arg_max(root, steps) AS root, any_value(n)::BIGINT AS n, any_value(n_near)::BIGINT AS n_near, any_value(form_n)::BIGINT AS form_n
    FROM forms JOIN chains USING (word) GROUP BY word, form
    """
