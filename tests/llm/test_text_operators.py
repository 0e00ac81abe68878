"""Language ID, token counts, packing, toxicity: accuracy, round trips, edge cases."""

import zlib

import numpy as np
import pytest

from lumiframe.llm import language_id, packing, tokens, toxicity
from lumiframe.llm.common import table

SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "día über 日本語 👍 x"), (6, "word " * 30_000), (7, "same text here"), (7, "same text here"), (None, "no id")]
DOCS = "doc_id long, text string"


def test_language_held_out_accuracy(spark):
    from lumiframe.llm.queries import queries

    got = queries()["op1_language_id"](spark, SF).toPandas()
    truth = table(spark, SF, "documents").select("doc_id", "lang").toPandas()
    m = got.merge(truth, on="doc_id")
    assert len(got) == len(truth)
    assert (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    crc = [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert got.held_out.tolist() == crc


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, "xx", "clash") for i, t in EDGE], DOCS + ", lang string, lang_pred string")
    m = language_id.fit(docs)
    got = language_id.identify(docs, m).toPandas()
    assert "lang_pred_0" in got and len(got) == len(EDGE)
    by = dict(zip(got.doc_id, zip(got.lang_pred_0, got.score, strict=True), strict=True))
    assert by[1][0] == by[2][0] == by[3][0] == "und" and by[6][0] == "xx"
    empty = spark.createDataFrame([], DOCS + ", lang string")
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    none = language_id.fit(spark.createDataFrame([(1, "abc", None)], DOCS + ", lang string"))
    assert none.predict("abc") == ("und", 0.0)


def test_every_one_of_many_languages_is_learnt(spark):
    # a language's words end in its number; labels come in unlike amounts
    langs = [f"l{g:03d}" for g in range(300)]
    spell = lambda g: "".join(chr(97 + int(c)) for c in f"{g:03d}")
    text = lambda g: " ".join(f"{stem}{spell(g)}" for stem in ("kolu", "mira", "tesa", "nopi") * 3)
    rows = [(k * 300 + g, text(g), langs[g]) for g in range(300) for k in range(4 + 20 * (g % 5 == 0))]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    for bounds in ({}, {"max_docs_per_lang": 8, "max_entries": 300 * 300 * 3}):
        m = language_id.fit(docs, **bounds)
        assert m.langs == langs
        assert [m.predict(text(g))[0] for g in range(300)] == langs
    assert len(m.words) <= 3 * 300 and m.word_table.size <= 300 * 300 * 3
    assert language_id.entries_per_lang(10**6, 100) == 1


def test_backoff_goes_from_words_to_shorter_grams():
    from collections import Counter

    m = language_id.fit_counts({"a": Counter({"hello": 5, "help": 5, "held": 5}), "b": Counter({"bonjour": 5, "bon": 5, "jour": 5})})
    assert np.argmax(m.word_scores("hello")) == 0
    assert np.argmax(m.word_scores("helicopter")) == 0
    assert np.argmax(m.word_scores("journal")) == 1
    assert (m.word_scores("zzz") == 0).all()


def test_token_counts_round_trip(spark):
    got = tokens.token_counts(table(spark, SF, "documents")).toPandas()
    for d, t in table(spark, SF, "documents").select("doc_id", "text").limit(40).collect():
        ids = tokens._json_tokenizer(None).encode(t or "", add_special_tokens=False).ids
        own = got[got.doc_id == d].sort_values("section")
        assert own.n_tokens.sum() == len(ids)
        assert own.start.tolist() == [0, *own.stop.tolist()[:-1]] and own.stop.iloc[-1] == len(t or "")
    edge = tokens.token_counts(spark.createDataFrame(EDGE, DOCS)).toPandas()
    assert edge[edge.doc_id == 1].n_tokens.tolist() == [0]
    assert len(edge[edge.doc_id == 7]) == 2 and edge.doc_id.isna().sum() == 1
    assert tokens.token_counts(spark.createDataFrame([], DOCS)).count() == 0


def test_token_counts_against_a_slow_join(spark):
    """Every document, every token against every line it touches."""
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    want = {}
    for d, t in docs.items():
        lines, at = [], 0
        for x in t.split("\n"):
            lines.append((at, at + len(x) + 1))
            at += len(x) + 1
        lines = [(a, min(b, len(t))) for a, b in lines if a < len(t)] or [(0, 0)]
        n, cross = [0] * len(lines), [0] * len(lines)
        for s, e in tokens._json_tokenizer(None).encode(t, add_special_tokens=False).offsets:
            shares = [max(0, min(b, e) - max(a, s)) for a, b in lines]
            k = shares.index(max(shares))
            n[k] += 1
            cross[k] += sum(x > 0 for x in shares) > 1
        want |= {(d, k): (*lines[k], n[k], cross[k]) for k in range(len(lines))}
    got = {(r.doc_id, r.section): (r.start, r.stop, r.n_tokens, r.n_crossing) for r in tokens.token_counts(table(spark, SF, "documents")).collect()}
    assert got == want


def test_runs_that_the_fast_tokenizer_breaks_off_at(spark):
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a" * 1_000_000)]
    n = {d: len(tokens._json_tokenizer(None).encode(t, add_special_tokens=False).ids) for d, t in rows}
    docs = spark.createDataFrame(rows, DOCS)
    got = tokens.token_counts(docs).groupBy("doc_id").agg({"n_tokens": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == n
    got = packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in got} == {d: k + 1 for d, k in n.items()}


def test_spans_match_the_tokenizer_offsets():
    for t in ("plain words, and more.", "día über 日本語 👍 x", "a<|endoftext|>b", "x" * 500):
        e = tokens._json_tokenizer(None).encode(t, add_special_tokens=False)
        assert tokens.encode(t).tolist() == e.ids
        s, z = tokens.char_spans(t, tokens.encode(t))
        assert list(zip(s.tolist(), z.tolist(), strict=True)) == e.offsets


@pytest.mark.parametrize("rule", tokens.RULES)
def test_crossing_tokens_go_where_the_rule_says(rule):
    # a token over [2, 9) with cuts at 4 and 5: 2, 1 and 4 characters
    sec, cross = tokens.attribute(np.array([0, 2]), np.array([2, 9]), np.array([0, 4, 5]), rule)
    assert sec.tolist() == ([0, 0] if rule == "start" else [0, 2]) and cross.tolist() == [False, True]
    with pytest.raises(ValueError):
        tokens.attribute(np.array([0]), np.array([1]), np.array([0]), "other")


def _check_packing(got, texts):
    got = got.sort_values(["doc_id", "start"])
    enc = {d: np.append(tokens._json_tokenizer(None).encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for d, t in texts.items()}
    for d, own in got.groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(enc[d])
            assert zlib.crc32(enc[d][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(enc[d])
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        n = own.length.sum()
        assert n <= 2048 and n & (n - 1) == 0


def test_packing_round_trip(spark):
    docs = table(spark, SF, "documents")
    got = packing.pack(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got.doc_id) == set(texts)
    _check_packing(got, texts)


def test_packing_edges(spark):
    rows = [e for e in EDGE if e[0] not in (7, None)]
    _check_packing(packing.pack(spark.createDataFrame(rows, DOCS)).toPandas(), dict(rows))
    both = packing.pack(spark.createDataFrame([(7, "x"), (7, "x"), (None, "y")], DOCS)).toPandas()
    assert both.length.sum() == 6
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_step_groups_hold_equal_tokens():
    p = packing.Packer(step_tokens=4096)
    rng = np.random.default_rng(0)
    for k in range(400):
        p.add(k, rng.integers(0, 9, rng.integers(1, 3000)).astype(np.uint32))
    p.finish()
    import pandas as pd

    rows = pd.DataFrame(p.drain(), columns=packing.PACKED.names)
    per = rows.groupby(["tier", "step_group"]).length.sum().reset_index()
    for _, own in per[per.tier >= 256].groupby("tier"):
        assert (own.length.iloc[:-1] == 4096).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    from lumiframe.llm.queries import queries

    got = queries()["op9_toxicity"](spark, sf).toPandas()
    m = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    m = m[m.held_out]
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hit / max(1, (m.predicted == 1).sum()) > 0.8 and hit / m.toxic.sum() > 0.5
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_folding_boundaries_and_exceptions():
    assert toxicity.fold("1D10T Idiоt TR@SH l0ser $$$") == "idiot idiot trash ioser $$$"
    m = toxicity.Model({"idiot": 4.0, "trash": 3.0, "réeux*": 2.0}, (-3.0, 1.0, 1.0))
    spans = lambda t: [(s, e) for s, e, _ in m.matches(toxicity.fold(t))]
    assert spans("an 1d10t!") == [(3, 8)]
    assert spans("idiotic") == [] and spans("the trash can") == [] and spans("the trash cannot") == [(4, 9)]
    assert spans("réeuxpa xréeux") == [(0, 5)]
    assert m.score(None) == m.score("") < m.score("idiot " + "word " * 300) < m.score("idiot")
    import pickle

    assert pickle.loads(pickle.dumps(m)).score("idiot") == m.score("idiot")


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in EDGE], DOCS + ", toxicity string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs, none)
    got = toxicity.score(docs, m).toPandas()
    assert len(got) == len(EDGE) and got.toxicity_0.nunique() == 1 and got.toxicity_0.max() < 0.3
    assert toxicity.score(spark.createDataFrame([], DOCS), m).count() == 0
