"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). A blob is scanned once for each
version of each rule: pairs of (blob, rule version) that the ledger already holds are skipped, new ones are
scanned and appended, and findings are joined from the ledger back to every path that holds the blob. Copies therefore cost
one scan, and a second run over the same corpus costs none.

Positions without a regex-position function: ``regexp_replace`` puts a mark before, inside and after each match,
``split`` cuts there, and running sums of the piece lengths are the offsets. A mark that occurs in the text
itself is first replaced by another character of the same length that no rule matches, so offsets hold.

Defined cases: a null text is the empty text; an empty text has no finding; matches of one rule never overlap;
spans are code points, end exclusive; equal starts are in the order of the rules; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm.common import exists, fresh, light, materialize, new_path, table

MARK = "\ue000"
STAND_IN = "\ue001"

# The rules of the contract.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN_HEAD = f"(?:{'|'.join(map(_either_case, _KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?"


@dataclass(frozen=True)
class Rule:
    """``head`` and ``body`` make the pattern; matches whose body is shorter than ``least`` characters are dropped.

    ``needs``: a literal that every match holds, looked for first. ``base``: part of the contract's base set."""

    kind: str
    version: int
    head: str
    body: str
    least: int
    needs: str | None = None
    base: bool = True

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, ASSIGN_HEAD, _ASSIGN_VALUE, 6),
    # "AKIA" takes the whole run of [A-Z0-9] behind it, so a match that is too short holds no longer one.
    Rule("access", 1, "AKIA", "[A-Z0-9]{16,}", 16, "AKIA"),
    # A match is a whole run, so the least length can stand in the pattern.
    Rule("hex", 1, "", "[0-9a-f]{24,}", 24),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,30}", "PRIVATE KEY-----", 0, "-----BEGIN ", False),
    Rule("jwt", 1, "eyJ", r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, "eyJ", False),
)

_KEY_LABEL = "[A-Z ]{0,30}PRIVATE KEY-----"
_GAP = r"(?:\s|\\[nr])*+"
#: A private key's body: all up to its END line, before any other such mark; without one, the base64 that follows, and its short last line.
_KEY_BODY = rf"[^-]*+(?:-(?!----)[^-]*+){{0,400}}+-----END {_KEY_LABEL}|(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+){{1,400}}+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=\s|\\[nr]|\z))?|"
#: What is masked: as RULES, but private keys whole. The query and its SQL report the BEGIN line only.
MASKED = tuple(Rule("pem", 2, f"-----BEGIN {_KEY_LABEL}", _KEY_BODY, 0, "-----BEGIN ", False) if r.kind == "pem" else r for r in RULES)

_BLOCK = 64
SPAN = "array<struct<start:bigint,rule:int,stop:bigint>>"


def _prefix_sums(lens: Column) -> Column:
    """Sums of the lengths before each element, in blocks of 64, so that many matches don't cost their square."""
    n = F.size(lens)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.aggregate(blocks, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _spans(pieces: Column, lens: Column, before: Column, k: int, least: int) -> Column:
    """Pieces go gap, head, body, gap, head, body, ..., gap: match i has its head at 3i+1 and its body at 3i+2."""

    def at(i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        return F.element_at(before, block + 1) + F.aggregate(F.slice(lens, block * _BLOCK + 1, i % _BLOCK), F.lit(0).cast("bigint"), lambda a, x: a + x)

    n = F.floor((F.size(pieces) - 1) / 3).cast("int")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    long = F.filter(every, lambda i: F.element_at(lens, i * 3 + 3) >= least)
    return F.transform(long, lambda i: F.struct(at(i * 3 + 1).alias("start"), F.lit(k).alias("rule"), at(i * 3 + 3).alias("stop")))


def scan(df: DataFrame, text: str, out: str, rules: tuple[Rule, ...] = RULES, seen: str | None = None) -> DataFrame:
    """``df`` with ``out``: the spans of all rules in ``text``, sorted. ``seen``: rule ids not to be scanned again."""
    named = [f"__scan_{n}" for n in ("text", "pieces", "lens", "before")]
    t, p, q, b = named
    keep = [*df.columns]
    cur = df.withColumn(t, F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN))
    found = []
    for k, r in enumerate(rules):
        marked = F.regexp_replace(F.col(t), f"({r.head})({r.body})", f"{MARK}$1{MARK}$2{MARK}")
        wanted = F.lit(True)
        if r.needs:
            wanted &= F.contains(F.col(t), F.lit(r.needs))
        if seen:
            wanted &= ~F.coalesce(F.array_contains(F.col(seen), r.id), F.lit(False))
        cur = cur.withColumn(p, F.when(wanted, F.split(marked, MARK, -1)).otherwise(F.array(F.lit("")))).withColumn(q, F.transform(F.col(p), lambda x: F.char_length(x)))
        cur = cur.withColumn(b, F.when(F.size(p) > 1, _prefix_sums(F.col(q))).otherwise(F.array().cast("array<bigint>")))
        name = f"__scan_{r.kind}"
        cur = cur.withColumn(name, _spans(F.col(p), F.col(q), F.col(b), k, r.least).cast(SPAN))
        found.append(name)
    return cur.select(*keep, F.array_sort(F.concat(*found)).alias(out))


def ledger_schema() -> str:
    return f"blob_id string, rule_id string, spans {SPAN}"


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """One row for each distinct content. Copies meet in the map side's partial aggregate, so a hot blob isn't shuffled whole."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.sha2(body, 256).alias("blob_id"), body.alias("body")).groupBy("blob_id").agg(F.first("body").alias("body"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What a run adds to the ledger: (blob_id, rule_ids scanned now, spans found by them)."""
    b = blobs(versions, text)
    ids = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        return scan(b, "body", "spans", rules).select("blob_id", ids.alias("rule_ids"), "spans")
    had = ledger.groupBy("blob_id").agg(F.collect_set("rule_id").alias("had"))
    todo = b.join(had, "blob_id", "left").withColumn("rule_ids", F.array_except(ids, F.coalesce("had", F.array().cast("array<string>"))))
    todo = todo.filter(F.size("rule_ids") > 0)
    return scan(todo, "body", "spans", rules, seen="had").select("blob_id", "rule_ids", "spans")


def ledger_rows(added: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan_unseen``'s rows in the ledger's form: one row for each (blob, rule version), findings or not."""
    names = F.array(*[F.lit(r.id) for r in rules])
    row = added.select("blob_id", F.explode("rule_ids").alias("rule_id"), "spans")
    return row.select("blob_id", "rule_id", F.filter("spans", lambda s: F.element_at(names, s["rule"] + 1) == F.col("rule_id")).alias("spans"))


def from_ledger(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's findings for the current rule versions: (blob_id, spans) of the blobs that have any. A pair that two runs have added counts once."""
    now = ledger.filter(F.col("rule_id").isin([r.id for r in rules]) & (F.size("spans") > 0))
    return now.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def update(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger at ``path`` up to date with ``versions`` and returns it: only pairs of blob and rule version that it doesn't hold are scanned and
    appended, in one commit; a run that fails appends nothing. A missing ledger is begun."""
    spark = versions.sparkSession
    had = spark.read.schema(ledger_schema()).parquet(path) if exists(spark, path) else None
    ledger_rows(scan_unseen(versions, had, text, rules), rules).write.mode("append").parquet(path)
    return spark.read.schema(ledger_schema()).parquet(path)


def findings(versions: DataFrame, path: str | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, spans), written: what the ledger at ``path`` has on its blobs, after it was brought up to date. Without a path the ledger is one of this run's own."""
    return materialize(from_ledger(update(versions, path or new_path(versions.sparkSession, "ledger"), text, rules), rules), "findings")


def to_paths(versions: DataFrame, findings: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``versions`` with a column ``spans`` (another name where that is taken, see ``fresh``): each version gets the findings of its blob.

    ``findings`` has one row a blob and is best a written table. Blobs with findings are sent to the versions while they are light (``common.light``); else both
    sides of the join are plain shuffles, of which the adaptive planner splits what a hot blob's versions fill. Null texts are the empty blob; repeated rows each get a row; empty tables give none."""
    spans, blob, found = fresh(versions, spans), fresh(versions, "__blob"), fresh(versions, "__found")
    v = versions.withColumn(blob, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    f = findings.select(F.col("blob_id").alias("__blob_of_findings"), F.col("spans").alias(found)).filter(F.size(found) > 0)
    f = light(f, F.size(found) * 32 + 128)
    none = F.array().cast(SPAN)
    return v.join(f, F.col(blob) == F.col("__blob_of_findings"), "left").select(*[F.col(f"`{c}`") for c in versions.columns], F.coalesce(found, none).alias(spans))


def redact(text: Column, spans: Column, label: str = "[SECRET]") -> Column:
    """``text`` with each span, or each run of spans that overlap, replaced by ``label``; a null text, or one without spans, as it is."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), F.concat(a["out"], gap, F.lit(label)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))
        )

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns from (doc_id, spans)."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.base]
    say = lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    own = F.filter("spans", lambda s: s["rule"].isin(base))
    of = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("bigint")
    counts = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return df.select("doc_id", *counts, F.sha2(F.array_join(F.transform(own, say), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", say), ",").alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: a first run over every document, so the ledger begins empty; findings come from the ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(to_paths(docs, findings(docs)).select("doc_id", "spans"))


_SQL_MARK = "chr(57344)"


def _sql_spans(kind: str, k: int, head: str, body: str, least: int) -> str:
    quoted = f"({head})({body})".replace("'", "''")
    return f"""
{kind}_p as (select doc_id, string_split(regexp_replace(t, '{quoted}', {_SQL_MARK} || '\\1' || {_SQL_MARK} || '\\2' || {_SQL_MARK}, 'g'), {_SQL_MARK}) p from docs),
{kind}_s as (select doc_id, unnest(range(0, (len(p) - 1) // 3)) i, p from {kind}_p),
{kind} as (select doc_id, {k} k, '{kind}' kind, coalesce(list_sum(list_transform(p[1:3*i+1], lambda x: length(x))), 0)::bigint a,
  coalesce(list_sum(list_transform(p[1:3*i+3], lambda x: length(x))), 0)::bigint b from {kind}_s where length(p[3*i+3]) >= {least})"""


def oracle_sql() -> str:
    parts = ",".join(_sql_spans(r.kind, k, r.head, r.body, r.least) for k, r in enumerate(RULES))
    every = " union all ".join(f"select * from {r.kind}" for r in RULES)
    said = "kind || ':' || a || ':' || b"
    return f"""with docs as (select doc_id, replace(coalesce(text, ''), {_SQL_MARK}, chr(57345)) t from documents),{parts},
f as ({every}),
g as (select doc_id, count(*) filter (where kind = 'assign') n_assign, count(*) filter (where kind = 'access') n_access, count(*) filter (where kind = 'hex') n_hex,
  coalesce(string_agg({said}, ',' order by a, k) filter (where k < 3), '') base, string_agg({said}, ',' order by a, k) spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from docs d left join g using (doc_id)"""
