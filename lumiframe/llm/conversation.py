"""Conversation structure repair by a min-plus matrix scan.

Roles of a sound conversation read ``(s?(ua)+)?`` by their initials, four states: nothing yet, after the system turn, after a user turn, after
an assistant turn. A turn is a 4x4 matrix: entry (i, j) is the cheapest way (cost, audit) to take the turn from state i to j by keeping,
re-roling or deleting it, with the closure of insertions on both sides. Products of such matrices are associative (two audits of equal cost over the
same turns are never prefixes of each other, since each insertion costs, so the order of audits agrees with concatenation). So turns are put into one order by a
range exchange, blocks of it are reduced to a matrix each, and blocks of one conversation are multiplied ``FAN`` at a time, in rounds, until each has
one matrix. The way back hands every block its states on the cheapest path, round by round, and blocks turn them into edits of turns. No task
holds a conversation, however long; the audit itself is one value of the result.

Defined cases: null roles and texts are one space; null conversation ids are one conversation; null turns come first; turns of equal number are in
the order of role and text; repeated rows are duplicates; a role whose first character is none of s, u and a is re-roled or deleted, so is an empty one; a
conversation without turns has an empty audit; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, materialize, partitions, spread, table

#: Turns of a leaf block, and blocks of one product.
LEAF, FAN = 512, 16
# Costs of edits, and what a truncated turn adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: State after a turn with the initial, by the state before; no entry: not allowed.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
END = (0, 3)
SOUND, BLANK, DUPLICATE, CUT = range(4)
SPACE = " \t\n\x0b\x0c\r"

Matrix = list  # of 16 (cost, audit) or None, row by row
ONE: Matrix = [(0, "") if k % 5 == 0 else None for k in range(16)]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product: the least sum of costs, of equal ones the least joined audit."""
    out: Matrix = [None] * 16
    for i in range(4):
        for k in range(4):
            if x := a[4 * i + k]:
                for j in range(4):
                    if y := b[4 * k + j]:
                        z = (x[0] + y[0], x[1] + y[1])
                        if out[4 * i + j] is None or z < out[4 * i + j]:
                            out[4 * i + j] = z
    return out


def _closure() -> Matrix:
    step = [min(x) if (x := [(INSERT, "I") for role in "ua" if NEXT[role].get(i) == j] + [(0, "")] * (i == j)) else None for i in range(4) for j in range(4)]
    return times(times(step, step), step)


CLOSURE = _closure()


def _edits(initial: str, fault: int) -> Matrix:
    """One turn without insertions."""
    ways: list[list] = [[] for _ in range(16)]
    for i in range(4):
        ways[5 * i].append((DELETE, "D"))
        if fault in (SOUND, CUT):
            more = TRUNCATED if fault == CUT else 0
            if (j := NEXT.get(initial, {}).get(i)) is not None:
                ways[4 * i + j].append((more, "K"))
            for role in "ua":
                if (j := NEXT[role].get(i)) is not None:
                    ways[4 * i + j].append((REROLE + more, "R"))
    return [min(w) if w else None for w in ways]


#: Each turn's matrix with insertions after it; those before a conversation's first turn are added once.
TURNS = {(r, f): times(_edits(r, f), CLOSURE) for r in "sua?" for f in range(4)}


def product(parts: list[Matrix]) -> Matrix:
    """The product of adjacent matrices, by halves, so that audits aren't copied once for each turn."""
    while len(parts) > 1:
        parts = [times(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else ONE


def way(parts: list[Matrix], start: int, end: int) -> list[int]:
    """States before and after each of the parts on the cheapest way from ``start`` to ``end``."""
    best = [{start: (0, "", None)}]
    for m in parts:
        best.append({})
        for i, (cost, audit, _) in best[-2].items():
            for j in range(4):
                if x := m[4 * i + j]:
                    z = (cost + x[0], audit + x[1], i)
                    if j not in best[-1] or z[:2] < best[-1][j][:2]:
                        best[-1][j] = z
    states = [end]
    for at in reversed(best[1:]):
        states.append(at[states[-1]][2])
    return states[::-1]


def edits(turns: list[tuple[str, int]], start: int, end: int) -> list[tuple[str, str, str]]:
    """(edit, new initial or nothing, initials inserted after it) of each (initial, fault) on the cheapest way; see ``way``."""
    out = []
    steps = [m for t in turns for m in (_EDITS[t], CLOSURE)]
    states = way(steps, start, end)
    for k, t in enumerate(turns):
        i, j, after = states[2 * k : 2 * k + 3]
        audit = _EDITS[t][4 * i + j][1]
        out.append((audit, "" if audit == "D" else "?sua"[j], _inserted(j, after)))
    return out


_EDITS = {t: _edits(*t) for t in TURNS}


def _inserted(i: int, j: int) -> str:
    """Initials of the turns that the closure inserts from state i to j."""
    return {(0, 2): "u", (0, 3): "ua", (1, 2): "u", (1, 3): "ua", (2, 3): "a", (3, 2): "u"}.get((i, j), "")


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, pos) of every row, written: pos numbers the rows in the order of conversation, turn, role and text.

    Rows that are equal in all four are told apart by their place in the input, so they needn't meet in one task."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    src = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    src = src.withColumn("__at", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "__at"]
    n = partitions(turns.sparkSession)
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__at")
    return materialize(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _faults(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, block, initial, fault) of ``ordered`` turns; block numbers pieces of ``LEAF`` positions without gaps."""
    mean = F.rtrim("text", F.lit(SPACE))
    blank = F.length(mean) == 0
    firsts = turns.filter(~blank).groupBy("conv_id", "role", F.sha2("text", 256).alias("h")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("__first"))
    cut = ~F.substring(mean, -1, 1).isin(".", "!", "?")
    part, index = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    most = turns.agg(F.max(index)).first()[0] or 0
    block = part * (most // LEAF + 1) + F.floor(index / LEAF)
    initial = F.substring("role", 1, 1)
    rows = turns.select("conv_id", "pos", block.cast("long").alias("block"), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), blank.alias("b"), cut.alias("c"))
    fault = F.when(F.col("b"), BLANK).when(F.col("__first").isNull(), DUPLICATE).when(F.col("c"), CUT).otherwise(SOUND)
    return rows.join(firsts, "pos", "left").select("conv_id", "pos", "block", "initial", fault.alias("fault"))


_COSTS, _AUDITS = pa.list_(pa.int64()), pa.list_(pa.string())
#: Columns that grouped functions return besides conv_id, whose type is the input's.
TYPES = {"block": pa.int64(), "pos": pa.int64(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "costs": _COSTS, "audits": _AUDITS, "start": pa.int32(), "end": pa.int32(), "edit": pa.string(), "initial": pa.string(), "after": pa.string()}


def _grouped(keys: list[str], run: Callable[[tuple, list[tuple]], list[tuple]], names: list[str]):
    """Streams rows sorted by ``keys`` and gives each group of them, bounded by its maker, to ``run``; rows of results have the columns ``names``."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, out, held = None, [], [], 0
        for b in it:
            types = [TYPES.get(n) or b.schema.field(n).type for n in names]
            at = [b.schema.get_field_index(k) for k in keys]
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = tuple(row[k] for k in at)
                if key != cell:
                    if rows:
                        out += (new := run(cell, rows))
                        held += sum(1 + len(x[-1] if isinstance(x[-1], str) else "".join(filter(None, x[-1]))) if isinstance(x[-1], str | list) else 1 for x in new)
                    cell, rows = key, []
                    if held > 1 << 16:
                        yield _batch(out, names, types)
                        out, held = [], 0
                rows.append(row)
        if rows:
            yield _batch(out + run(cell, rows), names, types)

    return go


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


SEGMENT = "block long, first string, last string, illegal long, costs array<long>, audits array<string>"
LEGAL = ("su", "ua", "au")


def _split(m: Matrix) -> tuple[list, list]:
    return [x and x[0] for x in m], [x and x[1] for x in m]


def _joined(costs: list, audits: list) -> Matrix:
    return [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]


def _reduce_leaf(cell, rows):
    """(conv_id, block, first, last, illegal, costs, audits) of a block's turns (conv_id, block, pos, initial, fault)."""
    roles = [r[3] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    return [(*cell, roles[0], roles[-1], illegal, *_split(product([TURNS[r[3], r[4]] for r in rows])))]


def _reduce_inner(cell, rows):
    """The same of blocks (conv_id, parent, block, first, last, illegal, costs, audits), for the parent."""
    illegal = sum(r[5] for r in rows) + sum(a[4] + b[3] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return [(*cell, rows[0][3], rows[-1][4], illegal, *_split(product([_joined(*r[6:]) for r in rows])))]


def _states_inner(cell, rows):
    """(conv_id, block, start, end) of blocks (conv_id, parent, block, costs, audits, start, end), whose start and end are the parent's."""
    states = way([_joined(*r[3:5]) for r in rows], rows[0][5], rows[0][6])
    return [(cell[0], r[2], i, j) for r, i, j in zip(rows, states, states[1:], strict=False)]


def _states_leaf(cell, rows):
    """(pos, edit, initial, after) of turns (conv_id, block, pos, initial, fault, start, end)."""
    return [(r[2], *e) for r, e in zip(rows, edits([(r[3], r[4]) for r in rows], *rows[0][5:]), strict=True)]


def _by(df: DataFrame, keys: list[str], order: str, run, ddl: str) -> DataFrame:
    names = [f.split()[0] for f in ddl.split(", ")]
    # rows of a group are few by construction; groups of a long conversation go to different tasks
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, order).mapInArrow(_grouped(keys, run, names), ddl)


def scan(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``ordered`` turns: (conv_id, start, end, cost, audit, illegal, blank, duplicate, truncated) of each conversation, and (pos, edit,
    initial, after) of each turn, both written. start is the state that insertions before the first turn lead to."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = materialize(_faults(turns).select("conv_id", "block", "pos", "initial", "fault"), "faults")
    counts = rows.groupBy("conv_id").agg(*[F.sum((F.col("fault") == k).cast("long")).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))])
    levels = [materialize(_by(rows, ["conv_id", "block"], "pos", _reduce_leaf, f"conv_id {kind}, {SEGMENT}"), "blocks")]
    done = None
    while True:
        top = levels[-1]
        several = top.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        alone = top.join(several.filter("n = 1").select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
        alone = materialize(alone.withColumn("level", F.lit(len(levels) - 1)), "whole")
        done = alone if done is None else done.unionByName(alone)
        rest = top.join(several.filter("n > 1").select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
        if rest.isEmpty():
            break
        up = rest.select("conv_id", F.floor(F.col("block") / FAN).cast("long").alias("parent"), "block", "first", "last", "illegal", "costs", "audits")
        levels.append(materialize(_by(up, ["conv_id", "parent"], "block", _reduce_inner, f"conv_id {kind}, {SEGMENT}"), "blocks"))
    whole = materialize(done.mapInArrow(_best, f"conv_id {kind}, block long, level int, illegal long, start int, end int, cost long, audit string"), "best")

    states = None
    for k in range(len(levels) - 1, -1, -1):
        roots = whole.filter(F.col("level") == k).select("conv_id", "block", "start", "end")
        if k + 1 < len(levels):
            above = states.select(F.col("conv_id").alias("c"), F.col("block").alias("parent"), "start", "end")
            blocks = levels[k].select("conv_id", F.floor(F.col("block") / FAN).cast("long").alias("up"), "block", "costs", "audits")
            under = blocks.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("parent"))).select("conv_id", "parent", "block", "costs", "audits", "start", "end")
            roots = roots.union(_by(under, ["conv_id", "parent"], "block", _states_inner, f"conv_id {kind}, block long, start int, end int"))
        states = materialize(roots, "states")
    at = states.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), "start", "end")
    under = rows.join(at, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))).select("conv_id", "block", "pos", "initial", "fault", "start", "end")
    found = materialize(_by(under, ["conv_id", "block"], "pos", _states_leaf, "pos long, edit string, initial string, after string"), "edits")
    out = materialize(whole.join(counts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c", "block", "level"), "whole")
    discard(rows, *levels, states, whole)
    return out, found


def _best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insertions before the first turn, and the cheapest end, of whole conversations."""
    for b in it:
        at = {n: b.column(b.schema.get_field_index(n)) for n in ("conv_id", "block", "level", "illegal")}
        rows = []
        for costs, audits in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("costs", "audits")), strict=True):
            m = _joined(costs, audits)
            (cost, audit), start, end = min(((CLOSURE[i][0] + m[4 * i + j][0], CLOSURE[i][1] + m[4 * i + j][1]), i, j) for i in range(4) for j in END if CLOSURE[i] and m[4 * i + j])
            rows.append((start, end, cost, audit))
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*at.values(), *cols], names=[*at, "start", "end", "cost", "audit"])


def _named(initial: str) -> Column:
    return F.when(F.col(initial) == "u", "user").otherwise("assistant")


def repaired(turns: DataFrame, whole: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, k, role, text, edit) of the turns after repair, ordered by (pos, k) in each conversation: k is 1 for a turn of the input, 0 or
    less for one inserted before it (before the first turn of a conversation only), 2 or more after it."""
    head = turns.groupBy("conv_id").agg(F.min("pos").alias("pos"))
    before = F.when(F.col("start") == 2, F.lit("u")).when(F.col("start") == 3, F.lit("ua")).otherwise("")
    opened = whole.filter("start >= 2").select(F.col("conv_id").alias("c"), before.alias("new"))
    opened = head.join(opened, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "pos", F.lit(-2).alias("at"), "new")
    both = turns.join(found, "pos")
    stay = both.filter("edit <> 'D'").select("conv_id", "pos", F.lit(1).alias("k"), F.when(F.col("edit") == "R", _named("initial")).otherwise(F.col("role")).alias("role"), "text", "edit")
    new = opened.union(both.filter("after <> ''").select("conv_id", "pos", F.lit(2).alias("at"), F.col("after").alias("new")))
    new = new.select("conv_id", "pos", "at", F.posexplode(F.split("new", "")).alias("i", "x")).filter("x <> ''")
    return stay.union(new.select("conv_id", "pos", F.col("at") + F.col("i"), _named("x"), F.lit(""), F.lit("I")))


def _digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha256) of the repaired turns (conv_id, pos, k, line), streamed in order; a hash is all that is held."""
    cell, h, kind = None, None, None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], names=["conv_id", "sha256"])

    for b in it:
        kind = b.schema.field(0).type
        for conv, line in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if h is not None and cell == conv:
                h.update(b"\n")
            else:
                if h is not None:
                    out.append((cell, h.hexdigest()))
                cell, h = conv, hashlib.sha256()
            h.update(line.encode())
        if len(out) > 4096:
            yield batch()
            out.clear()
    if h is not None:
        out.append((cell, h.hexdigest()))
        yield batch()


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of ``repaired`` turns.

    A SHA-256 can't be put together from parts, so one task streams a conversation's lines; it holds none of them."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = turns.select("conv_id", "pos", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "k").mapInArrow(_digest, f"conv_id {kind}, sha256 string")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between a conversation's least and largest; 0 where all are null."""
    each = turns.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1))
    return each.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))


def assess_and_repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A conversation table's report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and its repaired turns (see ``repaired``)."""
    turns = ordered(df, conv_id, turn, role, text)
    whole, found = scan(turns)
    report = whole.join(gaps(turns).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    report = report.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, repaired(turns, whole, found)


def damage(df: DataFrame) -> DataFrame:
    """The contract's damage of (conv_id, turn, role, text), nulls of role and text made one space: a fifth of turns is dropped, emptied, cut, repeated or given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = df.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), hurt.alias("hurt")).filter("hurt <> 0")
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))
    times_ = F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times_.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, the cheapest edits after the contract's damage and the hash of what they give."""
    src = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    report, turns = assess_and_repair(damage(src))
    every = src.select("conv_id").distinct()
    d = digests(turns).withColumnRenamed("conv_id", "d")
    same = lambda k: F.col("conv_id").eqNullSafe(F.col(k))
    both = every.join(report.withColumnRenamed("conv_id", "c"), same("c"), "left").join(d, same("d"), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an expression of characters up to U+00FF, bit by bit, in SQL."""
    bits = "list_reduce([xor(p, q) & 255] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, (c & 1) * 3988292384))"
    utf8 = "flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 | (ord(x) >> 6), 128 | (ord(x) & 63)] END))".format(text)
    return f"xor(list_reduce([4294967295] || {utf8}::BIGINT[], lambda p, q: xor(p >> 8, {bits})), 4294967295)"


def oracle_sql() -> str:
    """The same by a scan of states turn by turn; each carries cost, audit and repaired lines."""
    put = lambda v, cost, letter, *lines: f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'r': {v}.r || [{', '.join(lines)}]::VARCHAR[]}} END"
    u, a = "'user:'", "'assistant:'"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    delete = lambda v: put(v, DELETE, "D")
    stay = lambda v, initial, name: f"CASE WHEN f IN ({SOUND}, {CUT}) THEN CASE WHEN role[1] = '{initial}' THEN {put(v, f'(f = {CUT})::INT', 'K', 'line')} ELSE {put(v, f'{REROLE} + (f = {CUT})::INT', 'R', name + '|| text') if name else 'NULL'} END END"
    return f"""
    WITH RECURSIVE dealt AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations
    ), damaged AS (
      SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM dealt WHERE h <> 0
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
    ), judged AS (
      SELECT *, role || ':' || text AS line, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN {DUPLICATE} WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN {CUT} ELSE {SOUND} END AS f
      FROM numbered
    ), scan(conv_id, k, v0, v1, v2, v3) AS (
      SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]), {{'c': {INSERT}, 'a': 'I', 'r': [{u}]}}, {{'c': {2 * INSERT}, 'a': 'II', 'r': [{u}, {a}]}}
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, k, w0, w1, {least("w2", *(put(w, INSERT, "I", u) for w in ("w0", "w1", "w3")))}, {least("w3", put("w2", INSERT, "I", a), *(put(w, 2 * INSERT, "II", u, a) for w in ("w0", "w1")))}
      FROM (
        SELECT j.conv_id, j.k, {delete("v0")} AS w0, {least(delete("v1"), stay("v0", "s", ""))} AS w1, {least(delete("v2"), *(stay(v, "u", u) for v in ("v0", "v1", "v3")))} AS w2, {least(delete("v3"), stay("v2", "a", a))} AS w3
        FROM scan JOIN judged j ON scan.conv_id IS NOT DISTINCT FROM j.conv_id AND j.k = scan.k + 1
      )
    ), best AS (
      SELECT conv_id, arg_max({least("v0", "v3")}, k) AS b FROM scan GROUP BY conv_id
    ), faults AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((f = {BLANK})::INT) AS blank, sum((f = {DUPLICATE})::INT) AS duplicate,
             sum((f = {CUT})::INT) AS truncated, sum((k > 1 AND before || role[1] NOT IN ('su', 'ua', 'au'))::INT) AS illegal
      FROM judged GROUP BY conv_id
    )
    SELECT best.conv_id, {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, b.c::BIGINT AS cost, b.a AS audit,
           sha256(array_to_string(b.r, chr(10))) AS repaired_sha256
    FROM best LEFT JOIN faults ON best.conv_id IS NOT DISTINCT FROM faults.conv_id
    """
