"""Conversation structure repair by a run-length dynamic program.

A row is a symbol: its role (system, user, assistant, other) and what its fault allows. Over the four states that a repaired conversation
can be in (nothing yet, after the system row, after a user, after an assistant), a symbol is a 4 x 4 matrix of least costs, and
rows in a row multiply in min-plus algebra. Equal consecutive symbols collapse into a run, which advances the costs by the cached binary
powers of its symbol's matrix. From the costs still to come at every row, choices are then unrolled from the front.

Conversations are of any length: rows are put in order over ranges, and the rows of one conversation in one range are a chunk. Every
chunk gives one matrix; a scan of the chunks of a conversation (as many as there are ranges at most) tells the costs to come at the end
of each; every chunk then unrolls from each state that it may begin in, and a second scan tells in which it does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_BITS, cut, in_order, small_batches

#: Costs of edits, and of a truncated row that stays.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INF = 1 << 60
#: States: nothing yet, after s, after u, after a. Where a state may end, what a user and an assistant lead to, and what is inserted.
ENDS = (True, False, False, True)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
DUE = ("u", "u", "a", "u")
SPACE = r"\x20\x09-\x0D"
#: Rows that a task hands on at once.
ROWS = 4096

State = tuple[int, int, int, int]


def _after(q: int) -> int:
    return NEXT[DUE[q]][q]


def inserted(costs: State) -> State:
    """Costs to come, where rows may be inserted first: two are enough to reach any state."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[_after(q)]) for q, c in enumerate(out)]
    return tuple(out)


#: Costs to come behind the last row.
END: State = inserted(tuple(0 if e else INF for e in ENDS))


@cache
def edits(symbol: str) -> tuple[tuple[str, int, tuple[int | None, ...]], ...]:
    """What may be done with a row, in order of the letters: the letter, its cost, and the state that each state leads to."""
    role, fault = symbol
    stays = TRUNCATED if fault == "t" else 0
    out = [("D", DELETE, (0, 1, 2, 3))]
    if fault not in "bd":
        if role in NEXT:
            out.append(("K", stays, tuple(NEXT[role].get(q) for q in range(4))))
        out.append(("R", RE_ROLE + stays, tuple(_after(q) for q in range(4))))
    return tuple(out)


def step(symbol: str, costs: State) -> State:
    """Costs to come before a row, from those behind it."""
    return inserted(tuple(min(w + costs[to[q]] for _, w, to in edits(symbol) if to[q] is not None) for q in range(4)))


Matrix = tuple[State, ...]
UNIT: Matrix = tuple(tuple(0 if q == p else INF for p in range(4)) for q in range(4))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, *(a[q][k] + b[k][p] for k in range(4))) for p in range(4)) for q in range(4))


@cache
def power(symbol: str, k: int) -> Matrix:
    """The matrix of ``2 ** k`` rows of a symbol: costs from each state to each state."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    columns = [step(symbol, tuple(0 if q == p else INF for q in range(4))) for p in range(4)]
    return tuple(tuple(min(INF, columns[p][q]) for p in range(4)) for q in range(4))


def run_matrix(symbol: str, rows: int, matrix: Matrix) -> Matrix:
    """``matrix``, behind which a run of a symbol is put."""
    for k in range(rows.bit_length()):
        if rows >> k & 1:
            matrix = product(matrix, power(symbol, k))
    return matrix


def applied(matrix: Matrix, costs: State) -> State:
    return tuple(min(INF, *(matrix[q][p] + costs[p] for p in range(4))) for q in range(4))


def collapsed(symbols: Iterator[str]) -> list[tuple[str, int]]:
    """Runs of equal symbols."""
    out: list[list] = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [tuple(r) for r in out]


def costs_at(runs: list[tuple[str, int]], costs: State) -> list[State]:
    """Costs to come before every row, and behind the last: at the ends of runs by powers, in between by steps back from there."""
    ends = [costs]
    for symbol, rows in reversed(runs):
        ends.append(applied(run_matrix(symbol, rows, UNIT), ends[-1]))
    ends.reverse()
    out: list[State] = []
    for (symbol, rows), behind in zip(runs, ends[1:], strict=True):
        back = [behind]
        for _ in range(rows):
            back.append(step(symbol, back[-1]))
        out.extend(reversed(back[1:]))
    return [*out, costs]


def unrolled(symbols: list[str], at: list[State], q: int, last: bool) -> tuple[list[str], int]:
    """A string of edits for every row: what is inserted before it, and its own; and the state behind. The least letter that keeps the
    least cost is taken each time. A last entry, where the conversation ends here, has what is inserted behind."""
    out: list[str] = []
    for symbol, here, behind in zip(symbols, at[:-1], at[1:], strict=True):
        told = ""
        while True:
            own = {letter: (w, to[q]) for letter, w, to in edits(symbol) if to[q] is not None}
            fits = [letter for letter, (w, to) in own.items() if w + behind[to] == here[q]]
            if INSERT + here[_after(q)] == here[q]:
                fits.append("I")
            letter = min(fits)
            told += letter
            if letter == "I":
                q = _after(q)
                continue
            q = own[letter][1]
            break
        out.append(told)
    if last:
        told = ""
        while not (ENDS[q] and at[-1][q] == 0):
            told, q = told + "I", _after(q)
        out.append(told)
    return out, q


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of ``chunk`` and others, a list for each chunk. A chunk's rows lie side by side, and in one range."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _told(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), ROWS):
        part = rows[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


_SCANNED = pa.schema([("chunk", pa.int64()), ("matrix", pa.list_(pa.int64())), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())])
_UNROLLED = pa.schema([("chunk", pa.int64()), ("at", pa.int64()), ("begun", pa.int32()), ("told", pa.string()), ("becomes", pa.string()), ("ended", pa.int32())])
LEGAL = frozenset(("su", "ua", "au"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        matrix = UNIT
        for symbol, n in collapsed(r[2] for r in rows):
            matrix = run_matrix(symbol, n, matrix)
        roles = [r[2][0] for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
        yield from _told([(rows[0][0], [c for r in matrix for c in r], illegal, roles[0], roles[-1])], _SCANNED)


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        chunk, behind, begins, last = rows[0][0], tuple(rows[0][3]), rows[0][4], rows[0][5]
        symbols = [r[2] for r in rows]
        at = costs_at(collapsed(iter(symbols)), behind)
        for begun in (0,) if begins else range(4):
            if at[0][begun] >= INF:
                continue
            told, q = unrolled(symbols, at, begun, last)
            if last:  # what is inserted behind stands with the last row
                told[-2:] = [told[-2] + told[-1]]
            here, out = begun, []
            for r, letters in zip(rows, told, strict=True):
                becomes, here = _walked(here, letters, r[2][0])
                out.append((chunk, r[1], begun, letters, becomes, q))
            yield from _told(out, _UNROLLED)


def _walked(q: int, letters: str, role: str) -> tuple[str, int]:
    """The role initials that edits lead to, ``-`` for a deleted row, and the state behind them."""
    out = ""
    for x in letters:
        initial = "-" if x == "D" else role if x == "K" else DUE[q]
        out, q = out + initial, q if x == "D" else NEXT[initial][q]
    return out, q


def _scanned_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks in falling order: the costs to come behind each."""
    schema = pa.schema([("chunk", pa.int64()), ("behind", pa.list_(pa.int64())), ("begins", pa.bool_()), ("ends", pa.bool_())])
    costs = END
    for b in batches:
        out = []
        for chunk, matrix, begins, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if ends:
                costs = END
            out.append((chunk, list(costs), begins, ends))
            costs = applied(tuple(tuple(matrix[i : i + 4]) for i in range(0, 16, 4)), costs)
        yield from _told(out, schema)


def _scanned_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks in rising order, with the states that each of their states leads to: the state that each begins in."""
    schema = pa.schema([("chunk", pa.int64()), ("begun", pa.int32())])
    q = 0
    for b in batches:
        out = []
        for chunk, leads, begins in zip(*(c.to_pylist() for c in b.columns), strict=True):
            q = 0 if begins else q
            out.append((chunk, q))
            q = dict(leads)[q]
        yield from _told(out, schema)


def placed_rows(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``conv, turn, role, text, at`` in order of ``at``, and ``conv, at, chunk, symbol``: the ``at`` of the chunk's first row, and the row's
    role and fault.

    Order within a conversation is by turn, nulls first; rows of a turn follow by role and by the digest of their text. Null roles and
    texts count as one space. Faults: b(lank), d(uplicate), t(runcated) or k for none, the first that holds.
    """
    told = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    told = told.withColumn("_sha", F.sha2(F.col("text"), 256))
    placed = in_order(told, F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_sha").asc())
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    open_end = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    # the first row of each role and text, as a set of single rows: joined by place, so that no task meets all rows that repeat one text
    first = placed.where(~blank).groupBy("conv", "role", "_sha").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    part = F.shiftright("at", ROW_BITS).alias("_part")
    slim = placed.select("conv", "at", part, F.substring("role", 1, 1).alias("_initial"), blank.alias("_blank"), open_end.alias("_open"))
    slim = slim.join(first, "at", "left")
    fault = F.when(F.col("_blank"), "b").when(F.col("_first").isNull(), "d").when(F.col("_open"), "t").otherwise("k")
    initial = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("o")
    chunk = F.min("at").over(Window.partitionBy("conv", "_part"))
    marked = cut(slim.select("conv", "at", chunk.alias("chunk"), F.concat(initial, fault).alias("symbol")))
    return placed.drop("_sha"), marked


def choices(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of rows ``conv, at, chunk, symbol``: ``at, told, becomes`` for every row, and a row a chunk with what it counted.

    ``told`` are the letters of a row (insertions before it, its own, insertions behind the last) and ``becomes`` the initials of the
    roles that they lead to.
    """
    own = small_batches(marked).withColumn("_part", F.shiftright("at", ROW_BITS))
    dealt = own.repartition("_part").sortWithinPartitions("at")
    scanned = cut(dealt.select("chunk", "at", "symbol").mapInArrow(_scan, "chunk long, matrix array<long>, illegal long, first string, last string"))
    # the chunks of a conversation: no more than there are ranges
    of = marked.groupBy("chunk").agg(F.first("conv").alias("conv"))
    of = of.select("chunk", F.struct(F.col("conv").isNull(), "conv").alias("_key"))
    along = Window.partitionBy("_key").orderBy("chunk")
    chunks = scanned.join(of, "chunk").withColumn("_before", F.lag("last").over(along)).withColumn("begins", F.lag("chunk").over(along).isNull()).withColumn("ends", F.lead("chunk").over(along).isNull())
    chunks = cut(chunks)
    back = chunks.repartition("_key").sortWithinPartitions(F.col("_key").desc(), F.col("chunk").desc())
    behind = back.select("chunk", "matrix", "begins", "ends").mapInArrow(_scanned_back, "chunk long, behind array<long>, begins boolean, ends boolean")
    unrolled_rows = own.join(behind, "chunk").repartition("_part").sortWithinPartitions("at")
    unrolled_rows = cut(unrolled_rows.select("chunk", "at", "symbol", "behind", "begins", "ends").mapInArrow(_unroll, "chunk long, at long, begun int, told string, becomes string, ended int"))
    leads = unrolled_rows.groupBy("chunk", "begun").agg(F.max("ended").alias("ended")).groupBy("chunk").agg(F.map_from_entries(F.collect_set(F.struct("begun", "ended"))).alias("leads"))  # four entries
    on = chunks.join(leads, "chunk").repartition("_key").sortWithinPartitions("_key", "chunk")
    begun = on.select("chunk", "leads", "begins").mapInArrow(_scanned_on, "chunk long, begun int")
    return unrolled_rows.join(begun, ["chunk", "begun"]).select("at", "told", "becomes"), chunks


class Repair:
    """Rows ``conv_id, turn, role, text`` repaired: :meth:`rows` has the edits, :meth:`report` what was wrong.

    Roles count by their first letter. Of rows that repeat role and text of an earlier one all but the first are duplicates. Other columns,
    whatever their names, play no part; empty tables give empty results. Edge cases as in :func:`placed_rows`.
    """

    def __init__(self, rows: DataFrame, **columns: str) -> None:
        self.placed, self.marked = placed_rows(rows, **columns)
        self.choices, self.chunks = choices(self.marked)

    def rows(self) -> DataFrame:
        """``conv_id, at, step, edit, turn, role, text, cost``: every edit in order of ``at, step``, with the row that it leads to.

        Deleted rows are there with what they were; those with another ``edit`` than D are the repaired conversation.
        """
        told = self.placed.join(self.choices.join(self.marked.select("at", "symbol"), "at"), "at")
        told = told.select("*", F.posexplode(F.regexp_extract_all("told", F.lit("[DIKR]"), F.lit(0))).alias("step", "edit")).withColumn("_to", F.substring("becomes", F.col("step") + 1, F.lit(1)))
        role = F.when(F.col("edit").isin("K", "D"), F.col("role")).when(F.col("_to") == "u", "user").otherwise("assistant")
        text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
        stays = F.when(F.substring("symbol", 2, 1) == "t", TRUNCATED).otherwise(0)
        cost = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", RE_ROLE + stays).otherwise(stays)
        turn = F.when(F.col("edit") != "I", F.col("turn"))
        return told.select(F.col("conv").alias("conv_id"), "at", "step", "edit", turn.alias("turn"), role.alias("role"), text.alias("text"), cost.cast("long").alias("cost"))

    def report(self) -> DataFrame:
        """A row a conversation that has rows: ``conv_id, gaps, blank, duplicate, truncated, illegal``."""
        turns = self.placed.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
        fault = F.substring("symbol", 2, 1)
        faults = self.marked.groupBy("conv").agg(*[F.count_if(fault == k[0]).alias(k) for k in ("blank", "duplicate", "truncated")])
        across = F.when(~F.col("begins") & ~F.concat("_before", "first").isin(*LEGAL), 1).otherwise(0)
        illegal = self.chunks.groupBy(F.col("_key.conv").alias("conv")).agg(F.sum(F.col("illegal") + across).alias("illegal"))
        told = turns.unionByName(faults, allowMissingColumns=True).unionByName(illegal, allowMissingColumns=True)
        return told.groupBy(F.col("conv").alias("conv_id")).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")])


def digests(edited: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` of what :meth:`Repair.rows` gives: the letters put together, and the SHA-256 of the repaired
    ``role:text`` lines. A conversation's rows go through one task, as SHA-256 must read them in turn, but are never held together."""
    kind = edited.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, letters, sha, lines = False, None, [], hashlib.sha256(), 0
        for b in batches:
            ids = b.column(0)
            for i, (value, edit, line) in enumerate(zip(ids.to_pylist(), *(c.to_pylist() for c in b.columns[1:]), strict=True)):
                if not begun or value != conv:
                    if begun:
                        yield told(was, letters, sha)
                    begun, conv, letters, sha, lines, was = True, value, [], hashlib.sha256(), 0, ids.slice(i, 1)
                letters.append(edit)
                if edit != "D":
                    sha.update((b"\n" if lines else b"") + line.encode())
                    lines += 1
        if begun:
            yield told(was, letters, sha)

    def told(conv: pa.Array, letters: list[str], sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([conv, pa.array(["".join(letters)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    lines = small_batches(edited).select("conv_id", "at", "step", "edit", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at", "step")
    return lines.select("conv_id", "edit", "line").mapInArrow(run, f"conv_id {kind.simpleString()}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults, by crc32 of ``conv_id:turn`` mod 20: 0 drops a row, 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats the row, 4 makes its role user. Nulls count as one space, except in ``turn`` and ``conv_id`` as they are returned."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    told = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def repair_damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for every conversation of ``rows``, damaged and repaired: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. One that keeps no row has zeros, an empty audit and the digest of nothing. Edge cases as in :class:`Repair`."""
    repair = Repair(damaged(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col))
    edited = repair.rows()
    costs = edited.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    told = rows.select(F.col(conv_col).alias("conv_id")).distinct()
    for part in (repair.report(), costs, digests(edited)):
        told = told.unionByName(part, allowMissingColumns=True)
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.groupBy("conv_id").agg(*counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
