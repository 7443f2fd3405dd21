"""Conversation repair by a grammar-compressed min-plus dynamic program.

A conversation becomes a sequence of symbols, the role and the first fault of each row. Edits must turn the
roles into ``(s?(ua)+)?``; its automaton has four states, and the cheapest edits of a symbol from state to state are a
4 x 4 transfer matrix of costs and audits (the edits' initials). Matrices multiply by minimum and sum: of
equal costs the audit that is least in ASCII wins. An audit never is the beginning of another of the same
cost (both consume the same rows, and what is longer has more insertions), so the order survives appending and the
product is associative.

Re-Pair replaces the most frequent pair of neighbouring symbols of all sequences at hand by a new one, again and
again. Each rule gets one matrix, made bottom-up from its two parts, whose audits are ropes that share the parts'
ropes. Equal sequences, equal stretches and equal rules are computed once for all conversations.

Rows are sorted by conversation and turn in ranges, so a conversation that holds a third of all rows is cut over many
tasks; each piece gives its matrix and one fold of these matrices gives the whole. Rows that are equal in all columns are counted
before. Only the last step, which writes one SHA-256 over a conversation's repaired text, reads it in one task: as a
stream, holding the audit but no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logwarden.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. Accepted at the end: 0 and 3.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: Pairs of neighbouring role initials that are in order.
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}

#: Symbols: rows that may stay, by initial (x: none of s, u, a); truncated ones; rows that must go.
WHOLE, CUT, MUST = "suax", "SUAX", "d"
SYMBOLS = WHOLE + CUT + MUST

#: Symbols of a piece at most, and of the sequences that one grammar covers, about.
PIECE, GRAMMAR = 1 << 16, 1 << 18

_WHITE = " \t\n\x0b\x0c\r"
#: Modulus of the ropes' digests, an odd number of 61 bits.
_MODULUS = 0x1D3B5F7A9C2E4681


class Rope:
    """An audit: a text, or two ropes in a row. Digests tell equal ropes without reading them."""

    __slots__ = ("digest", "left", "right", "shift", "size", "text")

    def __init__(self, text: bytes = b"", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size = len(text)
            self.digest, self.shift = int.from_bytes(text) % _MODULUS, pow(256, len(text), _MODULUS)
        else:
            self.size = left.size + right.size
            self.digest = (left.digest * right.shift + right.digest) % _MODULUS
            self.shift = left.shift * right.shift % _MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        return Rope(left=self, right=other) if self.size else other

    def __bytes__(self) -> bytes:
        parts, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.left is None:
                parts.append(rope.text)
            else:
                todo += (rope.right, rope.left)
        return b"".join(parts)

    def __lt__(self, other: Rope) -> bool:
        """By bytes; equal parts are passed over by their digests."""
        ours, theirs = [self], [other]
        while ours and theirs:
            a, b = ours.pop(), theirs.pop()
            if a is b or (a.size == b.size and a.digest == b.digest):
                continue
            if a.left is not None and (a.size >= b.size or b.left is None):
                ours += (a.right, a.left)
                theirs.append(b)
            elif b.left is not None:
                theirs += (b.right, b.left)
                ours.append(a)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.size > n:
                    ours.append(Rope(a.text[n:]))
                if b.size > n:
                    theirs.append(Rope(b.text[n:]))
        return bool(theirs)


EMPTY = Rope()
Cell = tuple[int, Rope] | None
Matrix = tuple[tuple[Cell, ...], ...]


def cheaper(a: Cell, b: Cell) -> Cell:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def times_row(row: tuple[Cell, ...], matrix: Matrix) -> tuple[Cell, ...]:
    out: list[Cell] = [None] * len(STATES)
    for k, first in enumerate(row):
        if first is not None:
            for j, second in enumerate(matrix[k]):
                if second is not None and (out[j] is None or first[0] + second[0] <= out[j][0]):
                    out[j] = cheaper((first[0] + second[0], first[1] + second[1]), out[j])
    return tuple(out)


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(times_row(row, b) for row in a)


IDENTITY: Matrix = tuple(tuple((0, EMPTY) if i == j else None for j in STATES) for i in STATES)


def insertions() -> Matrix:
    """The fewest insertions of user and assistant rows from state to state."""
    cells: list[list[Cell]] = [list(row) for row in IDENTITY]
    for i in STATES:
        state, n = i, 0
        while (state := NEXT[state, "a" if state == 2 else "u"]) != i and cells[i][state] is None:
            n += 1
            cells[i][state] = (INSERT * n, Rope(b"I" * n))
    return tuple(map(tuple, cells))


def row_edits(symbol: str) -> Matrix:
    """Keep, rerole or delete one row."""
    cells: list[list[Cell]] = [[None] * len(STATES) for _ in STATES]
    stays = TRUNCATED if symbol in CUT else 0
    initial = symbol.lower()
    for i in STATES:
        cells[i][i] = (DELETE, Rope(b"D"))
        if symbol == MUST:
            continue
        for role in ROLES:
            if (i, role) in NEXT:
                j = NEXT[i, role]
                cells[i][j] = cheaper((REROLE + stays, Rope(b"R")), cells[i][j])
        if (i, initial) in NEXT:
            j = NEXT[i, initial]
            cells[i][j] = cheaper((KEEP + stays, Rope(b"K")), cells[i][j])
    return tuple(map(tuple, cells))


INSERTIONS = insertions()
#: Insertions before a row belong to its matrix; those after the last one are a matrix of their own.
TERMINALS = [times(INSERTIONS, row_edits(symbol)) for symbol in SYMBOLS]


def re_pair(sequences: list[bytes]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules and compressed sequences. Symbol ``len(SYMBOLS) + i`` stands for the pair ``rules[i]``.

    The most frequent pair of all sequences goes first, ties to the least pair, until none comes twice.
    """
    symbols: list[int] = []
    for sequence in sequences:
        symbols.extend(sequence)
        symbols.append(-1)  # no pair reaches over the end of a sequence
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
    for p in range(n - 1):
        if symbols[p] >= 0 and symbols[p + 1] >= 0:
            places[symbols[p], symbols[p + 1]].append(p)
    count = defaultdict(int, {pair: len(own) for pair, own in places.items()})
    heap = [(-c, pair) for pair, c in count.items() if c > 1]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        c, pair = heappop(heap)
        if -c != count[pair]:
            if count[pair] > 1:
                heappush(heap, (-count[pair], pair))
            continue
        new, touched = len(SYMBOLS) + len(rules), set()
        rules.append(pair)
        for p in sorted(set(places.pop(pair))):
            q = after[p]
            if q >= n or (symbols[p], symbols[q]) != pair:
                continue
            left, right = before[p], after[q]
            symbols[p], symbols[q], after[p] = new, -2, right
            if right < n:
                before[right] = p
            if left >= 0 and symbols[left] >= 0:
                count[symbols[left], pair[0]] -= 1
                places[symbols[left], new].append(left)
                count[symbols[left], new] += 1
                touched.add((symbols[left], new))
            if right < n and symbols[right] >= 0:
                count[pair[1], symbols[right]] -= 1
                places[new, symbols[right]].append(p)
                count[new, symbols[right]] += 1
                touched.add((new, symbols[right]))
        count[pair] = 0
        for other in touched:
            if count[other] > 1:
                heappush(heap, (-count[other], other))
    out: list[list[int]] = [[]]
    for symbol in symbols:
        if symbol == -1:
            out.append([])
        elif symbol >= 0:
            out[-1].append(symbol)
    return rules, out[:-1]


def sequence_matrices(sequences: list[bytes]) -> list[Matrix]:
    """The transfer matrix of each sequence (of places in ``SYMBOLS``), by the rules of one grammar."""
    rules, compressed = re_pair(sequences)
    matrices = list(TERMINALS)
    for left, right in rules:
        matrices.append(times(matrices[left], matrices[right]))
    out = []
    for symbols in compressed:
        whole = IDENTITY
        for symbol in symbols:
            whole = times(whole, matrices[symbol])
        out.append(whole)
    return out


def cheapest(row: tuple[Cell, ...]) -> tuple[int, bytes]:
    """Cost and audit of the best accepted end, given the cells reached from the first state."""
    ended = times_row(row, INSERTIONS)
    best = None
    for state in ENDS:
        best = cheaper(best, ended[state])
    return best[0], bytes(best[1])


# --- rows to symbols ---------------------------------------------------------------------------
def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, initial, blank, cut, n, first`` for each group of equal rows.

    ``n`` rows are equal; ``first``: no row before, in the order of turn and digest, has this role and text.
    """
    role, text = F.col("role"), F.col("text")
    shown = F.rtrim(text, F.lit(_WHITE))
    narrow = rows.select(
        "conv_id", "turn", row_digest(role, text).alias("digest"), initial_of(role).alias("initial"),
        (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"), "copies",
    )
    groups = narrow.groupBy("conv_id", "turn", "digest", "initial", "blank", "cut").agg(F.sum("copies").alias("n"))
    counted = stage(groups, "conversation-rows")
    # The first turn of each text, found by partial sums; the join back is on the whole key, which no text or
    # conversation makes hot.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (
        counted.where("n > 0 and not blank").groupBy("conv_id", "digest").agg(F.min(place).alias("place"))
        .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("place.turn").alias("_turn"), F.lit(True).alias("first"))
    )
    same = counted["conv_id"].eqNullSafe(firsts["_conv"]) & (counted["digest"] == firsts["_digest"]) & counted["turn"].eqNullSafe(firsts["_turn"])
    joined = counted.join(firsts, same, "left")
    return joined.select(*counted.columns, F.coalesce("first", F.lit(False)).alias("first"))


def row_digest(role: Column, text: Column) -> Column:
    """Tells rows of different role or text apart; rows of one turn are taken in its order."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def initial_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def fault_counts(faced: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated``."""
    stays = F.col("first") & ~F.col("blank")
    by_turn = faced.groupBy("conv_id", "turn").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"),
        F.sum((stays & F.col("cut")).cast("bigint")).alias("truncated"),
    )
    turn = F.when(F.col("n") > 0, F.col("turn"))
    return by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")],
    )


PIECE_DDL = "part int, open boolean, illegal bigint, begin string, end string, costs array<bigint>, audits array<string>, cost bigint, audit string"


class _Conversation:
    """What a task knows of one conversation: its symbols not yet in a matrix, and the matrix before them."""

    def __init__(self, conv_id):
        self.conv_id, self.buffer, self.matrix = conv_id, bytearray(), IDENTITY
        self.illegal, self.begin, self.end = 0, "", ""

    def add(self, initial: str, symbol: int, n: int) -> None:
        if self.end:
            self.illegal += self.end + initial not in LEGAL
        else:
            self.begin = initial
        self.illegal += n - 1
        self.end = initial
        self.buffer.append(symbol)


def _pieces(faced: DataFrame) -> DataFrame:
    """Each conversation's part of a task: its best edits, or its matrix if it may go on in another task."""
    must = SYMBOLS.index(MUST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        #: Conversations with symbols that no grammar has seen; and how many symbols these are.
        waiting: list[tuple[_Conversation, bytes]] = []
        held = 0
        known: dict[int, tuple[int, bytes]] = {}

        def solve() -> None:
            nonlocal waiting, held
            distinct = list(dict.fromkeys(symbols for _, symbols in waiting))
            matrix_of = dict(zip(distinct, sequence_matrices(distinct), strict=True))
            for conversation, symbols in waiting:
                own = matrix_of[symbols]
                conversation.matrix = own if conversation.matrix is IDENTITY else times(conversation.matrix, own)
            waiting, held = [], 0

        def flush(conversation: _Conversation) -> None:
            nonlocal held
            if conversation.buffer:
                waiting.append((conversation, bytes(conversation.buffer)))
                held += len(conversation.buffer)
                conversation.buffer = bytearray()

        def row_of(conversation: _Conversation, is_open: bool) -> dict:
            row = {"conv_id": conversation.conv_id, "part": part, "open": is_open, "illegal": conversation.illegal,
                   "begin": conversation.begin, "end": conversation.end}
            if is_open:
                cells = [cell for line in conversation.matrix for cell in line]
                return row | {
                    "costs": [None if c is None else c[0] for c in cells],
                    "audits": [None if c is None else bytes(c[1]).decode() for c in cells], "cost": None, "audit": None,
                }
            # Conversations of equal sequences share their matrix.
            first = conversation.matrix[0]
            if id(first) not in known:
                known[id(first)] = cheapest(first)
            cost, audit = known[id(first)]
            return row | {"costs": None, "audits": None, "cost": cost, "audit": audit.decode()}

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        done: list[_Conversation] = []
        now: _Conversation | None = None
        first_id, is_first = None, True
        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field("conv_id"), *_PIECE_FIELDS])
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "initial", "symbol", "n")]
            for conv_id, initial, symbol, n in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        flush(now)
                        done.append(now)
                    now = _Conversation(conv_id)
                now.add(initial, symbol, n)
                rest = n - 1
                while rest:
                    # Copies of a row must go, whatever the row.
                    some = min(rest, PIECE)
                    now.buffer += bytes([must]) * some
                    rest -= some
                    if len(now.buffer) >= PIECE:
                        flush(now)
                    if held >= GRAMMAR:
                        solve()
                if len(now.buffer) >= PIECE:
                    flush(now)
                if held + len(now.buffer) >= GRAMMAR:
                    flush(now)
                    solve()
                    if done:
                        rows = [row_of(c, is_first and i == 0) for i, c in enumerate(done)]
                        done, is_first = [], False
                        known.clear()
                        yield out(rows)
        if now is not None:
            flush(now)
            done.append(now)
            solve()
            # The first and the last conversation of a range may be cut.
            yield out([row_of(c, (is_first and i == 0) or c is now) for i, c in enumerate(done)])

    stays = F.col("first") & ~F.col("blank")
    letter = F.when(~stays, MUST).when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    symbol = (F.instr(F.lit(SYMBOLS), letter) - 1).cast("int")
    there = faced.where("n > 0").select("conv_id", "turn", "digest", "initial", symbol.alias("symbol"), "n")
    order = ["conv_id", "turn", "digest"]
    return there.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv_id {_id_type(faced)}, {PIECE_DDL}")


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def best_edits(faced: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of each conversation that has rows."""
    pieces = stage(_pieces(faced), "conversation-pieces")
    columns = ["conv_id", "illegal", "cost", "audit"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def out(conv_id, illegal: int, row: tuple[Cell, ...]) -> pa.RecordBatch:
            cost, audit = cheapest(row)
            return pa.RecordBatch.from_pylist(
                [{"conv_id": conv_id, "illegal": illegal, "cost": cost, "audit": audit.decode()}], schema=schema
            )

        started, now, row, illegal, end = False, None, IDENTITY[0], 0, ""
        for batch in batches:
            schema = schema or pa.schema(
                [batch.schema.field("conv_id"), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
            )
            for i in range(batch.num_rows):
                piece = batch.slice(i, 1).to_pylist()[0]
                if not started or piece["conv_id"] != now:
                    if started:
                        yield out(now, illegal, row)
                    started, now, row, illegal, end = True, piece["conv_id"], IDENTITY[0], 0, ""
                cells = [
                    None if cost is None else (cost, Rope(audit.encode()))
                    for cost, audit in zip(piece["costs"], piece["audits"], strict=True)
                ]
                matrix = tuple(tuple(cells[len(STATES) * i : len(STATES) * (i + 1)]) for i in STATES)
                illegal += piece["illegal"] + (bool(end) and end + piece["begin"] not in LEGAL)
                row, end = times_row(row, matrix), piece["end"]
        if started:
            yield out(now, illegal, row)

    cut = pieces.where("open").select("conv_id", "part", "illegal", "begin", "end", "costs", "audits")
    folded = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        fold, f"conv_id {_id_type(faced)}, illegal bigint, cost bigint, audit string"
    )
    return pieces.where("not open").select(*columns).unionByName(folded)


# --- edits applied -----------------------------------------------------------------------------
class _Edited:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        kept = len(audit) - audit.count("D")
        #: Roles go s?(ua)+, so the number of rows tells whether a system row leads.
        self.given = -(kept % 2)

    def _role(self) -> str:
        return ROLES["ua"[self.given % 2]]

    def insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._role(), "", "I"
            self.at += 1
            self.given += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield (role if edit == "K" else self._role()), text, edit
            self.given += 1


def _in_order(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Each conversation's summary row (``kind`` 0), then its rows, in one task's stream."""
    extra = [c for c in summary.columns if c != "conv_id"]
    kinds = {f.name: f.dataType for f in summary.schema}
    there = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", row_digest(F.col("role"), F.col("text")).alias("digest"),
        "role", "text", "copies", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra],
    )
    nothing = {"turn": "bigint", "digest": "string", "role": "string", "text": "string", "copies": "bigint"}
    heads = summary.select(
        "conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()], *extra
    )
    dealt = heads.unionByName(there).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "kind", "turn", "digest")


def _rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; a few rows of a batch at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def summaries(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``SUMMARY``: one row for each conversation, also for those all of whose rows have 0 copies."""
    faced = stage(with_faults(rows), "conversation-faults")
    found, edits = fault_counts(faced), best_edits(faced)
    joined = found.join(edits.withColumnRenamed("conv_id", "_conv"), found["conv_id"].eqNullSafe(F.col("_conv")), "left")
    return joined.select(
        *found.columns, F.coalesce("illegal", F.lit(0)).cast("bigint").alias("illegal"),
        F.coalesce("cost", F.lit(0)).cast("bigint").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
    )


def conversation_rows(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, copies``; a null role or text becomes one space. Other columns play no part.

    ``copies``: how often a row is there; 0 only names its conversation.
    """
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"),
    )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, tuple[str, str, str] | None]]:
    """``(summary, row)`` for each repaired row of a conversation, then ``(summary, None)``."""
    head = edited = None
    for row in _rows_in(batches):
        if row["kind"] == 0:
            if head is not None:
                yield from ((head, out) for out in edited.insertions())
                yield head, None
            head, edited = row, _Edited(row["audit"])
        else:
            for _ in range(row["copies"]):
                yield from ((head, out) for out in edited.row(row["role"], row["text"]))
    if head is not None:
        yield from ((head, out) for out in edited.insertions())
        yield head, None


def _batched(rows: Iterator[dict], kinds: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kinds)


def repair_digests(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the SHA-256 of the repaired text of each conversation of ``conversation_rows``.

    Rows are taken by turn, nulls first; rows of one turn by a digest of role and text; equal rows are
    duplicates of the first. All rows with a null ``conv_id`` are one conversation. A conversation of
    which nothing is left has an empty text. No rows give no rows.
    """
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = to_arrow_schema(T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(f"{SUMMARY}, repaired_sha256 string").fields]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        digest, started = hashlib.sha256(), False
        for head, row in _repaired(batches):
            if row is not None:
                digest.update(b"\n" * started + f"{row[0]}:{row[1]}".encode())
                started = True
            else:
                yield {c: head[c] for c in ("conv_id", *names)} | {"repaired_sha256": digest.hexdigest()}
                digest, started = hashlib.sha256(), False

    return _in_order(rows, summaries(rows)).mapInArrow(
        lambda batches: _batched(digests(batches), kinds), f"conv_id {_id_type(rows)}, {SUMMARY}, repaired_sha256 string"
    )


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 0), ``role, text, edit`` (K, R or I)."""
    ddl = "place bigint, role string, text string, edit string"
    kinds = to_arrow_schema(T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(ddl).fields]))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place = 0
        for head, row in _repaired(batches):
            if row is None:
                place = 0
            else:
                yield {"conv_id": head["conv_id"], "place": place, "role": row[0], "text": row[1], "edit": row[2]}
                place += 1

    return _in_order(rows, summaries(rows)).mapInArrow(
        lambda batches: _batched(turns(batches), kinds, 1_000), f"conv_id {_id_type(rows)}, {ddl}"
    )


# --- damage, for the registered query -------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """``conversation_rows`` of a table, each row damaged by the CRC-32 of its ``conv_id:turn`` modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversation_rows(conversations).withColumn("kind", F.crc32(key) % 20)
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumns({"text": text, "role": role, "copies": copies}).drop("kind")


_PIECE_FIELDS = [
    ("part", pa.int32()), ("open", pa.bool_()), ("illegal", pa.int64()), ("begin", pa.string()), ("end", pa.string()),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string()),
]
