"""Best-fit packing of documents into sequences by bin completion.

Only lengths matter for a packing, and there are at most ``capacity`` of them. So the solver works on how
many pieces there are of each length, a table bounded by the capacity whatever the corpus. It makes
patterns: the largest length left, completed by an undominated filling, used a number of times. A first packing
takes the best filling as often as the counts allow; a branch and bound then goes back on fillings and on how
often they are used, until the packing meets a lower bound or the search has made ``STEPS`` steps. Spark cuts the documents, counts lengths, ranks the pieces of each length and looks up the sequence
and place of each rank.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.llm.common import id_and_text, text_encoder
from logwarden.session import stage

log = logging.getLogger(__name__)

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces of one length that one window group ranks, about.
RANK_GROUP = 200_000
#: Steps after which the search for fewer sequences ends, with the best packing so far.
STEPS = 2_000_000
#: Undominated fillings of one length that the search compares, times its allowance.
FILLINGS = 64


@dataclass(frozen=True)
class Pattern:
    """Lengths of one sequence, largest first, and how many sequences are filled so."""

    lengths: tuple[int, ...]
    times: int


class Completion:
    """A first packing by bin completion on counts by length; no filling is revisited.

    Around the largest length left, the search enumerates fillings from large pieces to small ones, so a
    filling that another one dominates (same room, larger pieces) comes later and is not taken. The incumbent
    at the start is the best-fit filling. A filling that wastes nothing ends the search of one pattern; so does
    ``nodes``, which leaves the incumbent.
    """

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = 400):
        self.capacity, self.nodes = capacity, nodes
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} does not fit {capacity}")
            self.left[length] += n

    def patterns(self) -> list[Pattern]:
        found = []
        left = self.left
        while len(present := np.flatnonzero(left)):
            largest = int(present[-1])
            left[largest] -= 1
            filling = self._complete(self.capacity - largest)
            left[largest] += 1
            used = Counter([largest, *filling])
            times = min(int(left[length]) // n for length, n in used.items())
            for length, n in used.items():
                left[length] -= n * times
            found.append(Pattern((largest, *filling), times))
        return found

    def _best_fit(self, room: int) -> list[int]:
        chosen: list[int] = []
        while room and len(fits := np.flatnonzero(self.left[: room + 1])):
            length = int(fits[-1])
            n = min(int(self.left[length]) - chosen.count(length), room // length)
            if n <= 0:
                # All pieces of this length are in the filling: the next smaller one that fits.
                rest = [int(x) for x in fits[::-1] if chosen.count(int(x)) < self.left[x]]
                if not rest:
                    break
                length, n = rest[0], 1
            chosen += [length] * n
            room -= length * n
        return chosen

    def _pair(self, room: int, most: int, taken: Counter) -> tuple[int, ...] | None:
        """One or two pieces of at most ``most`` that fill the room exactly, the larger one largest."""
        free = lambda length: self.left[length] - taken[length]
        if room <= most and free(room) > 0:
            return (room,)
        a = np.arange(min(most, room - 1), (room - 1) // 2, -1)
        if not len(a):
            return None
        both = (self.left[a] > 0) & (self.left[room - a] > 0)
        for x in a[both].tolist():
            y = room - x
            if free(x) > (x == y) and free(y) > (x == y):
                return (x, y)
        return None

    def _complete(self, room: int) -> list[int]:
        if room == 0:
            return []
        best = self._best_fit(room)
        waste = room - sum(best)
        if waste == 0 and len(best) <= 2:
            return best
        budget = self.nodes
        exact = self._pair(room, room, Counter())
        if exact:
            return list(exact)
        # Room, largest piece to add, pieces so far, and whether larger pieces were tried before.
        stack: list[tuple[int, int, tuple[int, ...], bool]] = [(room, room, (), False)]
        while stack and budget and waste:
            space, most, chosen, again = stack.pop()
            taken = Counter(chosen)
            if not again:
                budget -= 1
                exact = self._pair(space, min(most, space), taken) if space else ()
                if exact is not None:
                    return [*chosen, *exact]
            fits = np.flatnonzero(self.left[: min(most, space) + 1])
            largest = next((int(x) for x in fits[::-1] if self.left[x] > taken[int(x)]), 0)
            if largest:
                stack.append((space, largest - 1, chosen, True))
                stack.append((space - largest, largest, (*chosen, largest), False))
            elif space < waste:
                best, waste = list(chosen), space
        return best


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: Martello and Toth's bound L2."""
    n = np.zeros(capacity + 1, np.int64)
    for length, times in counts.items():
        n[length] += times
    upto, room = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    best = 0
    for k in range(half + 1):
        # Pieces over half need a sequence each; those of at most capacity - k leave room for the ones from k to half.
        small = int(room[half] - (room[k - 1] if k else 0))
        paired = int(upto[capacity - k] - upto[half])
        free = paired * capacity - int(room[capacity - k] - room[half])
        best = max(best, int(upto[capacity] - upto[half]) + max(0, -(-(small - free) // capacity)))
    return best


class Search:
    """Branch and bound over undominated fillings of the largest length left and how often each is used.

    ``waste`` is the room lost so far. A packing with one sequence less than the best has a fixed waste in
    all, so a branch that wastes more is cut. Ways to go on are ordered by room left and by times (as often as
    counts allow, half of that, and so on to once); a way costs its places in these orders, and rounds of
    growing allowance try cheap deviations anywhere in a packing first. A packing at the lower bound ends the
    search, as does ``steps``.
    """

    def __init__(self, counts: dict[int, int], capacity: int, best: list[Pattern], steps: int = STEPS):
        self.capacity, self.best, self.steps = capacity, best, steps
        self.lengths = sorted((length for length, n in counts.items() if n), reverse=True)
        self.rising = [-length for length in self.lengths]
        self.left = [counts[length] for length in self.lengths]
        self.total = sum(length * n for length, n in counts.items())
        self.n = sum(p.times for p in best)
        self.least = lower_bound(counts, capacity)

    def patterns(self) -> list[Pattern]:
        allowed = 1
        while self.n > self.least and self.steps > 0 and self._round(allowed):
            allowed += 1
        return self.best

    def _slack(self) -> int:
        """Waste of a packing that is better by one sequence."""
        return (self.n - 1) * self.capacity - self.total

    def _round(self, allowed: int) -> bool:
        """Try all packings of this allowance; whether a larger one may give others."""
        path: list[tuple[int, int, Counter]] = []
        waste = used = 0
        self.cut = False
        frames = [(0, self._ways(0, self._slack(), allowed))]
        while frames and self.steps > 0 and self.n > self.least:
            spent, ways = frames[-1]
            way = next(ways, None)
            if way is None:
                frames.pop()
                if path:
                    times, room, uses = path.pop()
                    waste, used = waste - times * room, used - times
                    self._give(uses, times)
                continue
            self.steps -= 1
            cost, room, times, uses = way
            if waste + times * room > self._slack():
                continue
            self._give(uses, -times)
            waste, used = waste + times * room, used + times
            path.append((times, room, uses))
            largest = next((i for i in range(min(uses), len(self.left)) if self.left[i]), None)
            if largest is not None:
                frames.append((spent + cost, self._ways(largest, self._slack() - waste, allowed - spent - cost)))
                continue
            self.n = used
            self.best = [Pattern(tuple(self.lengths[i] for i in sorted(u.elements())), t) for t, _, u in path]
            frames.append((0, iter(())))
        for times, _, uses in path:
            self._give(uses, times)
        return self.cut

    def _give(self, uses: Counter, times: int) -> None:
        for i, n in uses.items():
            self.left[i] += n * times

    def _ways(self, largest: int, slack: int, allowed: int) -> Iterator[tuple[int, int, int, Counter]]:
        """Cost, room left, times and use of lengths, cheapest first."""
        found: list[tuple[int, int, Counter]] = []
        fillings = self._fillings(largest, slack)
        for filling, room in fillings:
            found.append((room, len(found), Counter(filling)))
            if len(found) >= FILLINGS * (allowed + 1):
                self.cut = True
                fillings.close()
        found.sort(key=lambda f: f[:2])
        self.cut = self.cut or len(found) > allowed + 1
        ways = []
        for rank, (room, _, uses) in enumerate(found[: allowed + 1]):
            times = min(self.left[i] // n for i, n in uses.items())
            times = min(times, slack // room) if room else times
            cost = rank
            while times and cost <= allowed:
                ways.append((cost, room, times, uses))
                times, cost = times // 2, cost + 1
            self.cut = self.cut or times > 0
        return iter(sorted(ways, key=lambda w: w[:2]))

    def _fillings(self, largest: int, slack: int) -> Iterator[tuple[list[int], int]]:
        """Undominated fillings that waste at most ``slack``, as places in ``lengths``, large pieces first."""
        lengths, left = self.lengths, self.left
        chosen, room, at = [largest], self.capacity - lengths[largest], largest
        left[largest] -= 1
        try:
            while True:
                at = max(at, bisect_left(self.rising, -room))
                while at < len(left) and not left[at]:
                    at += 1
                    self.steps -= 1
                self.steps -= 1
                if at < len(left):
                    chosen.append(at)
                    left[at] -= 1
                    room -= lengths[at]
                    continue
                if room <= slack and not self._dominated(chosen, room):
                    yield list(chosen), room
                if len(chosen) == 1 or self.steps < 0:
                    break
                at = chosen.pop()
                left[at] += 1
                room += lengths[at]
                at += 1
        finally:
            for i in chosen:
                left[i] += 1

    def _dominated(self, chosen: list[int], room: int) -> bool:
        """Whether a piece left over fits in the room, alone or in place of a smaller one."""
        lengths, left = self.lengths, self.left
        if any(left[i] for i in range(bisect_left(self.rising, -room), len(left))):
            return True
        for i in set(chosen[1:]):
            if any(left[j] for j in range(bisect_left(self.rising, -(lengths[i] + room)), i)):
                return True
        return False


def best_patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The packing with the fewest sequences among first packings of growing effort and the search from there."""
    least = lower_bound(counts, capacity)
    best: list[Pattern] = []
    for nodes in (50, 400, 2_000):
        found = Completion(counts, capacity, nodes).patterns()
        if not best or sum(p.times for p in found) < sum(p.times for p in best):
            best = found
        if sum(p.times for p in best) <= least:
            return best
    return Search(counts, capacity, best).patterns()


@dataclass(frozen=True)
class Slots:
    """Where the rank-th piece of a length goes: runs of ranks, sorted by length and rank."""

    keys: np.ndarray
    first: np.ndarray
    uses: np.ndarray
    at: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Slots:
        used: Counter = Counter()
        rows, offsets, sequence = [], [], 0
        for pattern in patterns:
            places: dict[int, list[int]] = {}
            place = 0
            for length in pattern.lengths:
                places.setdefault(length, []).append(place)
                place += length
            for length, own in places.items():
                rows.append(((length << 44) + used[length], sequence, len(own), len(offsets)))
                offsets += own
                used[length] += len(own) * pattern.times
            sequence += pattern.times
        columns = np.array(sorted(rows) or np.empty((0, 4)), np.int64).reshape(-1, 4).T
        return cls(*columns, np.array(offsets, np.int64))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each (length, rank)."""
        key = (length << 44) + rank
        run = np.searchsorted(self.keys, key, "right") - 1
        past = key - self.keys[run]
        return self.first[run] + past // self.uses[run], self.offsets[self.at[run] + past % self.uses[run]]


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each whole text and its end id; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(path), int(end_id).to_bytes(4, "little")
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs).mapInArrow(run, PIECES)


def ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """``rank``: number of each piece among those of its length, from 0.

    Pieces of a length are split by a hash, so a length that many pieces share is ranked in parts; the
    parts' sizes, a small table, give where each part begins.
    """
    parts = max(1, -(-n_pieces // RANK_GROUP))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("rank", F.row_number().over(own) - 1)
    return numbered.join(begins, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("begin")).drop("part", "begin")


def pack(spark: SparkSession, docs: DataFrame, path: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Only a document longer than
    a sequence is cut, into full pieces and a rest. Equal rows are pieces of their own. No documents give
    no rows.
    """
    pieces = stage(cut_documents(docs, path, end_id, capacity), "pieces")
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = best_patterns(counts, capacity)
    log.info("%d sequences, at least %d needed", sum(p.times for p in patterns), lower_bound(counts, capacity))
    slots = Slots.of(patterns)
    place = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("length", "rank"))
            sequence, offset = place.value.find(length, rank)
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(pieces, sum(counts.values())).mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")
