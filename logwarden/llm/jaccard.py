"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups that links make.

Multiple-global-order filtering. Two sets of Jaccard likeness t share a token among the first
n - ceil(t n) + 1 of each, whatever order all tokens have. Here every order begins with how many documents hold
a token, rare ones first, and ties are broken by another hash in each order. A pair is a candidate only if
its prefixes meet in every order. Tokens of one document alone fill most prefixes and meet nothing.

Documents of equal sets are one class. Classes whose prefixes meet, directly or through others, are a family.
A family is compared in tiles of two blocks of classes: first every block with the first one, which joins
nearly all of a group of near copies; then, in families of several blocks, the classes that are not in the
family's largest group among themselves and with that group. Pairs already joined are not verified again.
Nothing is capped: every pair of different groups of a family meets in some tile.

Shingles are 64-bit hashes of words. A document without words has no shingles, links with nothing and is a
group of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import id_and_text, text_or_empty
from logwarden.llm.corpus import components, rows_of, squeeze, token_chunks, unsqueeze
from logwarden.session import passing_tables, stage

#: Shingles that one task counts, about.
COUNTED = 2_000_000
#: Bytes of text of a chunk; a task holds several arrays of eight bytes a word of it.
CHUNK_BYTES = 8 << 20
#: Bytes of sets that a task hands over at a time.
HANDED = 2 << 20
#: Classes of a block.
BLOCK = 256
#: Upper bits of a shingle by which document counts are kept. Equal ones only make a token look more common.
COUNT_BITS = 48
#: Documents that go, of which a broadcast holds at most so many (16 bytes each, about 64 MB as a hash table).
BROADCAST_ROWS = 1_000_000
#: Stands for a null document id.
NO_ID = -(1 << 63)
#: Tie breakers of the orders.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bits of 64-bit numbers mixed, differently by seed (the finish of splitmix64, fixed constants)."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle) of a chunk, sorted; a document of fewer words is one shingle."""
    factor = np.uint64(SEEDS[0] | 1)
    per_word = hashes[tokens]
    ends = np.cumsum(lengths)
    count = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(lengths.dtype))
    doc = np.repeat(np.arange(len(lengths)), count)
    first = (ends - lengths)[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    width = np.minimum(lengths, size)[doc]
    value = width.astype(np.uint64)
    for i in range(size):
        inside = width > i
        at = np.where(inside, first + i, first)
        value = np.where(inside, value * factor + per_word[at], value)
    value = mixed(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _sets_of(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in row["words"]], np.uint64)
    lengths = unsqueeze(row["lengths"]).astype(np.int64)
    if not len(hashes):
        return lengths, np.empty(0, np.int64), np.empty(0, np.uint64)
    return (lengths, *shingle_sets(unsqueeze(row["tokens"]), lengths, hashes, size))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values >> np.uint64(64 - COUNT_BITS), return_counts=True)


def _document_counts(chunks: DataFrame, size: int, shards: int) -> DataFrame:
    """``chunk, shard, classes``: for a chunk's distinct shingles of a shard, in order, how common each is."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, values = _sets_of(row, size)
            keys, n = _counted(values)
            bounds = np.searchsorted(keys, [(s << COUNT_BITS) // shards for s in range(shards + 1)])
            for shard, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if b > a:
                    steps = np.diff(keys[a:b], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_pylist(
                        [{"shard": shard, "chunk": row["chunk"], "steps": squeeze(steps), "n": squeeze(n[a:b].astype(np.uint32))}]
                    )

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.cumsum(unsqueeze(r["steps"]), dtype=np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unsqueeze(r["n"]) for r in rows]), len(distinct))
        common = np.frexp(total)[1].astype(np.uint8)[place]
        ends = np.cumsum([len(k) for k in keys])
        return pa.Table.from_pylist([
            {"chunk": r["chunk"], "shard": r["shard"], "classes": squeeze(common[e - len(k) : e])}
            for r, k, e in zip(rows, keys, ends, strict=True)
        ])

    parts = chunks.select("chunk", "lengths", "tokens", "words").mapInArrow(spread, "shard bigint, chunk bigint, steps binary, n binary")
    return parts.groupBy("shard").applyInArrow(count, "chunk bigint, shard bigint, classes binary")


MEMBERS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                     ("tokens", pa.binary()), ("prefixes", pa.list_(pa.binary()))])
MEMBERS_DDL = "row bigint, doc_id bigint, mark bigint, n bigint, digest binary, tokens binary, prefixes array<binary>"


def _members(chunks: DataFrame, counts: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document; with its set and prefixes if its prefixes hold a shared token in each order.

    Of equal sets in a chunk only the first carries them.
    """
    gathered = counts.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "classes"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_rows = TaskContext.get().partitionId() << 40, 0
        for row in rows_of(batches):
            lengths, doc, value = _sets_of(row, size)
            sizes = np.bincount(doc, minlength=len(lengths))
            ends = np.cumsum(sizes)
            keys, _ = _counted(value)
            common = np.concatenate([unsqueeze(p["classes"]) for p in row["parts"] or []] or [np.empty(0, np.uint8)])
            own = common[np.searchsorted(keys, value >> np.uint64(64 - COUNT_BITS))] if len(value) else common
            reach = sizes - (percent * sizes + 99) // 100 + 1
            rank = np.arange(len(doc)) - np.repeat(ends - sizes, sizes)
            prefixes = []
            for seed in SEEDS:
                order = np.lexsort((mixed(value, seed), own, doc))
                head = order[rank < reach[doc]]
                head = head[own[head] > 1]
                prefixes.append((doc[head], value[head]))
            held = np.logical_and.reduce([np.bincount(d, minlength=len(lengths)) > 0 for d, _ in prefixes])
            cuts = [np.searchsorted(d, np.arange(len(lengths) + 1)) for d, _ in prefixes]
            out, seen, size_out = [], set(), 0
            for i, (doc_id, mark) in enumerate(zip(row["doc_ids"], row["marks"], strict=True)):
                tokens = value[ends[i] - sizes[i] : ends[i]]
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                carries = bool(held[i]) and digest not in seen
                seen.add(digest)
                out.append({
                    "row": base + n_rows + i, "doc_id": doc_id, "mark": mark, "n": int(sizes[i]), "digest": digest,
                    "tokens": tokens.tobytes() if carries else None,
                    "prefixes": [v[c[i] : c[i + 1]].tobytes() for (_, v), c in zip(prefixes, cuts, strict=True)] if carries else None,
                })
                size_out += tokens.nbytes if carries else 0
                if size_out >= HANDED:
                    yield pa.RecordBatch.from_pylist(out, schema=MEMBERS)
                    out, size_out = [], 0
            n_rows += len(lengths)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=MEMBERS)

    rows = chunks.join(gathered, "chunk", "left").select("doc_ids", "marks", "lengths", "tokens", "words", "parts")
    return rows.mapInArrow(run, MEMBERS_DDL)


def linked_in_tile(rows: list[dict], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that join the groups of a tile; with ``across`` only pairs of different sides count.

    Candidates are the earlier classes met in every order's index. Groups already joined are skipped.
    """
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    known: dict[int, int] = {}
    for i, row in enumerate(rows):
        if row["label"] is not None:
            parent[root(i)] = root(known.setdefault(row["label"], i))
    sets: list[set | None] = [None] * len(rows)

    def own(i: int) -> set:
        if sets[i] is None:
            sets[i] = set(np.frombuffer(rows[i]["tokens"], np.uint64).tolist())
        return sets[i]

    index: list[dict[int, list[int]]] = [{} for _ in SEEDS]
    links = []
    for i, row in enumerate(rows):
        met: set[int] | None = None
        for order, prefix in zip(index, row["prefixes"], strict=True):
            tokens = np.frombuffer(prefix, np.uint64).tolist()
            found = set().union(*(order[t] for t in tokens if t in order))
            met = found if met is None else met & found
            for t in tokens:
                order.setdefault(t, []).append(i)
        n = row["n"]
        for j in sorted(met or ()):
            other = rows[j]
            if across and other["side"] == row["side"] or root(i) == root(j):
                continue
            m = other["n"]
            if 100 * min(n, m) < percent * max(n, m):
                continue
            shared = len(own(i) & own(j))
            if 100 * shared >= percent * (n + m - shared):
                links.append((row["class"], other["class"]))
                parent[root(i)] = root(j)
    return links


def _compare(tiles: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of rows ``family, i, j, side, ...``, a tile being one (family, i, j)."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["class", "n", "tokens", "prefixes", "label", "side"]).to_pylist()
        rows.sort(key=lambda r: (r["side"], r["class"]))
        across = len({r["side"] for r in rows}) > 1
        links = linked_in_tile(rows, percent, across)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return tiles.groupBy("family", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _tiles(blocked: DataFrame, low: str, high: str) -> DataFrame:
    """Each class once for every tile of its block: (i, j), i the smaller one; ``low`` and ``high`` bound the other block."""
    other = F.explode(F.expr(f"sequence({low}, {high})")).alias("other")
    return blocked.select("*", other).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.col("block").alias("side"), "class", "n", "tokens", "prefixes", "label",
    )


def _classes(members: DataFrame) -> DataFrame:
    """``class, digest, row, prefix``: different sets that may have a partner, numbered; the row that carries the set."""
    held = members.where("tokens is not null").select("digest", F.struct("row", F.col("prefixes")[0].alias("prefix")).alias("first"))
    slim = held.groupBy("digest").agg(F.min("first").alias("first")).select("digest", "first.row", "first.prefix")
    return stage(slim.withColumn("class", F.monotonically_increasing_id()), "classes")


def _prefix_rows(classes: DataFrame) -> DataFrame:
    """``token, class``: the first order's prefix tokens of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
            tokens = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            classes = np.repeat(batch.column(0).to_numpy(), [len(f) for f in firsts])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(classes, pa.int64())], ["token", "class"])

    return classes.select("class", "prefix").mapInArrow(run, "token bigint, class bigint")


def _links(spark: SparkSession, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links that connect every group of classes."""
    met = _prefix_rows(classes)
    pivots = met.groupBy("token").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    star = met.join(pivots, "token").where("class != pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    families = components(spark, star).select(F.col("node").alias("class"), F.col("label").alias("family"))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    sized = families.join(sizes, "family").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = sized.join(classes.select("class", "row"), "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = stage(placed.drop("size"), "families")
    # Only classes that have met another one need their sets.
    sets = stage(placed.select("class", "row").join(members.select("row", "n", "tokens", "prefixes"), "row").drop("row"), "sets")
    # Block 0 meets every block, the others meet block 0.
    rows = placed.withColumn("label", F.lit(None).cast("bigint")).join(sets, "class")
    first = stage(_compare(_tiles(rows, "0", "if(block = 0, blocks - 1, 0)"), percent), "links")

    large = placed.where("blocks > 1").select("class", "family")
    if large.isEmpty():
        return first
    labels = components(spark, first).withColumnRenamed("node", "class")
    named = large.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    heavy = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("own")).groupBy("family").agg(
        F.max_by("label", F.struct("own", "label")).alias("heavy"), F.sum("own").alias("all"), F.max("own").alias("most")
    )
    split = named.join(heavy, "family")
    strays = F.greatest(F.ceil((F.col("all") - F.col("most")) / BLOCK), F.lit(1)).cast("int")
    bulk = F.ceil(F.col("most") / BLOCK).cast("int")
    is_stray = F.col("label") != F.col("heavy")
    blocked = (
        split.where(F.col("all") > F.col("most")).withColumn("strays", strays).withColumn("bulk", bulk)
        .withColumn("block", F.when(is_stray, F.pmod(F.xxhash64("class"), F.col("strays"))).otherwise(
            F.col("strays") + F.pmod(F.xxhash64("class"), F.col("bulk"))).cast("int"))
        .select("class", "family", "label", "block", "strays", "bulk")
    )
    # Strays meet all blocks, the largest group's blocks meet only strays.
    rest = _compare(_tiles(blocked.join(sets, "class"), "0", "if(block < strays, strays + bulk - 1, strays - 1)"), percent)
    return first.union(stage(rest, "links"))


def jaccard_groups(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, group_key``: a row per input row.

    ``mark`` is ``xxhash64`` of the text, to tell rows of equal ids apart. Documents link when their shingle
    sets have at least ``percent`` hundredths in common of what they hold together. ``component_id`` is the
    least ``doc_id`` reachable; null ids give way to any other. ``group_key`` names the group, null for a
    document without words. No documents give no rows.
    """
    rows = id_and_text(docs).withColumn("mark", F.xxhash64("text"))
    chunks = token_chunks(rows, CHUNK_BYTES)
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    counts = _document_counts(chunks, size, max(1, -(-n_words // COUNTED)))
    members = stage(_members(chunks, counts, size, percent), "members")
    classes = _classes(members)
    links = _links(spark, members, classes, percent)
    labels = components(spark, links).withColumnRenamed("node", "class").join(classes.select("class", "digest"), "class")
    # A group without links is named by its digest, one with links by the digest of its first class.
    names = labels.where("class = label").select("label", F.col("digest").alias("name"))
    named = labels.join(names, "label").select("digest", "name")
    slim = members.select("doc_id", "mark", F.col("n").alias("n_shingles"), "digest")
    grouped = slim.join(named, "digest", "left").withColumn(
        "group_key", F.when(F.col("n_shingles") > 0, F.coalesce("name", "digest"))
    )
    least = grouped.where("group_key is not null").groupBy("group_key").agg(F.min("doc_id").alias("least"))
    return grouped.join(least, "group_key", "left").select(
        "doc_id", "mark", "n_shingles", F.when(F.col("group_key").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "group_key"
    )


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group: that of the least ``doc_id`` (null last).

    Documents without words all stay. Of repeated rows one stays.
    """
    with passing_tables(spark):
        groups = stage(jaccard_groups(spark, docs, size, percent), "groups", keep=True).where("group_key is not null")
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("gone_id"), F.col("mark").alias("gone_mark")]
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "mark")
    kept = groups.groupBy("group_key").agg(F.min(first).alias("kept"))
    told = groups.join(kept, "group_key")
    gone = stage(told.where(first != F.col("kept")).select(*key).distinct(), "gone")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text_or_empty(F.col("text")))]
    same = lambda other: (own[0] == other["gone_id"]) & (own[1] == other["gone_mark"])
    # Two numbers a row: up to so many are sent to every task, so that no text is shuffled; more are not.
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same(gone), "left_anti")
    again = told.where(first == F.col("kept")).select(*key).groupBy("gone_id", "gone_mark").count().where("count > 1").drop("count")
    if again.isEmpty():
        return left
    # Rows that were given more than once: one of each.
    once = left.join(again, same(again), "left_semi").withColumn("gone_id", own[0]).withColumn("gone_mark", own[1])
    return left.join(again, same(again), "left_anti").unionByName(once.dropDuplicates(["gone_id", "gone_mark"]).drop("gone_id", "gone_mark"))
