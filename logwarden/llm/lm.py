"""LM scoring with a bigram model in Elias-Fano tries.

The model: p(w) = (c(w) + 1) / (N + V + 1) and p(w | v) = (c(v w) + m p(w)) / (c(v) + m), a Dirichlet prior of
weight m around p(w). A pair that training has not seen costs the back-off weight m / (c(v) + m) times p(w).
Every context's probabilities, with one word that training does not know, sum to 1.

A model of a corpus is as large as the corpus, so it is never gathered. Documents are split into words once
and kept as chunks. One shuffle by word gives each chunk the corpus counts of its dictionary. Pairs go to the shard of their
context; a frequent context is split by the following word over as many shards as its count asks for, which
changes nothing, as c(v) is known from the word counts. A shard counts its training pairs, builds a trie and
answers all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.llm.common import id_and_text
from logwarden.llm.corpus import squeeze, token_chunks, unsqueeze
from logwarden.llm.trie import Trie
from logwarden.session import stage

#: Pairs of a shard, about; a context with more in training is split.
SHARD_PAIRS = 1_000_000
#: Weight of the prior, in words.
PRIOR = 500.0
#: Stands for the end of a document among the words; white space is in no word.
END = b"\n"
#: The context of a first word.
BEGIN = -1
#: Marks the ids of words that only one chunk has; chunk and dictionary place follow.
OWN_WORD = 1 << 62
#: Bits of a place in a dictionary; chunks are numbered without gaps, so 2^30 of them fit above.
PLACE_BITS = 32
#: Words and documents of a chunk that one sortable number holds beside a context; beyond, columns are sorted.
PACKED_WORDS, PACKED_DOCS = 1 << 23, 1 << 18

PARTIAL = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("stats", pa.bool_())])
PARTIAL_DDL = "chunk bigint, docs binary, sums binary, stats boolean"
PAIRS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("context", pa.binary()), ("word", pa.binary()), ("doc", pa.binary()),
                   ("times", pa.binary()), ("contexts", pa.binary()), ("words", pa.binary()), ("trains", pa.binary())])
PAIRS_DDL = "shard bigint, chunk bigint, context binary, word binary, doc binary, times binary, contexts binary, words binary, trains binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _with_ends(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Lengths, tokens with an end after each document, and the dictionary with the end as its last entry."""
    lengths = unsqueeze(row["lengths"]).astype(np.int64)
    tokens = unsqueeze(row["tokens"])
    end = len(row["words"]) if row.get("words") is not None else int(row["n_dictionary"]) - 1
    return lengths + 1, np.insert(tokens, np.cumsum(lengths), end), end


def _word_counts(chunks: DataFrame) -> DataFrame:
    """``chunk, place, word, n``: each dictionary entry of a chunk and how often training documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, tokens, end = _with_ends(row)
                trains = np.array(row["marks"]) == 0
                n = np.bincount(tokens[np.repeat(trains, lengths)], minlength=end + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(end + 1, row["chunk"])), pa.array(np.arange(end + 1, dtype=np.int32)),
                     pa.array([*row["words"], END], pa.binary()), pa.array(n)],
                    ["chunk", "place", "word", "n"],
                )

    return chunks.select("chunk", "marks", "lengths", "tokens", "words").mapInArrow(run, "chunk bigint, place int, word binary, n bigint")


def _spread(total: int, distinct: int, n_docs: int, shards: int, limit: int):
    """For a chunk and its words' counts: sums that need no pairs, and the pairs of each shard."""

    def run(key, chunk: pa.Table, words: pa.Table) -> pa.Table:
        if not len(chunk):
            return PAIRS.empty_table()
        row = chunk.to_pylist()[0]
        size = int(row["n_dictionary"])
        row["words"] = None
        lengths, tokens, _ = _with_ends(row)
        n_docs_here = len(lengths)
        # What other chunks do not have is counted here, and needs no name that others know.
        trains_here = np.repeat(np.array(row["marks"]) == 0, lengths)
        counts = np.bincount(tokens[trains_here], minlength=size)
        ids = OWN_WORD | row["chunk"] << PLACE_BITS | np.arange(size)
        place = words["place"].to_numpy()
        ids[place], counts[place] = words["id"].to_numpy(), words["n"].to_numpy()
        doc = np.repeat(np.arange(n_docs_here, dtype=np.uint32), lengths)
        per_word = np.log10((counts + 1) / (total + distinct + 1))
        base = np.bincount(doc, per_word[tokens], n_docs_here)
        known = np.bincount(doc, counts[tokens] > 0, n_docs_here)
        out = [{"shard": -1 - row["chunk"] % shards, "chunk": row["chunk"], "doc": squeeze(lengths), "times": squeeze(known), "context": squeeze(base)}]

        # Local number 0 is the context of first words, n + 1 the n-th dictionary entry.
        context = np.zeros(len(tokens), np.uint64)
        context[1:] = tokens[:-1] + 1
        context[np.cumsum(lengths) - lengths] = 0
        context, word, doc, times = _distinct(context, tokens, doc, size < PACKED_WORDS and n_docs_here <= PACKED_DOCS)
        del tokens, trains_here
        context_ids = np.concatenate([[BEGIN], ids])
        context_counts = np.concatenate([[n_docs], counts])
        parts = np.maximum(1, -(-context_counts // limit)).astype(np.uint32)
        shard = (_hashed(context_ids)[context] + _hashed(ids)[word] % parts[context]) * np.uint32(0x9E3779B1)
        shard = ((shard ^ (shard >> np.uint32(15))) % np.uint32(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)
        order = np.argsort(shard, kind="stable")
        shard, context, word, doc, times = (column[order] for column in (shard, context, word, doc, times))
        del order
        bounds = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        trains = np.array(row["marks"])[doc] == 0
        for a, b in zip(bounds, bounds[1:], strict=False):
            own_contexts, c = np.unique(context[a:b], return_inverse=True)
            own_words, w = np.unique(word[a:b], return_inverse=True)
            out.append({
                "shard": int(shard[a]), "chunk": row["chunk"],
                "context": squeeze(np.diff(c, prepend=0).astype(np.uint32)), "word": squeeze(w.astype(np.uint32)),
                "doc": squeeze(doc[a:b]), "times": squeeze(times[a:b]),
                "contexts": squeeze(np.concatenate([context_ids[own_contexts], context_counts[own_contexts]])),
                "words": squeeze(np.concatenate([ids[own_words], counts[own_words]])), "trains": np.packbits(trains[a:b]).tobytes(),
            })
        pa.default_memory_pool().release_unused()
        return pa.Table.from_pylist(out, schema=PAIRS)

    return run


def _distinct(context: np.ndarray, word: np.ndarray, doc: np.ndarray, packed: bool):
    """Distinct (context, word, document), sorted, and how often each comes; ``packed``: they fit one number."""
    if packed:
        # A chunk's arrays are the most that a task holds: they are combined in place.
        key = context << np.uint64(23)
        key |= word.astype(np.uint64)
        key <<= np.uint64(18)
        key |= doc.astype(np.uint64)
        key.sort()
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = np.flatnonzero(new)
        times = np.diff(at, append=len(key)).astype(np.uint32)
        key = key[at]
        del at, new
        context, word = (key >> np.uint64(41)).astype(np.uint32), (key >> np.uint64(18)).astype(np.uint32) & np.uint32(0x7FFFFF)
        return context, word, key.astype(np.uint32) & np.uint32(0x3FFFF), times
    order = np.lexsort((doc, word, context))
    columns = [c.astype(np.int64)[order] for c in (context, word, doc)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    context, word, doc = (c[at] for c in columns)
    return context, word, doc.astype(np.uint32), np.diff(np.append(at, len(order))).astype(np.uint32)


def _hashed(ids: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of each number."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def score_pairs(rows: list[dict], total: int, distinct: int, prior: float) -> list[dict]:
    """Train a shard's trie on its training pairs, and the sum of log probabilities per document."""
    contexts, words, docs, times, trains, of_row = [], [], [], [], [], []
    context_tables, word_tables = [], []
    for k, row in enumerate(rows):
        table_c = unsqueeze(row["contexts"]).reshape(2, -1)
        table_w = unsqueeze(row["words"]).reshape(2, -1)
        doc = unsqueeze(row["doc"])
        context_tables.append(table_c)
        word_tables.append(table_w)
        contexts.append(np.cumsum(unsqueeze(row["context"])))
        words.append(unsqueeze(row["word"]))
        docs.append(doc)
        times.append(unsqueeze(row["times"]))
        trains.append(np.unpackbits(np.frombuffer(row["trains"], np.uint8), count=len(doc)) > 0)
        of_row.append(np.full(len(doc), k, np.int32))
    table_c, table_w = np.concatenate(context_tables, axis=1), np.concatenate(word_tables, axis=1)
    context_ids, first = np.unique(table_c[0], return_index=True)
    context_n = table_c[1][first]
    word_ids, first = np.unique(table_w[0], return_index=True)
    log_word = np.log10((table_w[1][first] + 1) / (total + distinct + 1))
    # From places in a payload's lists to places among all ids of the shard.
    pair = np.concatenate([
        np.searchsorted(context_ids, c[0]).astype(np.uint64)[i] << np.uint64(32) | np.searchsorted(word_ids, w[0]).astype(np.uint64)[j]
        for c, w, i, j in zip(context_tables, word_tables, contexts, words, strict=True)
    ])
    times, train = np.concatenate(times), np.concatenate(trains)
    del contexts, words, context_tables, word_tables, trains
    pairs, place = np.unique(pair, return_inverse=True)
    del pair
    seen = np.bincount(place, times * train, len(pairs))
    learned = pairs[seen > 0]
    own = (learned >> np.uint64(32)).astype(np.int64)
    follows = (learned & np.uint64(0xFFFFFFFF)).astype(np.int64)
    log_p = np.log10((seen[seen > 0] + prior * 10.0 ** log_word[follows]) / (context_n[own] + prior))
    present, starts = np.unique(own, return_index=True)
    trie = Trie(present, np.append(starts, len(own)), follows, log_p, np.log10(prior / (context_n[present] + prior)))
    try:
        asked = (pairs >> np.uint64(32)).astype(np.int64)
        heard = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        answer = np.empty(len(pairs))
        for a in range(0, len(pairs), 1 << 18):
            cut = slice(a, a + (1 << 18))
            found, value, _ = trie.find(asked[cut], heard[cut])
            # A context that is in the trie of another shard only still costs its back-off weight.
            backoff = np.log10(prior / (context_n[asked[cut]] + prior))
            answer[cut] = np.where(found, value, backoff + log_word[heard[cut]])
    finally:
        trie.close()

    key = np.concatenate(of_row).astype(np.int64) << 32
    key |= np.concatenate(docs)
    del docs, of_row, pairs, asked, heard
    keys, at = np.unique(key, return_inverse=True)
    del key
    sums = np.bincount(at, answer[place] * times, len(keys))
    bounds = np.searchsorted(keys >> 32, np.arange(len(rows) + 1))
    return [
        {"chunk": row["chunk"], "docs": squeeze((keys[a:b] & 0xFFFFFFFF).astype(np.uint32)), "sums": squeeze(sums[a:b]), "stats": False}
        for row, a, b in zip(rows, bounds, bounds[1:], strict=False)
    ]


def score_corpus(spark: SparkSession, docs: DataFrame, held_out: Column, prior: float = PRIOR) -> DataFrame:
    """Score every whole text with a model of the rows that are not ``held_out``; a row per input row.

    ``held_out`` is a condition on ``doc_id``; where it is null the row trains. A null text is empty and has
    its end as its only token. Equal rows are documents of their own. No documents give no rows.
    """
    rows = id_and_text(docs).withColumn("mark", F.coalesce(held_out, F.lit(False)).cast("long"))
    chunks = token_chunks(rows)
    # One shuffle by word: its count everywhere, in how many chunks it is, and its first place as its name.
    word = Window.partitionBy("word")
    place = F.shiftleft("chunk", PLACE_BITS) + F.col("place")
    named = _word_counts(chunks).select(
        "chunk", "place", F.sum("n").over(word).alias("n"), (F.count(F.lit(1)).over(word) > 1).alias("shared"),
        F.min(place).over(word).alias("id"), (F.min(place).over(word) == place).alias("first"), (F.col("word") == F.lit(END)).alias("ends"),
    )
    named = stage(named.withColumn("id", F.when(F.col("shared"), F.col("id"))), "vocabulary")
    firsts = named.where("first").agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long")), F.sum(F.when(F.col("ends"), F.col("n")))).first()
    total, distinct, n_docs = (int(x or 0) for x in firsts)
    shards = max(1, -(-int(chunks.agg(F.sum("n_words")).first()[0] or 0) // SHARD_PAIRS))

    resolved = named.where("shared").select("chunk", "place", "id", "n")
    split = chunks.select("chunk", "marks", "lengths", "tokens", (F.size("words") + 1).alias("n_dictionary"))
    pairs = split.groupBy("chunk").cogroup(resolved.groupBy("chunk")).applyInArrow(
        _spread(total, distinct, n_docs, shards, SHARD_PAIRS), PAIRS_DDL
    )

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if rows[0]["shard"] < 0:
            out = [
                {"chunk": r["chunk"], "docs": r["doc"], "sums": r["context"], "stats": True} for r in rows
            ] + [{"chunk": r["chunk"], "docs": r["times"], "sums": None, "stats": True} for r in rows]
            return pa.Table.from_pylist(out, schema=PARTIAL)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_pylist(score_pairs(rows, total, distinct, prior), schema=PARTIAL)

    partial = pairs.groupBy("shard").applyInArrow(answer, PARTIAL_DDL)

    def gather(key, chunk: pa.Table, parts: pa.Table) -> pa.Table:
        if not len(chunk):
            return pa.table({name.split()[0]: pa.array([], kind) for name, kind in zip(SCORED.split(", "), kinds, strict=True)})
        row = chunk.to_pylist()[0]
        doc_ids = row["doc_ids"]
        score = np.zeros(len(doc_ids))
        n_tokens = n_known = base = None
        for part in parts.to_pylist():
            if not part["stats"]:
                score[unsqueeze(part["docs"])] += unsqueeze(part["sums"])
            elif part["sums"] is not None:
                n_tokens, base = unsqueeze(part["docs"]), unsqueeze(part["sums"])
            else:
                n_known = unsqueeze(part["docs"])
        columns = [doc_ids, [m != 0 for m in row["marks"]], n_tokens, n_known.astype(np.int64), np.full(len(doc_ids), total), base, score]
        return pa.table({name.split()[0]: pa.array(c, kind) for name, c, kind in zip(SCORED.split(", "), columns, kinds, strict=True)})

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return chunks.select("chunk", "doc_ids", "marks").groupBy("chunk").cogroup(partial.groupBy("chunk")).applyInArrow(gather, SCORED)
