"""BPE coding, token files and packing against the library."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from logwarden.llm import bpe, packing, registry, token_blocks
from logwarden.llm.common import TextEncoder, table, vocabulary_path
from logwarden.session import scratch_folder

from .conftest import AWKWARD

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
MORE = ["\n\n\nA  B   \n c", "don't..  ''s", "x \n\nA", "a<|endoftext|>b", "  y ", "x \n\nA"]


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def library_ids(name, rows):
    library = Tokenizer.from_file(vocabulary_path(name))
    return [e.ids for e in library.encode_batch([text or "" for text in rows], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_encoders_equal_library(name):
    rows = [text or "" for _, text in AWKWARD] + MORE
    library = Tokenizer.from_file(vocabulary_path(name))
    own, cached = bpe.ForcedBoundaryCoder(vocabulary_path(name)), TextEncoder(vocabulary_path(name))
    for text, ids in zip(rows, library_ids(name, rows), strict=True):
        assert own.encode(text) == as_bytes(ids) == cached.encode(text)
        assert own.decode(as_bytes(ids)) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced():
    own = bpe.ForcedBoundaryCoder(vocabulary_path("word_bpe_49k.json"))
    pieces = own.cut("qzxqé".encode().decode("latin-1").translate(bpe.byte_letters()))
    assert len(pieces) > 1
    assert all(a[-1] + b[0] not in own.joined for a, b in zip(pieces, pieces[1:], strict=False))


def test_coding_query(spark, sf_dir, awkward):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    for got, rows in ((registry.bpe_coding(spark, sf_dir), docs), (bpe.coding_digests(awkward, vocabulary_path("word_bpe_49k.json")), AWKWARD)):
        expected = [
            (i, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
            for (i, _), ids in zip(rows, library_ids("word_bpe_49k.json", [t for _, t in rows]), strict=True)
        ]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_ids_and_texts(awkward):
    path = vocabulary_path("byte_bpe_50k.json")
    back = bpe.decode_ids(bpe.encode_texts(awkward, path), path)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in AWKWARD)
    assert bpe.coding_digests(awkward.limit(0), path).count() == 0


@pytest.mark.parametrize("values", [[], [5], [0] * 300, list(range(1000)), [7] * 127 + [1 << 31], [2**32 - 1, 0] * 100])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    out = io.BytesIO()
    writer = token_blocks.BlockWriter(out)
    for i, part in enumerate(np.array_split(ids, 3)):
        writer.add(i, part)
    assert writer.close() == len(out.getvalue())
    stored = token_blocks.BlockFile(out.getvalue())
    assert np.concatenate([x for _, x in stored.documents()]).tolist() == values
    for a in range(0, len(values), 97):
        assert stored.ids(a, len(values)).tolist() == values[a:]


def test_random_blocks():
    rng = np.random.default_rng(1)
    for _ in range(20):
        ids = (rng.pareto(0.5, rng.integers(1, 2000)) * 10).clip(0, 2**32 - 1).astype(np.uint32)
        data, sizes = token_blocks.pack_blocks(ids)
        got = token_blocks.unpack_blocks(data, np.cumsum(sizes) - sizes).ravel()[: len(ids)]
        assert (got == ids).all()


def test_token_files(spark, sf_dir, awkward):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    path = vocabulary_path("byte_bpe_50k.json")
    for got, rows in ((registry.token_output(spark, sf_dir), docs), (token_blocks.token_round_trip(spark, awkward, path, 2), AWKWARD)):
        got = sorted(map(tuple, got.collect()), key=lambda r: r[1])
        expected, place = [], 0
        by_id = sorted(zip([i for i, _ in rows], library_ids("byte_bpe_50k.json", [t for _, t in rows]), strict=True), key=lambda r: (r[0] is not None, r[0]))
        for i, ids in by_id:
            expected.append((i, len(ids) + 1, zlib.crc32(as_bytes([*ids, 2]))))
        assert [r[0] for r in got] == [e[0] for e in expected]
        assert Counter((r[0], *r[2:]) for r in got) == Counter(expected)
        for row in got:
            assert row[1] == place
            place += row[2]
    folder = scratch_folder(spark, "none")
    assert token_blocks.write_token_files(awkward.limit(0), path, 2, folder).count() == 0


def check_packing(rows, pieces, capacity):
    expected = []
    for (i, _), ids in zip(rows, library_ids("word_bpe_49k.json", [t for _, t in rows]), strict=True):
        ids = [*ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            expected.append((i, n, at, len(own), zlib.crc32(as_bytes(own))))
    assert Counter(tuple(r)[:5] for r in pieces) == Counter(expected)
    ends: Counter = Counter()
    for row in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == ends[row.sequence_id]
        ends[row.sequence_id] += row.length
    assert max(ends.values()) <= capacity
    return len(ends), -(-sum(ends.values()) // capacity)


def test_packing(spark, sf_dir, awkward):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    used, least = check_packing(docs, registry.best_fit(spark, sf_dir).collect(), 4096)
    assert used <= least + 1
    packed = packing.pack(spark, awkward, vocabulary_path("word_bpe_49k.json"), 1, 64)
    check_packing(AWKWARD, packed.collect(), 64)
    assert packing.pack(spark, awkward.limit(0), vocabulary_path("word_bpe_49k.json"), 1).count() == 0


def fewest(lengths, capacity):
    """Bins of an exhaustive search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_completion_is_near_the_fewest():
    rng = np.random.default_rng(2)
    over = 0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 31, 8).tolist(), reverse=True)
        patterns = packing.best_patterns(dict(Counter(lengths)), 30)
        assert Counter(x for p in patterns for x in p.lengths * p.times) == Counter(lengths)
        assert all(sum(p.lengths) <= 30 for p in patterns)
        over += sum(p.times for p in patterns) - fewest(lengths, 30)
    assert over <= 2
    with pytest.raises(ValueError, match="does not fit"):
        packing.Completion({31: 1}, 30)


def test_hot_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    pieces = spark.range(500).selectExpr("id % 400 AS doc_id", "0 AS piece", "0L AS start", "3L AS length", "7L AS ids_crc32")
    assert sorted(r["rank"] for r in packing.ranked(pieces, 500).collect()) == list(range(500))


def test_fillings_are_revisited():
    """Few lengths, many pieces: committing the first filling found gave 3,250 sequences here."""
    counts = {1912: 1000, 1774: 1000, 1638: 2000, 1502: 1000, 1366: 1000, 1092: 1000, 956: 1000}
    patterns = packing.best_patterns(counts, 4096)
    used = Counter()
    for p in patterns:
        assert sum(p.lengths) <= 4096 and p.times > 0
        for length in p.lengths:
            used[length] += p.times
    assert used == counts
    assert packing.lower_bound(counts, 4096) == 2900 <= sum(p.times for p in patterns) <= 3000


def test_search_finds_the_fewest(monkeypatch):
    monkeypatch.setattr(packing, "FILLINGS", 2)
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = sorted(rng.integers(5, 16, 9).tolist(), reverse=True)
        counts = dict(Counter(lengths))
        alone = [packing.Pattern((length,), 1) for length in lengths]
        search = packing.Search(counts, 30, alone)
        patterns = search.patterns()
        assert Counter(x for p in patterns for x in p.lengths * p.times) == Counter(lengths)
        assert search.left == [counts[length] for length in search.lengths]
        assert packing.lower_bound(counts, 30) <= sum(p.times for p in patterns) == fewest(lengths, 30)
