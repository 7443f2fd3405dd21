"""BPE encoding by forced boundaries, and decoding.

A byte pair that no vocabulary token holds can never be joined by a merge, so the text is cut there and
the fragments are encoded on their own. White space bytes are in no token of a word vocabulary, so every
white space is such a cut; inside words the pair table finds the others. Fragments repeat far more often
than texts and are kept by each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logwarden.llm.common import Cache, byte_letters, id_and_text, id_bytes, kept_coder

CODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def inner_model(model: dict):
    """The vocabulary's merges without its end-of-word mark, for fragments that do not end a word."""
    from tokenizers.models import BPE

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BPE(vocab=model["vocab"], merges=merges)


class ForcedBoundaryCoder:
    """Encodes as the tokenizers library does with a BPE vocabulary file, and decodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = model["vocab"]
        self.inner_model = inner_model(model)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tokens = [""] * (max([*self.ids.values(), *added.values()]) + 1)
        for token, i in [*self.ids.items(), *added.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.bytes_of = {letter: byte for byte, letter in letters.items()}
        self.inner, self.last = Cache(self._merge_inner), Cache(self._merge_last)
        self.words = Cache(lambda word: self._part(word.decode()))
        self.joined = self._joined_pairs()
        spaces = {letters[byte] for byte in b" \t\n\x0b\x0c\r"}
        #: No token holds white space beside another byte, and white space alone has no ids.
        self.spaces_cut = not any(spaces & set(pair) for pair in self.joined) and not self._segment(" \n")
        self.joins_with_spaces = spec.get("decoder") is None

    def _joined_pairs(self) -> set[str]:
        """Letter pairs that stand side by side in some token."""
        pairs: set[str] = set()
        for token in self.ids:
            if token not in self.added:
                body = token.removesuffix(self.suffix) if self.suffix else token
                pairs.update(map(str.__add__, body, body[1:]))
        return pairs

    def cut(self, letters: str) -> list[str]:
        """A pre-token in byte letters, cut at its certain boundaries."""
        joined = self.joined
        ends = [i for i, pair in enumerate(map(str.__add__, letters, letters[1:]), 1) if pair not in joined]
        if not ends:
            return [letters]
        ends.append(len(letters))
        return [letters[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_inner(self, letters: str) -> list[int]:
        """The library's merges of a fragment that does not end its word, so that it has no end-of-word mark."""
        return [token.id for token in self.inner_model.tokenize(letters)]

    def _merge_last(self, letters: str) -> list[int]:
        return [token.id for token in self.library.model.tokenize(letters)]

    def _segment(self, text: str) -> list[int]:
        """Ids of text without added tokens: normalised and pre-tokenised by the library, then cut."""
        library = self.library
        if library.normalizer is not None:
            text = library.normalizer.normalize_str(text)
        ids: list[int] = []
        for letters, _ in library.pre_tokenizer.pre_tokenize_str(text):
            pieces = self.cut(letters)
            for piece in pieces[:-1]:
                ids += self.inner[piece]
            ids += self.last[pieces[-1]]
        return ids

    def _part(self, text: str) -> bytes:
        if self.at_added is None or not any(token in text for token in self.added):
            return id_bytes(self._segment(text))
        ids: list[int] = []
        for part in self.at_added.split(text):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                ids += self._segment(part)
        return id_bytes(ids)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not self.spaces_cut:
            return self._part(text)
        return b"".join(map(self.words.__getitem__, text.encode().split()))

    def decode(self, ids: bytes) -> str:
        tokens = map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.joins_with_spaces:
            return " ".join(tokens)
        return self._bytes_decoded(tokens)

    def _bytes_decoded(self, tokens) -> str:
        added, parts = self.added, []
        for token in tokens:
            parts.append(token.encode() if token in added else bytes(map(self.bytes_of.__getitem__, token)))
        return b"".join(parts).decode(errors="replace")


def coder(path: str) -> ForcedBoundaryCoder:
    return kept_coder(ForcedBoundaryCoder, path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, null texts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        for batch in batches:
            rows = [np.frombuffer(encode(text), "<u4").astype("i4") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text``: what the ids of ``doc_id, ids`` decode to; null ids as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(path).decode
        for batch in batches:
            texts = [decode(np.asarray(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def coding_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each whole text in one pass: number of ids, and SHA-256 of ids and decoded text.

    A null text is empty: no ids, digests of nothing. Each input row gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(run, CODED)
