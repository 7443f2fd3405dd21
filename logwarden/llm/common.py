"""What the operators of this folder share: inputs, words, and coders kept by a Python worker."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string, null becomes empty); other columns cannot clash."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_or_empty(F.col(text_column)).alias("text")
    )


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: str) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


#: Bytes that one generation of a worker's cache holds, about, and what an entry costs beside its key and value.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 130

#: White space beyond ASCII, fixed by Unicode.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")

#: Pieces with one optional leading space. Runs of white space give their last character to what follows.
_SPACED = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


#: Without these a text's white space is single spaces and line ends.
_RUNS = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c")


#: Marks that no pattern of the vocabularies joins to a letter before them (an apostrophe would be).
_MARKS = b".,;:!?#$%&*"


class Cache(dict):
    """Values made on demand and kept for two generations, so that memory is bounded and what recurs stays.

    When a generation has its bytes it becomes the older one; an entry met again in the older one is
    carried over, the others go with it.
    """

    def __init__(self, make, room: int | None = None):
        super().__init__()
        self._make, self._older = make, {}
        self._room = self._left = CACHE_BYTES if room is None else room

    def __missing__(self, key):
        value = self._older.get(key)
        return self._kept(key, self._make(key) if value is None else value)

    def _kept(self, key, value):
        self._left -= len(key) + len(value) + ENTRY_BYTES
        if self._left < 0:
            self._older, self._left = dict(self), self._room
            self.clear()
        self[key] = value
        return value


class PieceCache(Cache):
    """Little-endian 32-bit ids by piece of text, for pieces without white space.

    ``make_marks`` gives those of the marks that follow a piece's last letter.
    """

    def __init__(self, make, make_marks, room: int | None = None):
        super().__init__(make, room)
        self._of_marks = Cache(make_marks)

    def __missing__(self, piece: bytes) -> bytes:
        ids = self._older.get(piece)
        if ids is None:
            word = piece.rstrip(_MARKS)
            if len(word) < len(piece) and word[-1:].isalpha():
                # A mark after a letter starts a pre-token of its own. Only words that have come before
                # are stored with their marks too, as most words come once.
                known = word in self
                ids = self[word] + self._of_marks[piece[len(word) :]]
                if not known:
                    return ids
            else:
                ids = self._make(piece)
        return self._kept(piece, ids)


#: Packs so many ids; longer pieces are rare.
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def id_bytes(ids: list[int]) -> bytes:
    return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies (a fixed format).

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on, in byte order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    shifted = {b: chr(0x100 + i) for i, b in enumerate(others)}
    return {b: chr(b) if b in printable else shifted[b] for b in range(256)}


class _Words:
    """Ids of single words straight from the vocabulary's merges, without normaliser and pre-tokeniser.

    Only for words of letters that the library itself takes one by one: ASCII letters, and those Latin ones
    of which it makes the same pre-token as this class does when asked at the start.
    """

    def __init__(self, library):
        self._tokenize = library.model.tokenize
        self._letters = {byte: letter for byte, letter in byte_letters().items()}
        self._lowers = library.normalizer is not None and library.normalizer.normalize_str("A") == "a"
        split = library.pre_tokenizer.pre_tokenize_str
        normal = library.normalizer.normalize_str if library.normalizer is not None else str

        def is_plain(letter: str) -> bool:
            word = f"a{letter}{letter}a"
            return [piece for piece, _ in split(normal(word))] == [self._pre_token(word)]

        letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
        self.plain = re.compile("[" + "".join(filter(is_plain, letters)) + "]+").fullmatch

    def _pre_token(self, word: str) -> str:
        word = word.lower() if self._lowers else word
        return word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)

    def ids(self, word: str, space: str = "") -> bytes:
        """Of a plain word; ``space`` is the letter of a space before it."""
        return id_bytes([token.id for token in self._tokenize(space + self._pre_token(word))])


class TextEncoder:
    """``encode(text)`` gives the library's ids of a whole text, as bytes.

    Texts are cut where both vocabularies of this kind always start a new pre-token: for a vocabulary
    that drops white space at ASCII white space, for a byte-level one before a space or a last white space.
    Texts that name a special token, or with wide white space beside a byte-level vocabulary, go to the
    library whole. ``cache_bytes`` is a generation of each of its two caches, about.
    """

    def __init__(self, path: str, cache_bytes: int | None = None):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        self._whole = lambda text: library.encode(text, add_special_tokens=False).ids
        words, space = _Words(library), byte_letters()[32]

        def first(piece: bytes) -> bytes:
            text = piece.decode()
            return words.ids(text) if words.plain(text) else id_bytes(self._whole(text))

        def after_space(piece: bytes) -> bytes:
            text = piece.decode()
            return words.ids(text, space) if words.plain(text) else id_bytes(self._whole(" " + text))

        def alone(piece: bytes) -> bytes:
            return id_bytes(self._whole(piece.decode()))

        self._cache, self._after_space = (PieceCache(make, alone, cache_bytes) for make in (first, after_space))
        self._line_end = id_bytes(self._whole("\n"))
        self._special = [t.content for t in library.get_added_tokens_decoder().values()]
        # A vocabulary that keeps white space gives ids for a space alone.
        self._keeps_space = bool(self._whole(" "))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return id_bytes(self._whole(text))
        raw = text.encode()
        if not self._keeps_space:
            return b"".join(map(self._cache.__getitem__, raw.split()))
        if not text.isascii() and _WIDE_SPACE.search(text):
            return id_bytes(self._whole(text))
        if raw[:1].isspace() or raw[-1:].isspace() or any(run in raw for run in _RUNS):
            return b"".join(map(self._cache.__getitem__, _SPACED.findall(raw)))
        # Single spaces and line ends only: each starts a new pre-token, a line end being one itself.
        parts: list[bytes] = []
        for line in raw.split(b"\n"):
            head, *rest = line.split(b" ")
            parts += (self._line_end, self._cache[head])
            parts += map(self._after_space.__getitem__, rest)
        return b"".join(parts[1:])


#: The one coder that a Python worker keeps, by its class and settings.
_kept: dict[tuple, object] = {}


def kept_coder(kind, *settings):
    """A worker's coder of this kind, kept from task to task until another one is asked for."""
    if (kind, *settings) not in _kept:
        drop_coder()
        _kept[kind, *settings] = kind(*settings)
    return _kept[kind, *settings]


def drop_coder() -> None:
    """Free a worker's coder and its caches; called where tasks need the memory for something else."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def text_encoder(path: str, cache_bytes: int | None = None) -> TextEncoder:
    return kept_coder(TextEncoder, path, cache_bytes)


def vocabulary_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
