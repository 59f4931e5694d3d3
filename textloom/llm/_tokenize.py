"""Exact, cached encoding with the public tokenizer libraries.

Both vocabularies can be cut at spaces without changing the result, so a worker
encodes each distinct chunk once and joins the stored ids:

* The word BPE pre-tokenizes with a pattern none of whose alternatives matches
  white space, and no step looks across it; a chunk between spaces or line feeds
  is encoded alone exactly as in its text.
* The sentencepiece model has no piece with a space mark after another character,
  so no merge crosses the place before a run of spaces. `SentencePieceCounter`
  checks that of the model, and texts that hold the mark itself are encoded whole.

The cache only saves work: it is emptied when it reaches its bound.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np

from ._shared import WORKER_CACHES, release

CACHE_ENTRIES = 1_000_000
CHUNK_ENTRIES = 500_000
# A longer chunk is encoded without being kept; the word BPE keeps short chunks
# only, since long ones rarely come again and their pieces are kept.
CACHE_CHUNK = 64
CHUNK_CHARS = 24


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BYTE_CHARS = _byte_chars()

_ENCODERS: dict = {}
WORKER_CACHES["encoders"] = _ENCODERS


class WordBpe:
    """ids of the word BPE as little-endian unsigned 32-bit bytes.

    Chunks of printable ASCII and Latin-1 letters, which normalization only
    lower-cases, are cut further into the pre-tokenizer's pieces; each distinct
    piece goes to the library's model once. All other chunks (other scripts,
    control characters, special strings) go through the library whole.
    """

    _PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, entries: int = CHUNK_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        if hasattr(self.model, "_resize_cache"):  # the caches below are the ones in use
            self.model._resize_cache(0)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.entries = entries
        self.cuttable = self._pieces_agree()
        self.chunks = _Chunks(self)

    def _pieces_agree(self) -> bool:
        """Whether this file's tokenizer is the kind that the cuts are exact for."""
        sample = ["Don't", "it's", "A1b2!?", "x's't", "Éßÿ", "'salt", "a.b,c...d", "12%"]
        return all(self._cut(t) == ids for t, ids in zip(sample, self.whole(sample), strict=True)) and self.whole(["a b\nc"])[0] == b"".join(self.whole(["a", "b", "c"]))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(_BYTE_CHARS[b] for b in piece.encode())
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _cut(self, chunk: str) -> bytes:
        return b"".join(map(self._model, self._PIECES.findall(chunk.lower())))

    def encode(self, text: str) -> bytes:
        if not self.cuttable:
            return self.whole([text])[0]
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


class _Chunks(dict):
    """Ids by chunk between spaces, made of its pieces on the first use. A piece, as a chunk, is its own only piece, so both share the entries."""

    def __init__(self, owner: WordBpe):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        o = self.owner
        if not chunk:
            return b""
        if not o._PLAIN.fullmatch(chunk) or ("<" in chunk and any(s in chunk for s in o.special)):
            ids, most = o.whole([chunk])[0], CHUNK_CHARS
        else:
            pieces = o._PIECES.findall(chunk.lower())
            if len(pieces) == 1 and pieces[0] == chunk:
                ids, most = o._model(chunk), CACHE_CHUNK
            else:
                ids, most = b"".join(map(self.__getitem__, pieces)), CHUNK_CHARS
        if len(chunk) <= most:
            if len(self) >= o.entries:  # also within one long text
                self.clear()
            self[chunk] = ids
        return ids


class SentencePieceCounter:
    """Number of pieces of a text."""

    MARK = "▁"
    _RUNS = re.compile(r" *[^ ]+(?: +$)?")

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache: dict[str, int] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = self.sp.encode("a  b", out_type=str)
        self.begins = np.array([p.startswith(self.MARK) for p in pieces])
        self.cuttable = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and "".join(probe) == f"{self.MARK}a{self.MARK * 2}b"

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuttable or self.MARK in text:
            return self.whole([text])[0]
        if "  " in text or text[0] == " " or text[-1] == " ":
            # The model puts a space before each text; a chunk other than the first gives one of its own for it.
            runs = self._RUNS.findall(text)
            if not runs:
                return self.whole([text])[0]
            chunks = [runs[0], *(r[1:] for r in runs[1:])]
        else:
            chunks = text.split(" ")
        cache = self.cache
        got = list(map(cache.get, chunks))
        if None not in got:
            return sum(got)
        missing = list({c for c, n in zip(chunks, got, strict=True) if n is None})
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        if any(c == "" or " " in c for c in missing):
            counts = self.whole(missing)
        else:  # one call: each chunk begins with the only piece that holds the mark
            ids = self.sp.encode(" ".join(missing))
            counts = np.diff(np.flatnonzero(self.begins[ids]), append=len(ids)).tolist()
        new = dict(zip(missing, counts, strict=True))
        cache.update((c, n) for c, n in new.items() if len(c) <= CACHE_CHUNK)
        return sum([new[c] if n is None else n for c, n in zip(chunks, got, strict=True)])


def word_bpe(path: str, entries: int = CHUNK_ENTRIES) -> WordBpe:
    """The worker's encoder, which keeps at most so many chunks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
        release()  # what reading the file took
    _ENCODERS[path].entries = entries
    return _ENCODERS[path]


def sentence_pieces(path: str) -> SentencePieceCounter:
    if path not in _ENCODERS:
        _ENCODERS[path] = SentencePieceCounter(path)
    return _ENCODERS[path]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
