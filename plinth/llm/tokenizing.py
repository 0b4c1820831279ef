"""Token ids by the ``tokenizers`` library, cached by white-space separated piece.

Both vocabularies split text at white space before they merge, so a text's ids are the
ids of its pieces in a row.  A piece seen before comes from a table; a new one is encoded
by the library.  Texts with irregular white space are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE_PIECES = 400_000  # some 200 bytes each in a Python worker

# One word of Latin letters, then a run of ASCII signs that never joins letters: two units of every pre-tokenizer here.
_PLAIN = re.compile("([A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]+)([.,;:!?|#$%&*]*)")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


_SPACE = _byte_alphabet()[32]
_STAND_IN = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})


def _shown(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.replace(" ", _SPACE)
    return text.encode().decode("latin-1").translate(_STAND_IN)


class _Table(dict):
    """Ids of a piece as little-endian bytes; the older half goes when it is full, but for what is still in use."""

    def __init__(self, encode: Callable[[str], bytes], size: int) -> None:
        super().__init__()
        self.encode, self.half, self.older = encode, size // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes texts to little-endian ids of type ``dtype``, equal to the library's on the whole text."""

    def __init__(self, file: str, cache_pieces: int = CACHE_PIECES) -> None:
        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.id_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.lower = self.library.normalizer is not None  # the word vocabulary: lower case, no white space
        self.model = self.library.model
        self.spaced = _Table(lambda p: self._piece(self.spaced, " ", p), cache_pieces)
        self.bare = self.spaced if self.lower else _Table(lambda p: self._piece(self.bare, "", p), cache_pieces // 4)
        self.signs = _Table(self._unit, cache_pieces // 4)
        self.line_end = b"" if self.lower else self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.library.encode(text, add_special_tokens=False).ids])

    def _unit(self, unit: str) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(_shown(unit))])

    def _piece(self, table: _Table, before: str, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            return self._whole(before + piece)
        word, signs = plain.groups()
        if signs:
            return table[word] + self.signs[signs]
        return self._unit(word.lower() if self.lower else before + word)

    def encode(self, text: str) -> bytes:
        if self.lower:
            # White space is dropped wherever it stands; empty pieces give nothing.
            return b"".join(map(self.spaced.__getitem__, text.replace("\n", " ").split(" ")))
        if not text:
            return b""
        spaced, bare, out = self.spaced.__getitem__, self.bare, []
        for line in text.split("\n"):
            pieces = line.split(" ")
            # Blanks in a row or at an end, and any other white space (never printable), join pieces.
            if "" in pieces or not line.isprintable():
                return self._whole(text)
            out.append(bare[pieces[0]] + b"".join(map(spaced, pieces[1:])))
        return self.line_end.join(out)

    def encode_all(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of every text, null as empty, each followed by ``end_id``; a piece is looked up once a batch."""
        end = np.array([end_id], self.dtype)
        if not self.lower:
            return pa.array([self.encode(t or "") + end.tobytes() for t in texts.to_pylist()], pa.binary())
        pieces = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        known = pieces.flatten().dictionary_encode()
        blobs = [self.spaced[p] for p in known.dictionary.to_pylist()]
        size = np.array([len(b) for b in blobs], np.int64) // self.dtype.itemsize
        first, place = np.cumsum(size) - size, known.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[place])])
        source = np.arange(upto[-1]) + np.repeat(first[place] - upto[:-1], size[place])
        bounds = pieces.offsets.to_numpy()
        ends = upto[bounds - bounds[0]]
        flat = np.insert(np.frombuffer(b"".join(blobs), self.dtype)[source], ends[1:], end)
        offsets = ((ends + np.arange(len(ends))) * self.dtype.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(name_or_path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """The encoder of a vocabulary file and table size, made once in each Python worker."""
    known = (name_or_path, cache_pieces)
    if known not in _ENCODERS:
        path = name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)
        _ENCODERS[known] = PieceEncoder(path, cache_pieces)
    return _ENCODERS[known]
