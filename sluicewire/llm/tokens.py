"""Token ids exactly as the ``tokenizers`` library gives them, at several times its speed.

Text is cut at ASCII white space, which no piece of the pre-tokenizer crosses, and the ids of each
chunk are remembered. A chunk not seen before goes piece by piece through a faster BPE over the
same vocabulary if it is made of plain Latin characters; anything else (other scripts, control
characters, special tokens, very long chunks) goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .common import holds

#: Chunks and pieces remembered by one worker; beyond, new ones are computed each time.
REMEMBERED = 400_000
#: Chunks longer than this always go to ``tokenizers``.
LONG_CHUNK = 512
_PLAIN = re.compile("[\x21-\x7e\xa1-įı-ɏ]+")
#: The settings that the fast way reproduces; fixed values of the tokenizer file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids of chunks; those not seen before are encoded, and remembered while there is room."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.encode(chunk)
        if len(self) < REMEMBERED and len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids


class WordTokenizer:
    """``encode(text)`` gives the ids as bytes, four little-endian ones an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.chunks = _Chunks(self._chunk)
        self.pieces: dict[str, bytes] = {}
        names = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.fast = None
        self.by_chunk = names == _NORMALIZERS and steps[0].get("pattern", {}).get("Regex") == _SPLIT
        if self.by_chunk and self.suffix:
            import regex
            import tiktoken

            bytes_of = _byte_alphabet()
            ranks = {}
            for token, i in self.vocab.items():
                if token not in self.special:
                    # byte 255 ends a word; UTF-8 never holds it
                    core, end = (token[: -len(self.suffix)], b"\xff") if token.endswith(self.suffix) else (token, b"")
                    ranks[bytes(bytes_of[c] for c in core) + end] = i
            self.fast = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self.split = regex.compile(_SPLIT).findall

    def _slowly(self, text: str) -> bytes:
        return _packed(self.slow.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.fast is None or len(chunk) > LONG_CHUNK or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self._slowly(text)
        out = []
        for piece in self.split(text.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = _packed(self.fast._encode_single_piece(piece.encode() + b"\xff"))
                if len(self.pieces) < REMEMBERED:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._slowly(text)
        return b"".join(map(self.chunks.__getitem__, text.encode().split()))

    def sentence_ends(self) -> np.ndarray:
        """Whether each id ends a sentence: punctuation with a stop at the end of a word."""
        ends = np.zeros(max(self.vocab.values()) + 1, dtype=bool)
        for token, i in self.vocab.items():
            core = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else ""
            ends[i] = bool(core) and any(c in ".!?" for c in core) and not any(c.isalnum() for c in core)
        return ends


@lru_cache(maxsize=2)
def _tokenizer(path: str | None) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordTokenizer(path)


def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer a worker, until other work is done there; the default file is looked up on the machine that runs it."""
    holds("tokens", _tokenizer.cache_clear)
    return _tokenizer(path)
