"""A byte-level BPE vocabulary file as a fast encoder whose ids equal those of the ``tokenizers`` library.

The file's merges, read as ranks, drive ``tiktoken``, which counts and encodes several times as fast in one
thread.  Both cut words by the same pattern; ``tests/llm/test_tokens.py`` compares them over every code point.
A text that the fast matcher refuses (a run of tens of thousands of white-space characters exhausts its
stack) and a vocabulary of another shape go through the library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The word pattern of byte-level vocabularies (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANK = re.compile(r"\s{2000}")
#: A blank with a visible ASCII character on both sides: every match of the pattern that meets it begins there.
_SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _characters() -> dict[str, int]:
    """The format's printable stand-ins for bytes: visible Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file; special strings inside texts become their ids, as by default."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, stand = spec["model"], _characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.pieces = [b""] * size
        for word, i in model["vocab"].items():
            if word not in self.special:
                self.pieces[i] = bytes(stand[c] for c in word)
        for word, i in self.special.items():
            self.pieces[i] = word.encode()
        self.widths = np.array([len(p) for p in self.pieces], np.int64)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        numbers = [model["vocab"][a + b] for a, b in merges]
        self.ranked = numbers == sorted(numbers) and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["normalizer"]
        self.ranked &= not spec["pre_tokenizer"]["add_prefix_space"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ranks = {p: i for i, p in enumerate(self.pieces) if p and i not in self.special.values()}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special) if self.ranked else None
        self._names = set(self.special)
        #: The narrowest integers that hold every id, for ids that have to move.
        self.narrow = "<u2" if size <= 1 << 16 else "<u4"

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` as unsigned 32-bit integers."""
        if self.fast is None or _LONG_BLANK.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, self._names), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for; a broken sequence gives replacement characters, as in the library."""
        raw = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    return Codec(path)


def safe_after(raw: bytes, at: int) -> int:
    """The first safe place at or after ``at``, else the end; encodings of both sides add up there."""
    found = _SAFE.search(raw, max(at, 1))
    return found.start() if found else len(raw)


def safe_places(raw: bytes) -> list[int]:
    return [m.start() for m in _SAFE.finditer(raw)]


def pieces(raw: bytes, size: int) -> list[bytes]:
    """``raw`` cut at safe places into parts of ``size`` bytes or a little more."""
    out, at = [], 0
    while len(raw) - at > size:
        to = safe_after(raw, at + size)
        out.append(raw[at:to])
        at = to
    if at < len(raw) or not out:
        out.append(raw[at:])
    return out
