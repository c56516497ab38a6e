"""Byte-level BPE ids of whole texts, from a vocabulary file of the ``tokenizers`` library.

A text is cut wherever ASCII white space follows something that is not white space.  The pre-tokenizer's pattern looks
forward only and none of its alternatives crosses such a place, so the ids of a text are the ids of its chunks one after
the other; chunks that come back are looked up.  The chunks themselves are encoded by ``tiktoken`` from the ranks in
the vocabulary, which gives the ids of ``tokenizers`` (a test compares them) at a third of its CPU time.

Strings of added tokens are tokens wherever they stand, as in the library: a text that holds one is cut there first.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re

import numpy as np

#: Texts with one of these are encoded whole: other white space (before it, a cut could fall inside a run), and our mark.
WHOLE = tuple(map(chr, (0, 9, 11, 12, 13)))
WHOLE_WIDE = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Chunks in each of the two generations that a worker remembers, at about 200 bytes each.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest as code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(texts)``: of each text its little-endian unsigned 32-bit ids as bytes, those of ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd:
            raise ValueError(f"added tokens that take in what is beside them are not handled: {odd}")
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # of several that begin at one place the longest counts
        self._cuts = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        symbol = _bytes_of_symbols()
        ranks = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self._added}
        self._encode = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        lengths = {i: len(token) for token, i in ranks.items()} | {i: len(token.encode()) for token, i in self._added.items()}
        self.byte_length = np.zeros(max(lengths) + 1, np.int64)
        self.byte_length[list(lengths)] = list(lengths.values())
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if not self._has_added(text):
            return np.array(self._encode(text), "<u4").tobytes()
        ids: list[int] = []
        for part in self._cuts.split(text):
            ids += [self._added[part]] if part in self._added else self._encode(part)
        return np.array(ids, "<u4").tobytes()

    def _has_added(self, text: str) -> bool:
        return any(map(text.__contains__, self._added))

    def _learn(self, keys: list[str]) -> None:
        """Keys of the form of split()'s are encoded in one go and cut again by their bytes; marked ones alone."""
        if len(self._young) + len(keys) > REMEMBERED:
            self._old, self._young = self._young, {}
        young, fresh, chunks = self._young, [], []
        for k in keys:
            if (got := self._old.get(k)) is not None:
                young[k] = got
            elif k[0] == "\0":
                young[k] = self._whole(k[1:])
            else:
                fresh.append(k)
                chunks.append(k if k[0] == "\n" else " " + k)
        if fresh:
            ids = np.array(self._encode("".join(chunks)), "<u4")
            ends = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks)))
            at = (4 * np.searchsorted(np.cumsum(self.byte_length[ids]), ends, "left") + 4).tolist()
            data = ids.tobytes()
            young.update(zip(fresh, map(data.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        flat: list[str] = []
        ends, whole = [0], {}
        for i, text in enumerate(texts):
            if text:
                if any(map(text.__contains__, WHOLE)) or self._has_added(text) or not text.isascii() and any(map(text.__contains__, WHOLE_WIDE)):
                    whole[i] = self._whole(text)
                else:
                    # A chunk that follows a space comes without it; those that open with a line feed keep it; the first bears a mark.
                    flat += ("\0" + text).replace("\n", " \n").split(" ")
            ends.append(len(flat))
        parts = list(map(self._young.get, flat))
        if missing := [i for i, p in enumerate(parts) if p is None]:
            uneven = [i for i in missing if flat[i] in ("", "\n", "\0")]  # white space beside white space or at an end: never remembered
            for i in dict.fromkeys(bisect.bisect_right(ends, i) - 1 for i in uneven):
                whole[i] = self._whole(texts[i])
            self._learn(list(dict.fromkeys([flat[i] for i in missing if flat[i] not in ("", "\n", "\0")])))
            for i in missing:
                parts[i] = self._young.get(flat[i])
        return [whole[i] if i in whole else b"".join(parts[a:b]) for i, (a, b) in enumerate(itertools.pairwise(ends))]


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary)
