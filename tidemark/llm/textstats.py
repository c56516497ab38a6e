"""Statistics of whole texts, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.substrings import Words

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words of a window that may come again.
REPEAT = 8


def _flags(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SYMBOL, _UPPER, _LOWER, _DIGIT = (_flags(x) for x in (SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))))
_PUNCT = _flags(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


class TextStats:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; ``features()`` has more."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        self.n = len(w.first) - 1
        self.n_words = np.diff(w.first)
        col = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + self.n + 1]
        self.offsets = offsets - offsets[0]
        self._lead = (w.data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(self._lead)])
        self.n_chars = np.diff(chars[self.offsets])
        self.word_length = chars[w.end] - chars[w.start]
        self.word_chars = self._by_words(self.word_length)
        self.n_symbols = self.bytes_with(_SYMBOL)
        self._lines(col)
        self._repeats()

    def _by_words(self, x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[self.words.first])

    def bytes_with(self, flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag[self.words.data])])[self.offsets])

    def _lines(self, col: pa.Array) -> None:
        """Lines with a word, and those of them that equal an earlier one."""
        lines, again = [], []
        for text in col.to_pylist():
            own = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines.append(len(own))
            again.append(len(own) - len(set(own)))
        self.n_lines, self.n_dup_lines = np.array(lines, np.int64), np.array(again, np.int64)

    def _repeats(self) -> None:
        """Words covered by windows that come twice or more in their text."""
        w, total = self.words, len(self.words.start)
        text = np.repeat(np.arange(self.n), self.n_words)
        at = np.flatnonzero(np.arange(total) + REPEAT <= w.first[1:][text])
        # the text's number in the hash keeps equal windows of different texts apart
        h = w.hashes(at, REPEAT) ^ ((text[at] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        hit = at[order[np.concatenate([same, same + 1])]]
        edge = np.zeros(total + REPEAT + 1, np.int64)
        edge[hit] = 1  # a window may be hit twice
        cover = np.cumsum(edge)
        cover[REPEAT:] -= np.cumsum(edge)[:-REPEAT]
        self.n_repeat_words = self._by_words((cover[:total] > 0).astype(np.int64))

    def features(self) -> np.ndarray:
        """Statistics for a classifier, one row a text: shares and means, none of them an identifier."""
        w, words, chars = self.words, np.maximum(self.n_words, 1), np.maximum(self.n_chars, 1)
        data = w.data
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        lower = np.concatenate([[0], np.cumsum(_LOWER[data])])
        punct = np.concatenate([[0], np.cumsum(_PUNCT[data])])
        up, low, pun = upper[w.end] - upper[w.start], lower[w.end] - lower[w.start], punct[w.end] - punct[w.start]
        length = self.word_length
        hashed = w.hashes(np.arange(len(w.start)), 1)
        text = np.repeat(np.arange(self.n), self.n_words)
        order = np.lexsort((hashed, text))
        new = np.ones(len(order), bool)
        new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (text[order][1:] != text[order][:-1])
        distinct = np.bincount(text[order][new], minlength=self.n)
        mean = self.word_chars / words
        columns = [
            np.log1p(self.n_words),
            mean,
            np.sqrt(np.maximum(self._by_words(length * length) / words - mean * mean, 0)),
            self._by_words(length <= 3) / words,
            self._by_words(length >= 15) / words,
            self._by_words((up >= 2) & (low == 0)) / words,
            self._by_words((up >= 1) & (low >= 1)) / words,
            self._by_words(pun == length) / words,
            self._by_words(pun >= 2) / words,
            self._by_words(pun >= 1) / words,
            self.bytes_with(_UPPER) / chars,
            self.bytes_with(_DIGIT) / chars,
            self.bytes_with(_PUNCT) / chars,
            self.n_symbols / chars,
            self.bytes_with(_flags(b"|")) / words,
            self.bytes_with(_flags(b"!?")) / words,
            self.bytes_with(_flags(b".")) / words,
            self.bytes_with(_flags(b",")) / words,
            self.bytes_with(_flags(b"/:@_=")) / words,
            self.bytes_with(_flags(b"{}[]()<>;")) / words,
            (self.n_chars - self.bytes_with(np.arange(256) < 128)) / chars,
            self.n_lines / words,
            self.n_dup_lines / np.maximum(self.n_lines, 1),
            self.n_repeat_words / words,
            distinct / words,
            self._by_words(np.concatenate([[False], hashed[1:] == hashed[:-1]]) if len(hashed) else length) / words,
        ]
        return np.stack([np.asarray(c, np.float32) for c in columns], 1)
