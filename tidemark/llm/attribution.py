"""Token counts of sections or fields, from one encoding of the whole document.

A document is encoded once, as it would be for training; counting the tokens of each section by itself would give other
numbers wherever a token crosses a border.  Byte-level tokens cover the text without gap, so the lengths of the tokens' bytes give
each token's span.  Tokens and sections are both sorted by place, so the interval join is a binary search of one in the other.

Sections are lines, spans given by a column, or the fields a document is put together from.  A token that lies in several is
allocated by an explicit rule:

* ``first``: to the section that holds its first byte;
* ``last``: to the section that holds its last byte;
* ``most``: to the section that holds most of its bytes, of equals the first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of
from tidemark.llm.tokens import default_vocabulary, encoder

RULES = ("first", "last", "most")


def allocate(borders: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and which tokens cross a border.  ``borders``: where sections begin, ascending; tokens are [begin, end)."""
    head = np.searchsorted(borders, begin, "right") - 1
    tail = np.searchsorted(borders, end - 1, "right") - 1
    if rule == "first":
        where = head
    elif rule == "last":
        where = tail
    else:
        where = head.copy()
        for i in np.flatnonzero(head != tail):
            cuts = np.concatenate([[begin[i]], borders[head[i] + 1 : tail[i] + 1], [end[i]]])
            where[i] = head[i] + int(np.argmax(np.diff(cuts)))
    return where, head != tail


def _line_borders(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places at which lines begin, and the text of each; every text has one at its beginning."""
    feeds = np.flatnonzero(data == 10) + 1
    text = np.searchsorted(first, feeds - 1, "right") - 1
    inside = feeds < (first + size)[text]
    borders = np.concatenate([first, feeds[inside]])
    owner = np.concatenate([np.arange(len(first)), text[inside]])
    order = np.lexsort((borders, owner))
    return borders[order], owner[order]


def _given_borders(starts: pa.Array, lead: np.ndarray, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for given starts in code points.  Those out of the text are moved to its ends; a null list is empty, and 0 is always one."""
    lists = [sorted(x for x in (s or []) if x is not None) for s in starts.to_pylist()]
    lists = [x if x and x[0] <= 0 else [0, *x] for x in lists]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.fromiter((i for x in lists for i in x), np.int64, len(owner))
    n_chars = np.diff(chars)
    return lead[chars[owner] + np.clip(at, 0, n_chars[owner])], owner


def section_tokens(docs: DataFrame, rule: str = "first", vocabulary: str | None = None, starts: Column | None = None) -> DataFrame:
    """One row a section: doc_id, section (int, from 0), start and n_chars in code points, n_tokens, n_crossing.

    ``starts``: an array column of the code points at which the sections of a text begin, in any order; 0 is always one, and two
    equal ones make an empty section.  Without it a section is a line with the line feed that ends it.  Either way the sections cover the document,
    and their tokens add up to its own.  n_crossing counts those of a section's tokens that also lie in another one.  A null or empty text is one empty
    section (or as many as ``starts`` says) without tokens.  Repeated rows are counted each; of the other columns only those that ``starts`` names are read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in pieces_of(batches, 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.frombuffer(b, "<u4") for b in coder.ids(texts)]
            data = np.frombuffer("".join(texts).encode(), np.uint8)
            size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
            first = np.cumsum(size) - size
            is_lead = (data & 0xC0) != 0x80
            count = np.concatenate([[0], np.cumsum(is_lead)])  # of code points before each byte
            if batch.num_columns > 2:
                borders, doc = _given_borders(batch.column(2), np.append(np.flatnonzero(is_lead), len(data)), count[np.append(first, len(data))], first)
            else:
                borders, doc = _line_borders(data, first, size)
            lengths = coder.byte_length[np.concatenate(ids or [np.zeros(0, np.int64)])]
            end = np.cumsum(lengths)
            where, crosses = allocate(borders, end - lengths, end, rule)
            tokens = np.bincount(where, minlength=len(borders))
            crossing = np.bincount(where[crosses], minlength=len(borders))
            open_ = count[borders]
            begins = np.searchsorted(doc, doc, "left")
            columns = [open_ - open_[begins], np.diff(np.append(open_, count[-1])), tokens, crossing]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array((np.arange(len(doc)) - begins).astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)],
                ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"],
            )

    given = [] if starts is None else [starts.cast("array<long>").alias("starts")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *given).mapInArrow(run, "doc_id long, section int, start long, n_chars long, n_tokens long, n_crossing long")


def field_tokens(docs: DataFrame, fields: Sequence[str], rule: str = "first", joiner: str = "\n", vocabulary: str | None = None) -> DataFrame:
    """One row a document and field: doc_id, field, and the columns of ``section_tokens``.

    A document is its fields one after the other, with ``joiner`` between them, and is encoded as that; a joiner belongs to the field
    before it.  Null fields are empty, and keep their joiner.
    """
    if not fields:
        raise ValueError("at least one field")
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(p, F.lit(joiner)) for p in parts[:-1]] + parts[-1:]
    at, starts = F.lit(0).cast("long"), []
    for p in parts:
        starts.append(at)
        at = at + F.length(p)
    whole = docs.select("doc_id", F.concat(*parts).alias("text"), F.array(*starts).alias("starts"))
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("section") + 1).alias("field")
    return section_tokens(whole, rule, vocabulary, F.col("starts")).select("doc_id", name, "section", "start", "n_chars", "n_tokens", "n_crossing")
