"""Best-fit packing of token sequences, with the large items matched first.

At most two items above a third of the capacity fit into one sequence, so these are paired greedily: the longest with the
longest that still fits.  All smaller items then go, longest first, where the least room is left that holds them.

Only the counts of each length decide where items of that length go, and there are at most ``capacity`` lengths.  So the
plan is made on the driver from this histogram, whose size does not depend on the data; it says, for runs of the ranks
of a length, in which sequences they lie.  Rows learn their rank among the items of their length from one small
aggregation, and then find their place in the plan on their own.

``sequences`` then puts the ids of each sequence together, at most ``capacity`` of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pieces_of, staged
from tidemark.llm.tokens import default_vocabulary, encoder


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but for the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)] if n else []


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int | None = 0, payload: str = "ids", numbered: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length and ``ids`` (binary, unsigned 32 bits each).

    ``payload="crc32"`` gives ``ids_crc32`` in place of the ids, ``numbered`` what ``pack_documents`` needs besides.  A null text counts as empty, an empty text is just the
    end id; repeated rows are packed as often as they come; columns other than doc_id and text are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    with_ids = payload == "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).ids
        for batch in pieces_of(batches, 2 << 20):
            rows: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                data += tail
                for i, (a, n) in enumerate(cut(len(data) // 4, capacity)):
                    own = data[4 * a : 4 * (a + n)]
                    rows.append((doc, i, a, n, own if with_ids else zlib.crc32(own)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds, strict=True)], names)

    texts, schema = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"doc_id long, piece int, start long, length long, {'ids binary' if with_ids else 'ids_crc32 long'}"
    if not numbered:
        return texts.mapInArrow(run, schema)
    return texts.mapInArrow(lambda batches: _numbered(run(batches), 3, 4 if with_ids else None, capacity), f"{schema}, pack_part long, pack_rank long")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int | None = 0) -> DataFrame:
    """``pack`` of ``token_pieces`` with ids; a task has one worker for both."""
    numbered = staged(token_pieces(docs, capacity, vocabulary, end_id, numbered=True), "packing")
    return _placed(numbered, ["doc_id", "piece", "start", "length", "ids"], capacity)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where items go.  Rows (length, first rank, first sequence, items a sequence, offset of the first of these), by length and rank."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    placed, rank, bins = [], dict.fromkeys(left, 0), 0
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # of each gap: (first sequence, how many)

    def put(n: int, first: int, sequences: int, each: int, offset: int, items: int) -> None:
        placed.append((n, rank[n], first, each, offset))
        rank[n] += items
        left[n] -= items
        gap = capacity - offset
        full = items // each
        if full and gap - each * n:
            room[gap - each * n].append((first, full))
        if over := items - full * each:
            room[gap - over * n].append((first + full, 1))
            full += 1
        if sequences > full:
            room[gap].append((first + full, sequences - full))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for k, a in enumerate(large):
        for b in large[k:]:
            if a + b > capacity or not left[a]:
                continue
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                for n, offset in ((a, 0), (b, a)):
                    placed.append((n, rank[n], bins, 1, offset))
                    rank[n] += pairs
                    left[n] -= pairs
                if capacity - a - b:
                    room[capacity - a - b].append((bins, pairs))
                bins += pairs
        if left[a]:
            bins += (new := left[a])
            put(a, bins - new, new, 1, 0, new)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity + 1):
            while room[gap] and left[n]:
                first, sequences = room[gap].pop()
                each = gap // n
                put(n, first, sequences, each, capacity - gap, min(left[n], sequences * each))
            if not left[n]:
                break
        if left[n]:
            each = capacity // n
            new = -(-left[n] // each)
            bins += new
            put(n, bins - new, new, each, 0, left[n])
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


def _narrowed(ids: pa.Array, length: np.ndarray) -> pa.Array | None:
    """Ids of 32 bits each as ids of 16 bits; None if some don't fit or the column holds something else."""
    if not len(ids) or ids.null_count:
        return None
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    if (np.diff(offsets) != 4 * length).any():
        return None
    values = np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4")
    if values.size and int(values.max()) >= 1 << 16:
        return None
    at = np.concatenate([[0], np.cumsum(2 * length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.astype("<u2").tobytes())])


def _widened(ids: pa.Array, narrow: np.ndarray) -> pa.Array:
    """The ids of 32 bits again, in the rows that were narrowed."""
    return pa.array([np.frombuffer(x, "<u2").astype("<u4").tobytes() if thin else x for x, thin in zip(ids.to_pylist(), narrow.tolist(), strict=True)], pa.binary())


def _wider(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` with sequence_id and offset added; ``length`` (1 to capacity) says how long a row is.

    All other columns, ids among them, go along.  Sequences are gapless from offset 0.  An empty table gives an empty table; a null length is an error.
    Columns named sequence_id, offset, pack_part or pack_rank are replaced.
    """
    kept = items.drop("sequence_id", "offset", "pack_part", "pack_rank")
    names, where = kept.columns, kept.columns.index("length")
    schema = _wider(kept, "pack_part", "pack_rank")
    # ids travel in 16 bits each where they fit
    held = _ids_column(kept)
    numbered = staged(kept.mapInArrow(lambda batches: _numbered(batches, where, held, capacity), schema), "packing")
    return _placed(numbered, names, capacity)


def _ids_column(df: DataFrame) -> int | None:
    """Where ids that may travel in 16 bits each stand."""
    return df.columns.index("ids") if "ids" in df.columns and isinstance(df.schema["ids"].dataType, T.BinaryType) else None


def _numbered(batches: Iterator[pa.RecordBatch], where: int, held: int | None, capacity: int) -> Iterator[pa.RecordBatch]:
    """Batches with the task's number and the rank of each row among those of its length within the task."""
    seen = np.zeros(capacity + 1, np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(n, kind="stable")
        run = np.arange(len(n)) - np.searchsorted(n[order], n[order], "left")
        rank = np.empty(len(n), np.int64)
        rank[order] = run
        rank += seen[n]
        seen += np.bincount(n, minlength=capacity + 1)
        columns = batch.columns
        thin = None if held is None else _narrowed(columns[held], n)
        if thin is not None:
            columns[held] = thin
        # the rank's lowest bit says whether the ids were narrowed
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(n), part)), pa.array(2 * rank + (thin is not None))], [*batch.schema.names, "pack_part", "pack_rank"])


def _placed(numbered: DataFrame, names: list[str], capacity: int) -> DataFrame:
    """Rows with their part and rank, in sequences."""
    where, held, kept = names.index("length"), _ids_column(numbered), numbered.select(*names)
    tallies = numbered.groupBy("length", "pack_part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("pack_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tallies.select("length", "pack_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pack_base"))
    ranked = numbered.join(bases, ["length", "pack_part"]).select(*names, (2 * F.col("pack_base") + F.col("pack_rank")).alias("pack_rank"))
    # ranks stay below 2**50, so one number holds a length and a rank
    keys = (places[:, 0] << 50) + places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            marked, columns = batch.column(len(names)).to_numpy(zero_copy_only=False), batch.columns[:-1]
            rank = marked >> 1
            if held is not None and (marked & 1).any():
                columns[held] = _widened(columns[held], (marked & 1).astype(bool))
            _, start, first, each, offset = places[np.searchsorted(keys, (n << 50) + rank, "right") - 1].T
            over = rank - start
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first + over // each), pa.array(offset + over % each * n)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, _wider(kept, "sequence_id", "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, length, parts): the ids of each packed sequence one after the other, and its parts as (doc_id, piece, start, length, offset).

    ``packed`` is ``pack`` of pieces with ids.  A sequence holds at most ``capacity`` ids, so a group is never large.
    """
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    length = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    parts = F.transform("held", lambda x: F.struct(*(x[n].alias(n) for n in ("doc_id", "piece", "start", "length", "offset"))))
    return whole.select("sequence_id", ids.alias("ids"), length.alias("length"), parts.alias("parts"))
