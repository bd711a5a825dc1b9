"""Best-fit packing of tokenized documents into sequences, by hierarchical residual rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import bpe
from .common import parts, saved, text_of, tokenizer_path

PIECE = "doc_id:long,piece:int,start:long,length:long,ids_crc32:long"
BIN = f"sequence_id long, used int, pieces array<struct<{PIECE}>>"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Items that one task packs at once; more are packed in groups of this size.
GROUP = 50_000
#: Bins of a group to fold into one group in the next round.
FAN_IN = 8


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Places of items by bin: items by falling size, each into the fullest bin that it fits.

    Bins are kept by their free space, and the free spaces in use as the bits of
    one integer, so that finding a bin takes the same time for any number of bins.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        rest = used >> size
        if rest:
            room = size + (rest & -rest).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                used &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            free[left].append(b)
            used |= 1 << left
    return bins


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, full_from: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents' tokens into sequences of at most capacity tokens.

    A document is its tokens and then end_id; only longer ones are cut, into
    pieces of capacity tokens.  Returns a row per piece: doc_id, piece, start
    (tokens of its document before it), length, ids_crc32, sequence_id, offset.

    Every partition packs its own pieces by best fit.  Bins filled to full_from
    or more are done, and so are those that not even the least filled one fits in.  The others are items of the next round,
    where groups of partitions are packed together, until one group is left.  Groups never hold
    more than GROUP items; as long as there are more, groups are drawn anew each round, and the rounds go on
    until one of them merges nothing.

    Null and empty texts are one piece of one token.  A very long text's ids are held by one task, its pieces
    are packed like any others.  Ties: pieces of equal length are packed in the order in which a task reads them.
    Rows are not joined on doc_id, so repeated or null ids make pieces of their own; an empty table gives
    an empty one; further columns are not read.
    """
    name, limit = tokenizer, int(capacity * full_from)

    def rows(bins: list[tuple[int, int, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b[i] for b in bins], type=f.type) for i, f in enumerate(schema)], schema=schema)

    schema = to_arrow_schema(_parse_datatype_string(BIN))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bpe.load(name if "/" in name else tokenizer_path(name))
        number = TaskContext.get().partitionId() << 40
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        waiting: list[dict] = []

        def shut(items):
            nonlocal number
            out = []
            for found in best_fit([x["length"] for x in items], capacity):
                pieces = [items[i] for i in found]
                out.append((number, sum(x["length"] for x in pieces), pieces))
                number += 1
            for k in range(0, len(out), 5000):
                yield rows(out[k : k + 5000])

        for batch in (part for whole in batches for part in parts(whole)):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            whole = []
            at = 0
            while at < len(texts):  # so that the ids of a few texts are held at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= bpe.BLOCK):
                    size += len(texts[to])
                    to += 1
                _, ids = t.encode(texts[at:to], True)
                for doc_id, x in zip(doc_ids[at:to], ids, strict=True):
                    data = x.astype("<u4").tobytes() + end
                    for k in range(0, len(data), width):
                        part = data[k : k + width]
                        piece = {"doc_id": doc_id, "piece": k // width, "start": k // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                        if len(part) == width:
                            whole.append((number, capacity, [piece]))
                            number += 1
                        else:
                            waiting.append(piece)
                at = to
            if whole:
                yield rows(whole)
            if len(waiting) >= GROUP:
                yield from shut(waiting)
                waiting = []
        if waiting:
            yield from shut(waiting)

    def again(table: pa.Table) -> pa.Table:
        ids, used, pieces = (table.column(n).to_pylist() for n in ("sequence_id", "used", "pieces"))
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids, used, pieces = ([x[i] for i in order] for x in (ids, used, pieces))
        out = []
        for k in range(0, len(ids), GROUP):
            for found in best_fit(used[k : k + GROUP], capacity):
                found = [k + i for i in found]
                out.append((ids[found[0]], sum(used[i] for i in found), [p for i in found for p in pieces[i]]))
        return pa.Table.from_batches([rows(out)], schema=schema)

    arrow = to_arrow_schema(_parse_datatype_string(OUT))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in arrow]
            for number, pieces in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                offset = 0
                for p in pieces:
                    for c, v in zip(cols, (p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"], number, offset), strict=True):
                        c.append(v)
                    offset += p["length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    bins = saved(texts.mapInArrow(first, BIN))

    def sort_out(some: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Bins that are done, the others, and how many those are."""
        least = some.where(F.col("used") < limit).agg(F.min("used")).first()[0] or 0
        open_ = (F.col("used") < limit) & (F.col("used") <= capacity - least)
        return some.where(~open_), some.where(open_), some.where(open_).count()

    spans, turn = bins.rdd.getNumPartitions(), 0
    done, rest, left = sort_out(bins)
    while left and spans > 1:
        groups = max(-(-spans // FAN_IN), -(-left // GROUP))
        # neighbouring partitions first: the task number stands in the high bits of sequence_id, the place in it below
        near = left < groups * GROUP // 2
        key = F.pmod(F.shiftright("sequence_id", 40), F.lit(groups)) if near else F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups))
        packed = saved(rest.withColumn("g", key).groupBy("g").applyInArrow(lambda t: again(t), BIN))
        before, turn = left, turn + 1
        full, rest, left = sort_out(packed)
        done, merged = done.union(full), packed.count() < before
        if not merged and groups >= spans:
            break
        spans = groups
    return done.union(rest).mapInArrow(spread, OUT)
