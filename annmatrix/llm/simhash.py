"""SimHash fingerprints of word shingles, and near duplicates by deletion-variant signatures."""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved, text_of
from .components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    # eight counters of a byte side by side in each integer; 255 rows can't overflow them
    return np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def shingle_hashes(text: str, size: int):
    """Arrays of the hashes of a text's shingles of size words, in order; the one of all words of a shorter text, none without words."""
    digest = xxhash.xxh64_intdigest
    data = text.encode().translate(LOWER)
    any_yet, carry, at = False, [], 0
    while at < len(data):
        to = len(data)
        if to - at > BLOCK:
            found = BLANK.search(data, at + BLOCK)
            to = found.start() if found else to
        words = carry + data[at:to].split()
        at = to
        if len(words) >= size:
            joined = b" ".join(words)
            length = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(length + 1) - 1
            starts = (ends - length)[: len(words) - size + 1].tolist()
            yield np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
            any_yet = True
            words = words[len(words) - size + 1 :]
        carry = words
    if carry and not any_yet:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def fingerprint(text: str, size: int = 4) -> int:
    """The SimHash of a text's shingles of size words as a signed 64-bit integer; 0 without words."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        counts += bit_counts(hashes)
        total += len(hashes)
    return majority(counts, total)


def majority(counts: np.ndarray, total: int) -> int:
    """The fingerprint of total hashes of which counts have each bit set, as a signed 64-bit integer; 0 of none."""
    return int(np.packbits((2 * counts > total).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a long."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "fp": [fingerprint(t, size) for t in cols["text"].to_pylist()]}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, "doc_id long, fp long")


#: Distinct fingerprints up to which a key is one segment; above, two segments make a key, longer and so less often shared by chance.
SHORT_KEYS = 4_000_000
#: Bits of a variant that hold its key's bits; the number of the key and the left-out bit stand above them.
PACKED = 44
#: Fingerprints whose variants one task writes.
SPREAD = 200_000

Key = list[tuple[int, int]]


def keys(distance: int, together: int = 1) -> list[Key]:
    """The lists of segments (first bit, bits) that make a key: of two fingerprints at the distance some key differs in one bit at most.

    With one segment a key there are so few that one of them has at most one of the differing bits; with two, so
    few that the two least differing ones have at most one between them.  Keys have at most PACKED bits.
    """
    n = max(2, distance // 2 + 1) if together == 1 else max(3, distance + 1)
    edges = [64 * i // n for i in range(n + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in itertools.combinations(parts, together)]


def packed(x: Column, key: Key) -> Column:
    """The bits of a key, side by side."""
    out, at = F.lit(0).cast("long"), 0
    for low, bits in key:
        out = out + F.shiftleft(F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << bits) - 1)), at)
        at += bits
    return out


def variants(prints: DataFrame, wanted: list[Key]) -> DataFrame:
    """The columns of prints and variant: a row for each key and each of its bits, with that bit left out."""
    out, number = [], 0
    for key in wanted:
        value = packed(F.col("fp"), key)
        for i in range(sum(bits for _, bits in key)):
            out.append(value.bitwiseAND(F.lit(~(1 << i))) + F.lit(number << PACKED))
            number += 1
    return prints.select(*prints.columns, F.explode(F.array(*out)).alias("variant"))


def star_links(prints: DataFrame, distance: int = 4, together: int = 1) -> DataFrame:
    """(a, b): links of each fingerprint with the least one of each of its variants, where they are near enough.

    At most a row for each variant, so a dense cloud of m fingerprints gives m times a number, not m squared.
    """
    index = variants(prints.select("fp"), keys(distance, together))
    least = index.groupBy(F.col("variant").alias("bucket")).agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("bucket", "least")
    near = (F.col("fp") > F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= distance)
    return index.join(least, (F.col("variant") == F.col("bucket")) & near).select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, distance: int = 4, together: int = 1) -> DataFrame:
    """(a, b), a < b, once for each pair of the distinct fingerprints fp that differ in 1 to distance bits.

    If prints has the column root, pairs with equal roots are left out.

    Each key is written to the index once for each of its bits, with that bit left out.  The join on
    those variants finds every pair with a key that differs in a bit at most.  The true distance is verified in the join, and
    a pair that several variants find comes out of the first of them only, so the join makes no more
    rows than there are links.  Its exchange is its own, so adaptive execution can split hot variants.
    """
    wanted = keys(distance, together)
    index = variants(prints, wanted)
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    place = F.shiftright(F.col("a.variant"), PACKED)
    first, number = F.lit(False), 0
    for k, key in enumerate(wanted):
        bits = sum(n for _, n in key)
        here = place.between(number, number + bits - 1) & ((place == number) | (packed(differ, key) != 0))
        for other in wanted[:k]:
            here &= F.bit_count(packed(differ, other)) > 1
        first |= here
        number += bits
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= distance)
    if "root" in prints.columns:
        near &= F.col("a.root") != F.col("b.root")
    return a.join(b, (F.col("a.variant") == F.col("b.variant")) & near & first).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def connecting_links(prints: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """(a, b): links of the n distinct fingerprints fp that connect all that differ in at most distance bits.

    Links with the least fingerprint of each variant come first; then all between their components.
    """
    together = 1 if n <= SHORT_KEYS else 2
    few = prints if n <= SPREAD else prints.repartition(-(-n // SPREAD), "fp")
    stars = saved(star_links(few, distance, together))
    roots = components(stars)
    # singletons need no row of their own here: their fingerprint is their root
    placed = few.join(roots.withColumnRenamed("node", "at"), F.col("fp") == F.col("at"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return stars.union(links(placed, distance, together))


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in at most distance bits are linked;
    component_id is the least doc_id that links reach.  The index holds each
    fingerprint once, so any number of exact copies costs as much as one of them.
    Links with the least fingerprint of each variant come first; then only fingerprints of different
    components are paired, so that a dense cloud doesn't give all its pairs.

    Null and empty texts have fingerprint 0, linked like any other; very long texts are read in blocks of
    words, and nothing is kept of a block but bit counts.  Repeated rows
    give repeated results; a row without id gets a component but doesn't name it
    (null if none of the component has one).  An empty table gives an empty one;
    further columns are not read.
    """
    prints = saved(fingerprints(docs, size, id_col, text_col))
    one = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = one.count()
    found = connecting_links(one.select("fp"), n, distance)
    # nodes are named by their least doc_id, so the least node of a component tells its id
    name = F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp")
    a, b = (one.select(name.alias(c), F.col("fp").alias(f"{c}_fp")) for c in ("a", "b"))
    named = found.select(F.col("a").alias("x"), F.col("b").alias("y")).join(a, F.col("x") == F.col("a_fp")).join(b, F.col("y") == F.col("b_fp")).select("a", "b")
    top = components(named).select(F.col("node.fp").alias("at"), F.col("root.least").alias("component_id"))
    own = one.join(top, F.col("fp") == F.col("at"), "left").select(F.col("fp").alias("print"), F.when(F.col("at").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(own, F.col("fp") == F.col("print")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
