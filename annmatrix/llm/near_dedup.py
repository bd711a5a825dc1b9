"""Near duplicates by the similarity of shingle sets: deletion-variant signatures find candidates, exact Jaccard similarity confirms them.

The signatures are those of the SimHash fingerprints, with one bit left out of each key, and, for pairs whose fingerprints
differ in more bits than those reach, those of bands of MinHash minima, with one minimum left out of each band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, map_arrow, saved, settled, text_of
from .components import components
from .simhash import bit_counts, connecting_links, majority, shingle_hashes

#: Bits in which fingerprints may differ whose variants meet surely.
DISTANCE = 4
#: A pair of similarity s differs in at most one minimum of a band with probability p = s ** ROWS + ROWS * s ** (ROWS - 1) * (1 - s); of pairs at 0.8, (1 - p) ** 12 = 3e-6 do in none.
BANDS, ROWS = 12, 6
#: Variants of all bands: each leaves out one minimum.
KEYS = BANDS * ROWS
#: The places that each variant of a band has.
OTHERS = np.array([[i for i in range(ROWS) if i != left] for left in range(ROWS)])
#: Minima that a sketch tells of.
SKETCHED = 240
#: Odd factors, each of which orders the shingles anew; the bands use the first ones.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, SKETCHED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are multiplied by all factors at once.
CHUNK = 2048
#: Sets up to which a bucket's pairs become rows; the sets of larger buckets meet in cells.
SMALL = 4
#: Minima whose four bits stand in one long of a sketch.
PER_LONG = 16
#: Bytes and number of sets that a block of a bucket holds; a cell compares two blocks.
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 1000


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    found = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(shingles), CHUNK):
        counts += bit_counts(shingles[k : k + CHUNK])
    return majority(counts, len(shingles))


def minima(shingles: np.ndarray, number: int = SKETCHED) -> np.ndarray:
    """The least product of the set's shingles with each of the first factors, that number of them."""
    least = np.full(number, ~np.uint64(0))
    for k in range(0, len(shingles), CHUNK):
        np.minimum(least, (FACTORS[:number, None] * shingles[None, k : k + CHUNK]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """The deletion variants of each band of the minima: keys of the band without one of its minima."""
    raw, step = least[:KEYS].reshape(BANDS, ROWS)[:, OTHERS].tobytes(), 8 * (ROWS - 1)
    keys = [xxhash.xxh64_intdigest(raw[step * i : step * (i + 1)], i) for i in range(KEYS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray) -> list[int]:
    """Four bits of each minimum, PER_LONG of them in a long."""
    four = ((least >> np.uint64(30)) & np.uint64(15)).reshape(-1, PER_LONG) << (np.uint64(4) * np.arange(PER_LONG, dtype=np.uint64))
    return np.bitwise_or.reduce(four, axis=1).view(np.int64).tolist()


def most_different(similarity: float) -> int:
    """How many places of two sketches may differ at the similarity: six standard deviations more than the mean."""
    n = SKETCHED
    p = (1 - similarity) * 15 / 16
    return int(n * p + 6 * (n * p * (1 - p)) ** 0.5)


def banded(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print, node, fp, n, keys) of every row: the text's hash, its shingle set's hash, SimHash and size, and the variants of its bands."""

    def make():
        def each(cols):
            sets = [shingle_set(t, size) for t in cols["text"].to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(minima(s, KEYS)) if len(s) else [] for s in sets]
            return {"doc_id": cols["doc_id"], "print": cols["print"], "node": nodes, "fp": [set_fingerprint(s) for s in sets], "n": [len(s) for s in sets], "keys": keys}

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("print", F.xxhash64("text"))
    return map_arrow(rows, make, "doc_id long, print long, node long, fp long, n long, keys array<long>")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, keys, sketch, s) of each row of (node, text) with words: s is the shingle set, sketch its sketch, n and keys as in banded."""

    def make():
        def each(cols):
            sets = [shingle_set(t, size) for t in cols["text"].to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets])
            least = [minima(s) for s in sets]
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            return {"node": cols["node"], "n": np.diff(ends), "keys": [band_keys(x) for x in least], "sketch": [sketch(x) for x in least], "s": held}

        return each

    return map_arrow(texts, make, "node long, n long, keys array<long>, sketch array<long>, s array<long>")


def may_be_alike(one: str, other: str, similarity: float):
    """Whether two sketches differ in few enough places; of pairs at the similarity, one in some ten million is lost."""
    differ = F.lit(0)
    for i in range(SKETCHED // PER_LONG):
        x = F.col(one)[i].bitwiseXOR(F.col(other)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= most_different(similarity)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ends and the values of a column of lists."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.offsets.to_numpy() - whole.offsets[0].as_py(), whole.flatten().to_numpy()


def compare_cell(similarity: float):
    """A function of a cell's sets that gives links (a, b) between similar ones, as few as connect what they connect.

    A cell holds one block of a bucket, whose pairs it compares, or two, of which it compares each set of the one with each of the other.
    It leaves out pairs that meet in a bucket of an earlier variant, and those that its links connect already.
    """
    differ_most = most_different(similarity)

    def run(cell: pa.Table) -> pa.Table:
        key, x, y = (cell.column(c)[0].as_py() for c in ("key", "x", "y"))
        node, block, n = (cell.column(c).to_numpy() for c in ("node", "block", "n"))
        keys = flat(cell.column("keys"))[1].reshape(len(node), KEYS)
        sketches = flat(cell.column("sketch"))[1].view(np.uint64).reshape(len(node), -1)
        ends, values = flat(cell.column("s"))
        values = values.view(np.uint64)  # sorted as such
        earlier = keys[:, : int((keys == key).any(0).argmax())]
        part = np.arange(len(node))
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        one, other = [], []
        for i in left:
            to = right[right > i] if x == y else right
            to = to[(part[to] != part[i]) & (np.minimum(n[to], n[i]) >= similarity * np.maximum(n[to], n[i]))]
            bits = sketches[to] ^ sketches[i]
            bits |= bits >> np.uint64(1)
            bits |= bits >> np.uint64(2)
            to = to[np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(1) <= differ_most]
            to = to[~(earlier[to] == earlier[i]).any(1)]
            mine = values[ends[i] : ends[i + 1]]
            for k in range(0, len(to), 256):  # so that few sets are side by side at once
                some = to[k : k + 256]
                theirs = np.concatenate([values[ends[j] : ends[j + 1]] for j in some])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[some]) - n[some])
                for j in some[common >= similarity * (n[i] + n[some] - common)]:
                    if part[i] != part[j]:
                        part[part == part[j]] = part[i]
                        one.append(node[i])
                        other.append(node[j])
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(other, pa.int64())})

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have the Jaccard similarity or more; their sketches are compared first."""
    first, second = (sets.select(F.col("node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
    # the larger of two similar sets has at most 1 / similarity times the shingles of the smaller
    alike = (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n")) & may_be_alike("a_sketch", "b_sketch", similarity)
    near = pairs.join(first, F.col("a") == F.col("a_node")).join(second, (F.col("b") == F.col("b_node")) & alike).select("a", "b")
    one = near.join(sets.select(F.col("node").alias("a_node"), F.col("s").alias("a_s")), F.col("a") == F.col("a_node")).select("a", "b", "a_s")
    both = one.join(sets.select(F.col("node").alias("b_node"), F.col("s").alias("b_s")), F.col("b") == F.col("b_node"))
    both = both.select("a", "b", F.size("a_s").alias("m"), F.size("b_s").alias("n"), F.size(F.array_intersect("a_s", "b_s")).alias("k"))
    return both.where(F.col("k") >= similarity * (F.col("m") + F.col("n") - F.col("k"))).select("a", "b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes with words that the deletion variants of SimHash fingerprints find.

    Each node meets the least one of its fingerprint, and those the least ones of the fingerprints that connecting_links links
    theirs to, so clouds don't give all their pairs.
    """
    worded = nodes.where("n > 0").select("node", "fp")
    one = saved(worded.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    a, b = (one.select(F.col("fp").alias(f"{c}_fp"), F.col("least").alias(f"{c}_node")) for c in "xy")
    found = connecting_links(one.select("fp"), one.count(), DISTANCE).select(F.col("a").alias("x"), F.col("b").alias("y"))
    apart = found.join(a, F.col("x") == F.col("x_fp")).join(b, F.col("y") == F.col("y_fp")).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    shared = one.where("least < most").select(F.col("fp").alias("at"), "least")
    return apart.union(worded.join(shared, F.col("fp") == F.col("at")).where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")))


def undecided(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one component of (node, root)."""
    now = buckets.join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").withColumn("root", F.coalesce("root", "node"))
    several = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("key").alias("several"))
    return buckets.join(several, F.col("key") == F.col("several"), "left_semi")


def similar(nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root): the components of the links of the similarity, of all nodes that have one.

    nodes has node, fp, n, keys and doc (which begins with doc_id and print of one of its rows in docs).

    Pairs that the variants of SimHash fingerprints find are rows.  Sets that agree in a variant of a band meet in that bucket.  The pairs of a small bucket are rows, a bounded number for each set.  A larger
    bucket is dealt to blocks of bounded size; each pair of blocks is a cell, one task compares it whole and gives links that
    connect what is similar, less than one for each set, so pairs of a cloud never become rows.  Buckets of several blocks
    are first compared with one of their sets each; those which that and the SimHash pairs make one component need no cells.
    """
    near = settled(fingerprint_pairs(nodes))
    # a window writes the index once; keys that one set has go before anything else is told of their buckets
    bucket = Window.partitionBy("key")
    index = nodes.select(F.explode("keys").alias("key"), "node").withColumn("c", F.count(F.lit(1)).over(bucket))
    buckets = settled(index.where("c > 1"))
    meet = buckets.select(F.col("node").alias("used")).union(near.select("a")).union(near.select("b")).distinct()
    used = nodes.join(meet, F.col("node") == F.col("used"), "left_semi").select("node", F.col("doc.doc_id").alias("id"), F.col("doc.print").alias("p"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("print", F.xxhash64("text"))
    met = texts.join(used, F.col("print").eqNullSafe(F.col("p")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    sets = settled(shingle_sets(met.dropDuplicates(["node"]), size))

    small = buckets.where(F.col("c") <= SMALL).select("key", "node")
    other = small.select(F.col("key").alias("bucket"), F.col("node").alias("to"))
    pairs = small.join(other, (F.col("key") == F.col("bucket")) & (F.col("node") < F.col("to"))).select(F.col("node").alias("a"), F.col("to").alias("b"))
    # blocks: of a bucket's sets; the hash that deals sets to blocks tells the pivot too
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.sum("n").over(bucket) * 8 / BLOCK_BYTES)).cast("int")
    sized = buckets.where(F.col("c") > SMALL).join(nodes.select(F.col("node").alias("at"), "n"), F.col("node") == F.col("at"))
    large = settled(sized.select("key", "node", F.min_by("node", F.xxhash64("node")).over(bucket).alias("pivot"), blocks.alias("blocks")))
    stars = large.where("blocks > 1 and node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    links = settled(confirmed(near.union(pairs).union(stars).distinct(), sets, similarity))
    if not large.isEmpty():
        large = undecided(large, components(links))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = large.select("key", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("key", F.col("node").alias("at"), "block", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"))
    cells = dealt.join(sets, F.col("at") == F.col("node")).select("key", "x", "y", "block", "node", "n", "keys", "sketch", "s")
    return components(links.union(cells.groupBy("key", "x", "y").applyInArrow(compare_cell(similarity), "a long, b long")))


def drop_similar(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The documents with exactly one row of each near-duplicate component: that with the least doc_id (null last).

    Documents are linked if the sets of their shingles of size words have the Jaccard similarity or more.
    The search finds a pair at similarity 0.8 with a probability of more than 0.99999, and more alike ones more surely;
    what it finds is confirmed exactly.

    Null and empty texts, and others without words, are linked to each other.  Rows are told apart by id and text, so ids may
    repeat or be null; of rows that repeat both, one stays.  A very long text is read in blocks; its set is held whole, by one task
    at a time.  Of equal texts the one of the least id stays, whatever the order of rows.  An empty table gives an empty one;
    other columns are carried along, whatever their names.
    """
    rows = saved(banded(docs, size))
    doc = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print", "node")
    nodes = saved(rows.groupBy("node").agg(F.min(doc).alias("doc"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    rows = settled(rows.select("doc_id", "print", "node"))  # the keys are in nodes
    names = nodes.select("node", "doc")
    roots = similar(nodes, docs, size, similarity)
    # all but one of a component go, so members need not meet their root
    stays = roots.join(names.withColumnRenamed("node", "at"), F.col("node") == F.col("at")).groupBy("root").agg(F.min("doc").alias("doc")).select(F.col("doc.node").alias("stays"))
    gone = saved(roots.join(stays, F.col("node") == F.col("stays"), "left_anti").select(F.col("node").alias("gone")))
    own = names.join(gone, F.col("node") == F.col("gone"), "left").select(F.col("node").alias("at"), F.col("doc").alias("keep"), F.col("gone").isNull().alias("top"))
    found = saved(rows.select("node", doc.alias("doc")).join(own, F.col("node") == F.col("at")).select("doc", (F.col("top") & (F.col("doc") == F.col("keep"))).alias("kept")))

    drop = found.where("not kept").select(F.col("doc.doc_id").alias("id"), F.col("doc.print").alias("p")).distinct()
    whole = boxed(docs, doc_id=F.col("doc_id").cast("long"), print=F.xxhash64(text_of()))
    left = whole.join(drop, (F.col("print") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    if not found.where("kept").groupBy("doc").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "print"])
    return left.select("row.*")
