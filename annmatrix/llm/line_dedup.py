"""Line deduplication: winnowed line fingerprints, matches extended both ways, later runs deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, saved

HAS_WORD = r"x rlike '[^\\x20\\x09-\\x0D]'"
WORDS = r"regexp_count(x, '[^\\x20\\x09-\\x0D]+')"


def stretches(sign: str, min_words: int) -> str:
    """SQL for the shortest stretch of min_words words or more from each line of the array lines onwards (sign +) or back (-).

    print and place are its first line by length and hash and where that is; stretch (64 bits) and
    check (32 bits) are hashes of its lines and the direction, least its first place and size its lines.
    Every line has a word, so min_words - 1 more lines are enough.
    Elements are picked one by one: taking a slice would copy the whole array for each place.
    """
    y = f"get(lines, i {sign} j)"
    start = f"named_struct('n', x.w, 'stretch', xxhash64(x.h, '{sign}'), 'check', hash(x.g), 'w', x.w, 'print', x.h, 'place', i, 'size', 1)"
    better = f"({y}.w > a.w or ({y}.w = a.w and {y}.h < a.print))"
    more = f"named_struct('n', a.n + {y}.w, 'stretch', xxhash64(a.stretch, {y}.h), 'check', hash(a.check, {y}.g), 'w', if({better}, {y}.w, a.w), 'print', if({better}, {y}.h, a.print), 'place', if({better}, i {sign} j, a.place), 'size', a.size + 1)"
    steps = f"array({', '.join(map(str, range(1, min_words)))})" if min_words > 1 else "array_repeat(0, 0)"
    whole = f"if(x.w >= {min_words}, {start}, aggregate({steps}, {start}, (a, j) -> if(a.n >= {min_words} or {y} is null, a, {more})))"
    least = "i" if sign == "+" else "i - e.size + 1"
    ends = f"e -> if(e.n >= {min_words}, named_struct('print', e.print, 'place', e.place, 'stretch', e.stretch, 'check', e.check, 'least', {least}, 'size', e.size), null)"
    # a line that is long enough by itself is one stretch, not one in each direction
    skip = "false" if sign == "+" else f"x.w >= {min_words}"
    return f"transform(lines, (x, i) -> if({skip}, null, transform(array({whole}), {ends})[0]))"


def stretch_table(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """number (the id), key (of id and text), print, place, stretch, check, least and size of every shortest stretch of every row."""
    base = docs.select(F.col(id_col).alias("number"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = rf"transform(filter(split(text, '\\n', -1), x -> {HAS_WORD}), x -> named_struct('h', xxhash64(x), 'g', hash(x), 'w', {WORDS}))"
    one = base.select("number", F.xxhash64(F.col("number").cast("string"), "text").alias("key"), F.expr(lines).alias("lines"))
    # generators keep the arrays from being put in, with their definitions, for each element
    one = one.select("number", "key", F.explode(F.array("lines")).alias("lines"))
    both = f"filter(concat({stretches('+', min_words)}, {stretches('-', min_words)}), e -> e is not null)"
    return one.select("number", "key", F.expr(f"inline({both})"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs without runs of lines that an earlier document, or an earlier place of the document, has.

    A run is a stretch of lines equal to a stretch of an earlier place, with
    min_words words or more.  Lines without a word are passed over, and stay.  Earlier
    is: smaller doc_id (null first), then an earlier place in the text.  So each line that goes has
    an equal one before it, and the first of all equal lines stays.  n_chars, if
    there is such a column, follows the text.  A document of which no line is left goes.

    Winnowing: of the lines in a stretch of min_words words or more, the one
    that comes first by length and hash is its fingerprint, so equal stretches share it.
    Every line of a run is in a stretch of the run that can't be
    shortened at its end, or at its start, without having fewer than min_words words.  So
    those shortest stretches, from each line onwards and back, are all there is to compare:
    the ones whose fingerprint is found at one place only are left out, and each other
    one is joined, by the hash of its lines, to the first place of that stretch in all documents.
    All others of the stretch go, wherever else their lines are found.

    A hot stretch is one group of a partial aggregation and then one row that its
    followers join, through exchanges of their own, which adaptive execution can split.
    Stretches count as equal if 96 bits of their hashes are.

    Null texts have no line and stay null, empty ones stay empty; a very long text takes time that grows with its lines;
    rows that repeat a document whole (id and text) are treated alike, and of equal lines within a text the first stays;
    an empty table gives an empty one; other columns are carried along, whatever their names.
    """
    rows = saved(stretch_table(docs, min_words, id_col, text_col))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("key", "place") for f in (F.min, F.max)]
    seen = rows.groupBy("print").agg(*ends).where("min_key < max_key or min_place < max_place").select(F.col("print").alias("seen"))
    again = saved(rows.join(seen, F.col("print") == F.col("seen"), "left_semi").select("number", "key", "stretch", "check", "least", "size"))
    place = F.struct(F.col("number").isNotNull().alias("named"), "number", "key", F.col("least").alias("at"))
    first = again.groupBy("stretch", "check").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select(F.col("stretch").alias("same"), F.col("check").alias("same_check"), "first")
    later = again.join(first, (F.col("stretch") == F.col("same")) & (F.col("check") == F.col("same_check")) & (place != F.col("first")))
    gone = later.select("number", "key", F.explode(F.sequence(F.col("least"), F.col("least") + F.col("size") - 1)).alias("at")).distinct()
    masks = saved(gone.groupBy(F.col("number").alias("cut_number"), F.col("key").alias("cut_key")).agg(F.sort_array(F.collect_list("at")).alias("mask")))

    text = F.col(f"`{text_col}`").cast("string")
    whole = boxed(docs, number=F.col(f"`{id_col}`"), key=F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.coalesce(text, F.lit(""))))
    met = whole.join(masks, (F.col("key") == F.col("cut_key")) & F.col("number").eqNullSafe(F.col("cut_number")), "left")
    parts = met.select("row", "mask", F.when(F.col("mask").isNotNull(), F.split(F.col("row").getField(text_col).cast("string"), "\n", -1)).alias("lines"))
    parts = parts.withColumn("full", F.expr(f"filter(transform(lines, (x, i) -> if({HAS_WORD}, i, null)), i -> i is not null)"))
    parts = parts.withColumn("drop", F.expr("transform(mask, i -> get(full, i))"))
    between = "slice(lines, coalesce(get(drop, j - 1), -1) + 2, coalesce(get(drop, j), size(lines)) - coalesce(get(drop, j - 1), -1) - 1)"
    parts = parts.withColumn("kept", F.expr(f"if(size(drop) = size(full), null, array_join(flatten(transform(sequence(0, size(drop)), j -> {between})), '\\n'))"))
    # a generator keeps what it yields from being put in, with its definition, for each element of a filter pushed down
    parts = parts.select("row", "mask", F.expr("explode(case when mask is null then array(cast(null as string)) when kept is not null then array(kept) else array() end) as new"))
    changed = F.col("mask").isNotNull()

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == text_col:
            return F.when(changed, F.col("new")).otherwise(old.cast("string")).alias(c)
        return (F.when(changed, F.length("new").cast("long")).otherwise(old) if c == "n_chars" else old).alias(c)

    return parts.select(*[column(c) for c in docs.columns])
