"""Quality rules: text statistics by built-in functions, and a decision list learned from labelled ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\\x20\\x09-\\x0D]+"
#: What rules set thresholds on, as SQL over the statistics.
MEASURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1D)",
    "symbols": "n_symbols / greatest(n_words, 1D)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1D)",
    "repeats": "n_repeat_words / greatest(n_words, 1D)",
}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of each text.

    Everything is computed inside the row, without a shuffle.  Repeated
    three-word windows are found on their 64-bit hashes: hash and place are
    packed in one long, longs are sorted, and of neighbours with equal high bits the words themselves
    are compared.  That takes n log n steps in a text of n words.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = base.select(
        "doc_id",
        F.expr(f"array_remove(split(text, '{BLANKS}', -1), '')").alias("words"),
        F.expr(r"filter(split(text, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr(r"cast(octet_length(text) - octet_length(regexp_replace(text, '[#*$%&|<>]+', '')) as long)").alias("n_symbols"),
    )
    two = one.select(
        "doc_id",
        F.expr("cast(size(words) as long)").alias("n_words"),
        "words",
        F.expr("cast(char_length(array_join(words, '')) as long)").alias("word_chars"),
        "n_symbols",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr("case when size(words) > 2 then transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) else array() end").alias("h"),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    three = two.select(*kept, "words", "h", F.expr("cast(ceil(log2(size(h) + 1)) as int)").alias("b"), F.expr("size(h) > 1 and size(array_distinct(h)) < size(h)").alias("again"))
    four = three.select(*kept, "b", F.expr("if(again, words, null)").alias("words"), F.expr("case when again then sort_array(transform(h, (x, i) -> shiftleft(x, b) | cast(i as bigint))) else array() end").alias("s"))
    same = "coalesce(shiftright(x, b) = shiftright(get(s, i - 1), b), false) or coalesce(shiftright(x, b) = shiftright(get(s, i + 1), b), false)"
    window = "struct(struct(words[p] as x, words[p + 1] as y, words[p + 2] as z) as w, p as p)"
    five = four.select(*kept, F.expr(f"sort_array(transform(transform(filter(s, (x, i) -> {same}), x -> cast(x & (shiftleft(1L, b) - 1) as int)), p -> {window}))").alias("c"))
    true = "coalesce(x.w = get(c, i - 1).w, false) or coalesce(x.w = get(c, i + 1).w, false)"
    six = five.select(*kept, F.expr(f"sort_array(transform(filter(c, (x, i) -> {true}), x -> x.p))").alias("p"))
    covered = "aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, x) -> a + x)"
    return six.select(*kept, F.expr(covered).alias("n_repeat_words"))


Rule = list[tuple[str, str, float]]


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, cover: int = 5, longest: int = 4, cuts: int = 64) -> list[Rule]:
    """An ordered list of conjunctions (measure, < or >=, threshold) that single out the bad rows, by sequential covering.

    Two thirds of the rows grow a rule, condition by condition of the greatest
    gain; the others prune its last conditions and decide whether it stays:
    it must be right on the share precision of the rows it covers, and cover some.  The rows it
    covers then go, and the next rule is grown on what is left.
    """
    n = len(bad)
    names = list(values)
    rules: list[Rule] = []
    left = np.ones(n, bool)
    grow = np.arange(n) % 3 != 2

    def holds(rule: Rule) -> np.ndarray:
        out = np.ones(n, bool)
        for name, side, at in rule:
            out &= (values[name] < at) if side == "<" else (values[name] >= at)
        return out

    while True:
        rule: Rule = []
        now = left & grow
        while len(rule) < longest:
            p0, n0 = int((now & bad).sum()), int((now & ~bad).sum())
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for name in names:
                x, y = values[name][now], bad[now]
                seen = np.unique(x)
                # halfway between neighbouring values, at some of the quantiles
                for k in np.unique(np.searchsorted(seen, np.quantile(x, np.linspace(0, 1, cuts + 1)[1:], method="higher"))).tolist():
                    at = (seen[k - 1] + seen[k]) / 2 if k else seen[0]
                    low = x < at
                    for side, mask in (("<", low), (">=", ~low)):
                        p = int((mask & y).sum())
                        q = int(mask.sum()) - p
                        if p and (g := p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = (name, side, float(at)), g
            if best is None:
                break
            rule.append(best)
            now &= holds([best])
        if not rule:
            break

        def worth(r: Rule) -> float:
            mask = holds(r) & left & ~grow
            p = int((mask & bad).sum())
            return (2 * p - int(mask.sum())) / max(1, int(mask.sum()))

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        mask = holds(rule) & left
        held = mask & ~grow
        right = min((mask & bad).sum() / max(1, mask.sum()), (held & bad).sum() / held.sum() if held.sum() else 1.0)
        if mask.sum() < cover or right < precision:
            break
        rules.append(rule)
        left &= ~mask
    return rules


def as_condition(rules: list[Rule]) -> Column:
    """Whether a row passes: a conditional expression with a branch per rule, in order."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, side, at in rule:
            x = F.expr(MEASURES[name])
            test &= (x < at) if side == "<" else (x >= at)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(labels: DataFrame, rows: int, label_col: str) -> DataFrame:
    """(_id, _label) of at most rows labelled documents: those of the least hashes of their ids."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).alias("_label"))
    return known.orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(rows)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of every text, base_failed, and kept.

    base_failed: under 50 words, or over half the words in repeated three-word
    windows.  kept is false then, else what the decision list says, learned from
    labels.quality of at most sample labelled documents (the bound of what the
    driver reads); without labels all that pass the base are kept.

    A null or empty text has no words and fails.  Repeated rows give repeated results, null ids
    are kept, an empty table gives an empty one, further columns are not read.
    """
    stats = text_statistics(docs, id_col, text_col)
    few = F.broadcast(labelled_sample(labels, sample, "quality"))
    graded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(few, F.col("doc_id") == F.col("_id"), "left_semi")
    names = ("doc_id", "_label", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    rows = text_statistics(graded).join(few, F.col("doc_id") == F.col("_id")).select(*names).collect()
    rows = sorted((tuple(r) for r in rows), key=repr)
    rows = [r for r in rows if not base_fails(r)]
    values = {}
    if rows:
        x = {n: np.array([r[i] for r in rows], float) for i, n in enumerate(names)}
        values = {
            "n_words": x["n_words"],
            "mean_word": x["word_chars"] / np.maximum(x["n_words"], 1),
            "symbols": x["n_symbols"] / np.maximum(x["n_words"], 1),
            "dup_lines": x["n_dup_lines"] / np.maximum(x["n_lines"], 1),
            "repeats": x["n_repeat_words"] / np.maximum(x["n_words"], 1),
        }
    rules = learn_rules(values, x["_label"] == 0) if rows else []
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & as_condition(rules)).alias("kept"))


def base_fails(r: tuple) -> bool:
    return r[2] < 50 or 100 * r[7] > 50 * r[2]
