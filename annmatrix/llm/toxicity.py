"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a clause become symbols: insult (a lexicon of words and stems with weights, learned
from labelled documents), threat, target, negation, report (closed word lists) and other.
Five transducers read them in a row, each what the one before it writes:

* negation writes denied for insults among the next few words, and other for threats there;
* report writes quoted for insults after a verb of saying, and other for threats there;
* insult remembers the gravest of insult, denied and quoted; threat and target whether there was one.

Their composition is compiled to one transition table.  Its final state gives a clause one of the KINDS, or none,
and the clause's one weight is that of the heaviest word that counts for it.  A document's score is a logistic
function of what its clauses add up to by kind, and of how that compares with its length: words made of common syllables
begin with a stem by chance here and there, so a few in a long text say less than as many in a short one.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_arrow, parts, text_of

# Closed word classes in English, German, French and Spanish.
THREATS = "kill murder hurt destroy strangle shoot stab töten umbringen verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself they them du dich dir ihr euch tu toi vous ils eux tú ti usted ustedes ellos".split()
NEGATIONS = "not never no nobody isn't aren't don't nicht nie kein keine ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called claims claimed wrote quoted reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
#: Insults known without labels, with the weight that a few labelled documents would give them.
INSULTS = {w: 2.0 for w in "idiot moron stupid loser worthless pathetic scum trash disgusting clown".split()}

KINDS = ("insult", "targeted", "negated", "reported", "threat")
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]")
STEM = 3, 12
#: Evidence that a learned entry needs.
LEAST = 40.0
#: How many times as frequent among the words of toxic documents as among those of others a learned entry must be.
LIFT = 6.0
#: Words of a text that outweigh one accepted clause of weight 1.
SPAN = 50
#: Difference between a label and the score from which the label is taken to be wrong.
CONTRADICTED = 0.9
#: Bytes of a part in which forms of words are counted: nearly each has ten of its own.
COUNT_BYTES = 512 << 10
#: Words that a negation governs.
SCOPE = 3

SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, DENIED, QUOTED = range(8)


@dataclass(frozen=True)
class Transducer:
    """steps[state][symbol] is (next state, symbol that is written); state 0 is the first."""

    steps: tuple[tuple[tuple[int, int], ...], ...]

    @classmethod
    def of(cls, states: int, rule: Callable[[int, int], tuple[int, int]]) -> Transducer:
        return cls(tuple(tuple(rule(q, c) for c in SYMBOLS) for q in range(states)))

    def run(self, symbols: Iterable[int]) -> tuple[int, list[int]]:
        state, written = 0, []
        for c in symbols:
            state, out = self.steps[state][c]
            written.append(out)
        return state, written


def negation_rule(left: int, c: int) -> tuple[int, int]:
    """State: how many of the next words are denied."""
    if c == NEGATION:
        return SCOPE, c
    return max(0, left - 1), {INSULT: DENIED, THREAT: OTHER}.get(c, c) if left else c


def report_rule(said: int, c: int) -> tuple[int, int]:
    """State: whether a verb of saying has come."""
    return int(said or c == REPORT), {INSULT: QUOTED, THREAT: OTHER}.get(c, c) if said else c


#: What the insult transducer remembers, by gravity.
GRAVITY = (None, QUOTED, DENIED, INSULT)


def insult_rule(gravest: int, c: int) -> tuple[int, int]:
    return max(gravest, GRAVITY.index(c) if c in GRAVITY[1:] else 0), c


PARTS = (
    Transducer.of(SCOPE + 1, negation_rule),
    Transducer.of(2, report_rule),
    Transducer.of(len(GRAVITY), insult_rule),
    Transducer.of(2, lambda q, c: (int(q or c == THREAT), c)),
    Transducer.of(2, lambda q, c: (int(q or c == TARGET), c)),
)


def composed(parts: Sequence[Transducer]) -> tuple[Transducer, list[tuple[int, ...]]]:
    """One transducer that does what the parts do one after the other, and the parts' states in each of its states."""
    names = [(0,) * len(parts)]
    number = {names[0]: 0}
    steps = []
    for name in names:  # grows
        row = []
        for c in SYMBOLS:
            to, out = [], c
            for part, state in zip(parts, name, strict=True):
                state, out = part.steps[state][out]
                to.append(state)
            if tuple(to) not in number:
                number[tuple(to)] = len(names)
                names.append(tuple(to))
            row.append((number[tuple(to)], out))
        steps.append(tuple(row))
    return Transducer(tuple(steps)), names


def final_kind(states: tuple[int, ...]) -> tuple[str, int] | None:
    """The kind of a clause that ends in the parts' states, and the symbol whose heaviest word weighs it."""
    _, _, gravest, threat, target = states
    if GRAVITY[gravest] == INSULT:
        return ("targeted" if target else "insult"), INSULT
    if threat and target:
        return "threat", THREAT
    return {DENIED: ("negated", DENIED), QUOTED: ("reported", QUOTED)}.get(GRAVITY[gravest])


PRODUCT, STATES = composed(PARTS)
FINALS = [final_kind(s) for s in STATES]


@dataclass
class Grammar:
    """lexicon: entry to weight; an entry that ends in * is a stem, others are whole words."""

    lexicon: dict[str, float] = field(default_factory=lambda: dict(INSULTS))
    weights: dict[str, float] = field(default_factory=lambda: {"insult": 2.0, "targeted": 4.0, "negated": 0.5, "reported": 0.5, "threat": 6.0, "density": 0.0, "bias": -3.0})

    def compile(self) -> Clauses:
        return Clauses(self)


class Clauses:
    """The grammar, ready to read texts."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.weights = grammar.weights
        closed = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT))
        self.words = {w: (symbol, 1.0) for group, symbol in closed for w in group}
        self.words |= {e: (INSULT, w) for e, w in grammar.lexicon.items() if not e.endswith("*")}
        self.stems = {e[:-1]: w for e, w in grammar.lexicon.items() if e.endswith("*") and len(e) > 1}
        self.lengths = sorted({len(e) for e in self.stems}, reverse=True)
        # only finds the clauses that can be accepted; which are is up to the transducers
        self.find = ahocorasick.Automaton()
        for word in (*self.stems, *(w for w, (symbol, _) in self.words.items() if symbol in (INSULT, THREAT))):
            if word:
                self.find.add_word(word, len(word))
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        """What a word counts as, and its weight: by the whole word, by what stands before an apostrophe, by the longest stem."""
        found = self.words.get(word)
        if found is None and not word.isalpha():
            found = self.words.get(re.split("['’]", word, maxsplit=1)[0])
        if found is None:
            stem = next((word[:n] for n in self.lengths if word[:n] in self.stems), None)
            found = (OTHER, 0.0) if stem is None else (INSULT, self.stems[stem])
        return found

    def clauses(self, low: str) -> Iterator[str]:
        """The whole clauses that have an insult or a threat, each once, in order."""
        ends: Iterator[re.Match] | None = None
        start, end = 0, -1
        for last, length in self.find.iter(low):
            at = last - length + 1
            if at < end or (at and low[at - 1].isalpha()):
                continue
            ends = ends or CLAUSE_END.finditer(low)
            while end < at:
                start, stop = end + 1, next(ends, None)
                end = stop.start() if stop else len(low)
            yield low[start:end]

    def weigh(self, clause: str) -> tuple[str, float] | None:
        """The kind and weight of an accepted clause."""
        state, heaviest = 0, [0.0] * len(SYMBOLS)
        for word in WORDS.finditer(clause):
            symbol, weight = self.symbol(word[0])
            state, out = PRODUCT.steps[state][symbol]
            if weight > heaviest[out]:
                heaviest[out] = weight
        found = FINALS[state]
        return found and (found[0], heaviest[found[1]])

    def sums(self, text: str) -> np.ndarray:
        """What the accepted clauses of a text add up to, by kind, on a scale that flattens out."""
        out = np.zeros(len(KINDS))
        for clause in self.clauses(text.lower()) if text else ():
            if found := self.weigh(clause):
                out[KINDS.index(found[0])] += found[1]
        return np.log1p(out)

    def score(self, sums: np.ndarray, density: float = 0.0) -> float:
        z = self.weights["bias"] + sum(self.weights[k] * s for k, s in zip(KINDS, sums, strict=True)) + self.weights["density"] * density
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    def judge(self, text: str) -> float:
        """The score of a whole text."""
        sums = self.sums(text)
        return self.score(sums, density(sums, text))


#: The kinds that are neither denied nor quoted.
MEANT = [KINDS.index(k) for k in ("insult", "targeted", "threat")]


def density(sums: np.ndarray, text: str) -> float:
    """How what the clauses add up to compares with the number of words of the text, on a logarithmic scale."""
    return math.log((1 + float(np.expm1(sums[MEANT]).sum())) / (1 + len(text.split()) / SPAN))


def word_forms(word: str) -> list[str]:
    """A word with a $ after it, and its prefixes."""
    return [word + "$", *(word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1))]


def evidence(p: int, n: int, share: float) -> float:
    """The G statistic of p toxic and n clean occurrences, where toxic ones should be that share."""
    total = p + n
    return 2 * sum(x * math.log(x / (total * part)) for x, part in ((p, share), (n, 1 - share)) if x)


def lifted(p: int, n: int, toxic: int, clean: int, times: float = LIFT) -> bool:
    """Whether p of toxic words is that many times as frequent as n of clean words."""
    return p * clean >= times * n * toxic


def choose_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: float = LEAST) -> dict[str, float]:
    """Entries from (word$ or prefix, contexts in toxic documents, contexts in clean ones); toxic and clean are the numbers of their words.

    Forms that are LIFT times as frequent in toxic documents, with evidence of least, enough for a chance in a million forms, stand for toxicity.
    A prefix is followed as long as one longer form keeps nearly all its contexts, so
    that whole words and exact stems come out; where a few forms share them, each
    is followed; where many do, the prefix is a stem.
    """
    if not toxic or not clean:
        return dict(INSULTS)
    odds: dict[str, tuple[int, float]] = {}
    for form, p, n in counts:
        if lifted(p, n, toxic, clean) and evidence(p, n, toxic / (toxic + clean)) >= least:
            odds[form] = p, min(4.0, math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1)))
    below: dict[str, list[str]] = {}
    for form in odds:
        below.setdefault(form[:-1], []).append(form)
    out: dict[str, tuple[int, float]] = {}

    def follow(form: str) -> None:
        seen = odds[form][0]
        longer = sorted(below.get(form, []), key=lambda f: (-odds[f][0], f))
        if form.endswith("$"):
            out[form[:-1]] = odds[form]
        elif longer and (odds[longer[0]][0] >= 0.9 * seen or len(longer) <= 3 and sum(odds[f][0] for f in longer) >= 0.95 * seen):
            for f in longer:
                follow(f)
        else:
            out[form + "*"] = odds[form]

    for form in sorted(odds):
        if form[:-1] not in odds:
            follow(form)
    return INSULTS | {w: weight for w, (_, weight) in sorted(out.items())}


def fit_weights(sums: np.ndarray, toxic: np.ndarray) -> dict[str, float]:
    """Logistic regression from Grammar's own weights, with a pull back to them for kinds that the labels say little about; sums has the kinds' sums and the density."""
    prior = Grammar().weights
    names = [*KINDS, "density", "bias"]
    start = np.array([prior[n] for n in names])
    if len(toxic) and 0 < toxic.sum() < len(toxic):
        x = np.column_stack([sums, np.ones(len(sums))])
        balance = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum())) * len(toxic)
        w = start.copy()

        def loss(v: np.ndarray) -> float:
            z = x @ v
            return float((balance * (np.logaddexp(0, z) - toxic * z)).sum() + 0.5 * ((v - start) ** 2).sum())

        for rest in (True, False):
            for _ in range(100):  # Newton steps, shortened until they help
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope = x.T @ (balance * (p - toxic)) + (w - start)
                bend = (x * (balance * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
                step = np.linalg.solve(bend, slope)
                while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                    step /= 2
                w -= step
                if np.abs(step).max() < 1e-8:
                    break
            w[:-1] = np.maximum(w[:-1], 0.0)
            # wrong labels make the slope too flat: those that the first fit contradicts have no weight in the second
            balance = balance * (np.abs(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - toxic) < CONTRADICTED) if rest else balance
        start = w
    return {n: float(v) for n, v in zip(names, start, strict=True)}


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def context(words: list[str], i: int) -> int:
    """A number for the words on both sides of a place."""
    return zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 9000) -> Grammar:
    """The lexicon and weights from at most toxic_rows and clean_rows labelled documents that aren't held out.

    Those bounds are what training reads of any corpus.  The sample's texts stay on
    the executors.  A first pass counts the occurrences of each word and prefix in toxic documents;
    a second counts those with enough of them in clean documents; a third, for those rare
    enough there, the different contexts (the words on both sides) in both, so that copies of a document count once.
    Then the kinds' weights are fitted.  Without labels of both kinds the grammar's own lists are used.
    Of rows that share an id one text is read.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(13), "doc_id"), "doc_id"]
    few = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).union(known.where("toxic = 0").orderBy(*order).limit(clean_rows))
    few = few.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    rows = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    # a given number of partitions: as few as the bytes ask for would leave most cores without work
    rows = rows.repartition(max(32, docs.sparkSession.sparkContext.defaultParallelism), "_id")
    sample = rows.groupBy("_id", "_toxic").agg(F.min("text").alias("text")).select("text", "_toxic").persist()
    sizes = {r[0]: r[1] for r in sample.groupBy("_toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    # fewer occurrences than this can't reach the evidence, were all of them contexts in toxic documents
    support = max(3, math.ceil(LEAST / (2 * math.log((toxic + clean) / toxic)))) if toxic and clean else 3

    def uses_of():
        def each(cols):
            words = Counter(w for text in cols["text"].to_pylist() for w in WORDS.findall(text.lower()))
            seen: Counter = Counter()
            for w, n in words.items():
                for f in word_forms(w):
                    seen[f] += n
            return {"form": list(seen), "n": list(seen.values())}

        return each

    def uses_in_clean():
        forms = functools.cache(lambda w: [f for f in word_forms(w) if f in uses])

        def each(cols):
            words = Counter(w for text in cols["text"].to_pylist() for w in WORDS.findall(text.lower()))
            seen: Counter = Counter()
            for w, n in words.items():
                for f in forms(w):
                    seen[f] += n
            return {"form": list(seen), "n": list(seen.values())}

        return each

    def lengths():
        return lambda cols: {"which": cols["_toxic"], "n": [len(WORDS.findall(t)) for t in cols["text"].to_pylist()]}

    total = {r.which: r.n for r in map_arrow(sample, lengths, "which int, n long").groupBy("which").agg(F.sum("n").alias("n")).collect()}
    toxic_words, clean_words = total.get(1, 0), total.get(0, 0)
    counted = lambda which, make: map_arrow(sample.where(f"_toxic = {which}").select("text"), make, "form string, n long", COUNT_BYTES).groupBy("form").agg(F.sum("n").alias("n"))
    uses = {r.form: r.n for r in counted(1, uses_of).where(F.col("n") >= support).collect()}
    in_clean = {r.form: r.n for r in counted(0, uses_in_clean).collect()}
    # keeps the third pass small; much less than LIFT, as copies of clean documents count here
    rare = frozenset(f for f, n in uses.items() if lifted(n, in_clean.get(f, 0), toxic_words, clean_words, 2.0))

    def around():
        forms = functools.cache(lambda w: [f for f in word_forms(w) if f in rare])

        def each(cols):
            seen = set()
            for text, which in zip(cols["text"].to_pylist(), cols["_toxic"].to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                seen |= {(f, which, context(words, i)) for i, w in enumerate(words) for f in forms(w)}
            return {"form": [f for f, _, _ in seen], "which": [t for _, t, _ in seen], "at": [c for _, _, c in seen]}

        return each

    found = map_arrow(sample, around, "form string, which int, at long", COUNT_BYTES).groupBy("form")
    contexts = found.agg(F.countDistinct(F.when(F.col("which") == 1, F.col("at"))).alias("p"), F.countDistinct(F.when(F.col("which") == 0, F.col("at"))).alias("n")).where("p > 0").collect()
    grammar = Grammar(lexicon=choose_lexicon(sorted((r.form, r.p, r.n) for r in contexts), toxic_words, clean_words))

    def add_up():
        clauses = grammar.compile()

        def each(cols):
            texts = cols["text"].to_pylist()
            sums = [clauses.sums(t) for t in texts]
            return {"toxic": cols["_toxic"], "sums": [[*s.tolist(), density(s, t)] for s, t in zip(sums, texts, strict=True)]}

        return each

    got = map_arrow(sample, add_up, "toxic int, sums array<double>").collect()
    sample.unpersist()
    got.sort(key=lambda r: (r.toxic, r.sums))
    if toxic and clean:
        grammar.weights = fit_weights(np.array([r.sums for r in got]), np.array([r.toxic for r in got], float))
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts get the score of a text without accepted clauses; very long texts and
    clauses are read whole, in time that grows with their length.  Repeated rows give repeated results, rows without an id count as not held out, an empty table gives an
    empty one; further columns are not read.
    """

    def make():
        clauses = grammar.compile()

        def each(cols):
            scores = [clauses.judge(t) for t in cols["text"].to_pylist()]
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs whose text scores below threshold, in one pass without a shuffle.

    Null and empty texts stay if a text without accepted clauses scores below it; repeated rows are treated
    alike, an empty table gives an empty one, other columns pass through untouched.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        clauses = grammar.compile()
        for batch in (part for whole in batches for part in parts(whole)):
            keep = [clauses.judge(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
