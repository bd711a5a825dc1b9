"""Fingerprints, lines, toxicity and quality against brute force, and the cases that the docstrings name."""

from __future__ import annotations

import collections
import itertools
import pathlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from annmatrix.llm import common, components, line_dedup, near_dedup, quality, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, fp long, key string, g string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "k", "g") for i, t in rows], DOCS)


def simhash_brute(text, size=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(80)}" for _ in range(60)]
    texts = [None, "", "  \n", "One", "a b c d", "É É é a\x0bb\x0cc", "A B C"]
    for _ in range(30):
        words = base[:]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = "x"
        texts.append(" ".join(words))
    texts += [texts[-1]] * 3 + [" ".join(f"v{rng.randrange(9000)}" for _ in range(40_000))]
    rows = list(enumerate(texts))
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert all(simhash.fingerprint(t or "") & (1 << 64) - 1 == simhash_brute(t) for t in texts[:-1])
    monkeypatch.undo()
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, rows)).collect()}
    want = {i: simhash_brute(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in want.items()}
    label = {i: i for i in want}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(want, 2):
            if (want[a] ^ want[b]).bit_count() <= 4 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {i: r.component_id for i, r in got.items()} == label
    monkeypatch.setattr(simhash, "SHORT_KEYS", 0)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()} == label


@pytest.mark.parametrize(("distance", "together"), [(1, 1), (4, 1), (4, 2)])
def test_links_are_complete_and_single(spark, distance, together):
    rng = np.random.default_rng(distance)
    centers = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    prints = set()
    for c in centers:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(int(np.int64(np.uint64(int(c) ^ sum(1 << int(b) for b in flips)).astype(np.int64))))
    prints |= {0, -1, 1, 1 << 62}
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = simhash.links(table, distance, together).collect()
    want = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    stars = {tuple(r) for r in simhash.star_links(table, distance, together).collect()}
    assert stars <= want
    same = table.withColumn("root", F.pmod("fp", F.lit(2)))
    assert {tuple(r) for r in simhash.links(same, distance, together).collect()} == {(a, b) for a, b in want if (a - b) % 2}
    assert all(sum(n for _, n in key) <= simhash.PACKED for key in simhash.keys(distance, together))


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    odd = table(spark, [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "z")])
    rows = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert rows == {(None, 3): 1, (None, None): 1, (3, 3): 2}
    cloud = table(spark, [(i, " ".join(["same"] * 40 + [f"end{i}"])) for i in range(60)])
    assert {r.component_id for r in simhash.near_duplicates(cloud).collect()} == {0}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in root if any(n in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def long_line(k, n=60):
    return " ".join(f"L{k}w{i}" for i in range(n))


def dedup(spark, rows):
    return {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}


def test_lines_planted_passages(spark):
    passage = "\n".join(f"p{i} " + " ".join(f"q{i}{j}" for j in range(19)) for i in range(4))  # 80 words over 4 lines
    rows = [
        (1, f"start one\n{passage}\nend one"),
        (2, f"start two\n\n{passage}\nend two"),
        (3, f"{passage}\nmore\n{passage}"),
        (4, "short line\nshort line\nshort line"),
        (5, long_line(1) + "\nshort line"),
        (6, "other\n" + long_line(1)),
        (7, long_line(1)),
        (8, passage.split("\n")[0] + "\nx\n" + passage.split("\n")[2]),
        (9, None),
        (10, ""),
        (11, "\n" + "\n".join([long_line(2)] * 5) + "\ntail"),
    ]
    got = dedup(spark, rows)
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1] and got[5].text == rows[4][1] and got[8].text == rows[7][1]
    assert got[2].text == "start two\n\nend two" and got[2].n_chars == len(got[2].text)
    assert got[3].text == "more"
    assert got[6].text == "other" and 7 not in got
    assert got[9].text is None and got[10].text == ""
    assert got[11].text == "\n" + long_line(2) + "\ntail"
    assert got[1].key == "k" and line_dedup.dedup_lines(table(spark, rows)).columns == table(spark, []).columns


def test_lines_runs_extend_both_ways(spark):
    run = ["a b c", "d e f", long_line(3, 48), "g h i", "j k"]
    rows = [(1, "\n".join(["x", *run, "y"])), (2, "\n".join(["z", *run, "u"])), (3, "\n".join(run[:2])), (4, "\n".join([run[0], run[2]]))]
    got = dedup(spark, rows)
    assert got[2].text == "z\nu" and got[3].text == rows[2][1] and got[4].text == rows[3][1]


def test_lines_against_properties(spark):
    rng = random.Random(3)
    pool = [" ".join(f"{k}t{rng.randrange(4)}" for _ in range(rng.randrange(1, 70))) for k in range(25)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    got = dedup(spark, rows)
    first = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if WORD.search(x):
                first.setdefault(x, (i, k))
    for i, t in rows:
        lines = t.split("\n")
        left = got[i].text.split("\n") if i in got else []
        at, kept = 0, set()
        for x in left:  # the last places that fit, so that what is missing is as early as can be
            at = lines.index(x, at)
            kept.add(at)
            at += 1
        assert len(kept) == len(left)
        counts = collections.Counter(lines)
        counts.subtract(left)
        for x, n in counts.items():
            assert n >= 0
            if first.get(x, (None,))[0] == i and n:
                assert x in left  # the first of equal lines stays
            if len(WORD.findall(x)) >= 50:
                assert left.count(x) == (1 if first[x][0] == i else 0)
    assert dedup(spark, []) == {}


def test_lines_repeated_rows(spark):
    rows = [(2, "b\n" + long_line(5)), (2, "b\n" + long_line(5)), (None, "n\n" + long_line(5)), (3, "c\n" + long_line(5))]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(table(spark, rows)).collect())
    assert got == [(0, "n\n" + long_line(5)), (2, "b"), (2, "b"), (3, "c")]


def lines_brute(rows, words):
    """The texts without the lines of all runs of the words or more that an earlier place has; None if no line is left."""
    docs = {i: t.split("\n") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(docs):
        full = [k for k, x in enumerate(docs[i]) if WORD.search(x)]
        gone = set()
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += len(WORD.findall(docs[i][full[b]]))
                run = tuple(docs[i][k] for k in full[a : b + 1])
                if n >= words:
                    if run in seen:
                        gone |= set(full[a : b + 1])
                    seen.add(run)
        out[i] = None if full and len(gone) == len(full) else "\n".join(x for k, x in enumerate(docs[i]) if k not in gone)
    return out


def test_lines_against_brute_force_over_all_runs(spark):
    line = lambda k, n: " ".join(f"{k}c{i}" for i in range(n))
    passage = [line("a", 20), line("b", 20), line("L", 25), line("c", 20), line("d", 20)]
    rows = [(1, "\n".join([line("x", 15), passage[2], line("y", 15)]))]
    rows += [(i, "\n".join([f"s{i}", *passage, f"e{i}"])) for i in range(2, 12)]
    rows.append((12, "\n".join([passage[2], "once", *passage, "z", *passage])))
    rng = random.Random(8)
    pool = [line(f"p{k}", rng.choice([1, 3, 10, 18, 30, 55])) for k in range(8)] + ["", " "]
    rows += [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16)))) for i in range(150)]
    got = {i: r.text for i, r in dedup(spark, rows).items()}
    want = lines_brute(rows, 50)
    assert got == {i: t for i, t in want.items() if t is not None}
    assert all(got[i] == f"s{i}\ne{i}" for i in range(3, 12)) and got[2] == rows[1][1]


def similar_brute(rows, similarity=0.8, size=5):
    """The least id of each component of the texts (id, text)."""
    grams = {}
    for i, t in rows:
        w = t.split()
        grams[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in grams}
    for a, b in itertools.combinations(sorted(grams), 2):
        if grams[a] == grams[b] or len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return sorted(set(root.values()))


def test_stage_catches_near_copies_of_similarity_from_0_8(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    rows = []
    for k in range(60):
        words = [f"g{k}w{i}" for i in range(150)]
        rows.append((10 * k, " ".join(words)))
        for j, edits in enumerate((1, 2, 3), 1):  # similarity of about 0.93, 0.87 and 0.82
            copy = words[:]
            for at in rng.sample(range(5, 145), edits):
                copy[at] = f"e{rng.random()}"
            rows.append((10 * k + j, " ".join(copy)))
        rows.append((10 * k + 9, " ".join(words[:75]) + " " + " ".join(f"o{k}w{i}" for i in range(75))))
    kept = pipeline.keep_one_of_near_duplicates(spark, table(spark, rows), "")
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == similar_brute(rows)


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(5, one), (1, one), (5, two), (5, two), (None, two), (None, three), (None, three), (7, None), (8, ""), (5, three + " end")]
    kept = near_dedup.drop_similar(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (5, two), (5, three + " end"), (7, None)])
    assert near_dedup.drop_similar(table(spark, [])).count() == 0
    # a cloud whose members are linked through others only
    words = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join([f"n{k}" for k in range(3 * i)] + words[3 * i :])) for i in range(30)]
    kept = near_dedup.drop_similar(table(spark, chain)).collect()
    assert [r.doc_id for r in kept] == similar_brute(chain) == [0]


@pytest.mark.parametrize(("small", "block"), [(1, 1000), (1, 3), (3, 5)])
def test_blocks_of_buckets_lose_no_link(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(160)]
    cloud = []
    for i in range(30):  # some are similar to each other, most are just below
        copy = words[:]
        for at in rng.sample(range(160), rng.choice((1, 2, 4))):
            copy[at] = f"e{rng.random()}"
        cloud.append((i, " ".join(copy)))
    chain = [(100 + i, " ".join([f"n{k}" for k in range(3 * i)] + [f"c{k}" for k in range(3 * i, 200)])) for i in range(20)]
    rows = cloud + chain + [(200 + i, " ".join(f"s{i}x{k}" for k in range(30))) for i in range(5)]
    kept = near_dedup.drop_similar(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == similar_brute(rows)


def test_stage_searches_by_deletion_variants(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(f"o{k}x{i}" for i in range(50))) for k in range(5)]
    rows += [(100 + i, " ".join([*words[:-i], f"e{i}"] if i else words)) for i in range(6)]
    docs = table(spark, rows)
    banded = near_dedup.banded(docs, 5)
    nodes = banded.groupBy("node").agg(F.min(F.struct("doc_id", "print")).alias("doc"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    prints = {r.node: r.fp for r in nodes.collect()}
    near = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 4}
    pairs = {(r.a, r.b) for r in near_dedup.fingerprint_pairs(nodes).collect()}
    assert pairs and pairs <= near and union_find(pairs) == union_find(near)
    # without any band, the fingerprints alone link what they are near enough for
    alone = near_dedup.similar(nodes.withColumn("keys", F.expr("cast(array() as array<bigint>)")), docs, 5, 0.8)
    assert {r.node for r in alone.collect()} == {n for pair in near for n in pair}
    # a minimum that differs in each band leaves one variant of each
    least = near_dedup.minima(np.array([rng.getrandbits(64) for _ in range(50)], np.uint64))
    other = least.copy()
    other[: near_dedup.KEYS : near_dedup.ROWS] ^= np.uint64(1)
    assert len(set(near_dedup.band_keys(least)) & set(near_dedup.band_keys(other))) == near_dedup.BANDS


def shuffled_since(spark, first=0):
    """Bytes of the files of shuffles from the number first on that are on this machine's disk, and the number of the next shuffle."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = [(int(p.name.split("_")[1]), p) for top in manager.localDirsString() for p in pathlib.Path(top).rglob("shuffle_*.data")]
    return sum(p.stat().st_size for k, p in found if k >= first and p.exists()), max((k for k, _ in found), default=-1) + 1


def test_near_duplicates_keep_no_shuffle_files_of_earlier_steps(spark, monkeypatch):
    rng = random.Random(33)
    rows = [(k, " ".join(f"o{rng.random()}" for _ in range(30))) for k in range(400)]
    _, first = shuffled_since(spark)
    index = len(rows) * near_dedup.KEYS * 16  # each shuffle of the bands' index writes as many bytes, if not more
    left = []

    def components_of(links, whole=near_dedup.components):
        deadline = time.time() + 20  # files are deleted in the background
        while (now := shuffled_since(spark, first)[0]) > index and time.time() < deadline:
            time.sleep(0.2)
        left.append(now)
        return whole(links)

    monkeypatch.setattr(near_dedup, "components", components_of)
    assert near_dedup.drop_similar(table(spark, rows)).count() == len(rows)
    assert left and max(left) <= index


def union_find(pairs):
    """The components of the pairs, as a set of sets."""
    root = {x: {x} for pair in pairs for x in pair}
    for a, b in pairs:
        if root[a] is not root[b]:
            root[a] |= root[b]
            for x in root[b]:
                root[x] = root[a]
    return {frozenset(x) for x in root.values()}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(4)
    fill = [f"{a}{b}{c}" for a in ("ta", "mi", "ro", "len") for b in ("su", "ki", "vor", "na") for c in ("pe", "lo", "dam", "gi")]
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(fill) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(60), rng.choice(["grumfel" + rng.choice(fill), "blarg"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    docs = table(spark, rows)
    grammar = toxicity.train(docs, labels(spark, marks))
    learned = set(grammar.lexicon) - set(toxicity.INSULTS)
    assert "blarg" in learned and any(w.startswith("grumfel") and w.endswith("*") for w in learned) and len(learned) <= 4
    got = {r.doc_id: r for r in toxicity.score_documents(docs, grammar).collect()}
    wrong = [i for i, _, t in marks if got[i].predicted != t]
    assert not wrong and any(r.held_out for r in got.values())
    assert {r.doc_id for r in toxicity.drop_toxic(docs, grammar).collect()} == {i for i, _, t in marks if not t}
    assert toxicity.drop_toxic(docs, grammar).columns == docs.columns


def test_toxicity_learns_stems_that_clean_texts_have_by_chance(spark):
    rng = random.Random(14)
    parts = ["ta", "mi", "ro", "len", "su", "ki", "vor", "na", "pe", "lo", "dam", "gi"]
    rows, marks, wrong = [], [], set()
    for i in range(1200):
        words = ["".join(rng.choice(parts) for _ in range(rng.choice((2, 3)))) for _ in range(rng.choice((60, 150, 400)))]
        bad = i % 6 == 0
        # one word in 40 has the stem in toxic texts, one in 1,500 in others, by the same syllables
        words = [("grumfel" + rng.choice(parts) if rng.random() < (1 / 40 if bad else 1 / 1500) else w) for w in words]
        if bad:
            words[7::40] = ["grumfel" + rng.choice(parts) for _ in words[7::40]]
        ends = [w + "." if k % 9 == 8 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(ends)))
        noise = i % 50 == 0
        wrong |= {i} if noise else set()
        marks.append((i, 1, int(bad) ^ int(noise)))
    grammar = toxicity.train(table(spark, rows), labels(spark, marks))
    assert set(grammar.lexicon) - set(toxicity.INSULTS) == {"grumfel*"}
    got = {r.doc_id: r for r in toxicity.score_documents(table(spark, rows), grammar).collect()}
    right = [got[i].predicted == t for i, _, t in marks if i not in wrong]
    assert sum(right) >= 0.98 * len(right)


def test_forms_are_counted_in_small_parts():
    texts = ["x" * 100_000] * 40
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = list(common.parts(batch, toxicity.COUNT_BYTES))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows * 100_000 <= toxicity.COUNT_BYTES for b in got) and toxicity.COUNT_BYTES < common.PART_BYTES
    common.give_back()


def kinds(text):
    clauses = toxicity.Grammar().compile()
    return [found and found[0] for found in map(clauses.weigh, clauses.clauses(text.lower()))]


def test_toxicity_clauses():
    assert kinds("you are an idiot.") == ["targeted"]
    assert kinds("he is not an idiot") == kinds("he isn't an idiot") == ["negated"]
    assert kinds("the paper said that the minister wrote idiot") == ["reported"]
    assert kinds("idiotic. what an idiot") == [None, "insult"] and kinds("what an idiot's job") == ["insult"]
    assert kinds("i will kill you") == ["threat"] and kinds("to kill time") == [None]
    assert kinds("i said i will kill you") == kinds("i will not kill you") == [None]
    assert kinds("not here. idiot") == ["insult"] and kinds("not one two three idiot") == ["insult"]
    # one weight a clause, however often and however far apart its words are
    filler = "word " * 10_000
    assert kinds("idiot " * 5) == ["insult"] and kinds(f"you are, {filler} an idiot") == ["targeted"]
    assert kinds(f"she said that he is, {filler} an idiot {filler}") == ["reported"]
    clauses = toxicity.Grammar().compile()
    assert clauses.sums("idiot " * 5).tolist() == clauses.sums("idiot").tolist()


def test_toxicity_product_equals_its_parts():
    rng = random.Random(11)
    for _ in range(400):
        word = [rng.choice(toxicity.SYMBOLS[:6]) for _ in range(rng.randrange(12))]
        state, written = toxicity.PRODUCT.run(word)
        at, now = [], word
        for part in toxicity.PARTS:
            end, now = part.run(now)
            at.append(end)
        assert toxicity.STATES[state] == tuple(at) and written == now
    assert len(toxicity.STATES) <= 4 * 2 * 4 * 2 * 2


def clause_brute(grammar, clause):
    """The kind and weight of a clause, from the docstring's words."""
    symbols = [grammar.symbol(w[0]) for w in toxicity.WORDS.finditer(clause)]
    names = [s for s, _ in symbols]
    real, denied, quoted, threats = [], [], [], []
    for i, (s, w) in enumerate(symbols):
        no = toxicity.NEGATION in names[max(0, i - toxicity.SCOPE) : i]
        said = toxicity.REPORT in names[:i]
        if s == toxicity.INSULT:
            (denied if no else quoted if said else real).append(w)
        elif s == toxicity.THREAT and not no and not said:
            threats.append(w)
    target = toxicity.TARGET in names
    if real:
        return ("targeted" if target else "insult"), max(real)
    if threats and target:
        return "threat", max(threats)
    return ("negated", max(denied)) if denied else ("reported", max(quoted)) if quoted else None


def test_toxicity_scores_against_brute_force():
    rng = random.Random(12)
    made = toxicity.Grammar(lexicon=toxicity.INSULTS | {"grum*": 1.25, "grumf": 3.0, "blarg": 0.5, "ß*": 1.0}).compile()
    pool = ["idiot", "Idiot's", "you", "not", "isn’t", "said", "kill", "grumble", "grumf", "ablarg", "blarg", "tale", "İx", "ßen", "a1idiot", ".", "!", ";", "\n", ","]
    for _ in range(600):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        want = np.zeros(len(toxicity.KINDS))
        for clause in toxicity.CLAUSE_END.split(text.lower()):
            if found := clause_brute(made, clause):
                want[toxicity.KINDS.index(found[0])] += found[1]
        np.testing.assert_allclose(made.sums(text), np.log1p(want))


def test_toxicity_odd_tables(spark):
    clauses = toxicity.Grammar().compile()
    high, low = (clauses.score(clauses.sums(t)) for t in ("You idiot! You moron, you are worthless trash.", "he said it"))
    assert high > 0.7 > 0.3 > low
    odd = table(spark, [(None, None), (1, ""), (1, ""), (2, "You idiot! " * 100_000)])
    grammar = toxicity.train(odd, labels(spark, []))
    got = toxicity.score_documents(odd, grammar).collect()
    assert len(got) == 4 and [r.predicted for r in got] == [0, 0, 0, 1] and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(table(spark, []), grammar).count() == 0
    assert toxicity.train(table(spark, []), labels(spark, [(1, 1, 1)])).lexicon


def quality_brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "a a a a a", "é|ü <#> x\n\n é|ü\né|ü\x0bz", "x\ny\nx\n x\nx "]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(80))) + rng.choice(["", "\nab", "\n&&"]) * rng.randrange(4) for _ in range(80)]
    texts += [" ".join(rng.choice(["u", "v", "w%"]) for _ in range(30_000)), "same words here\n" * 4000]
    rows = list(enumerate(texts)) + [(0, None), (None, "a b c")]
    got = quality.quality_rules(table(spark, rows), labels(spark, [])).collect()
    assert len(got) == len(rows)
    for r in got:
        n = quality_brute(texts[r.doc_id] if r.doc_id is not None else "a b c")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r.kept == (not r.base_failed)
    assert quality.quality_rules(table(spark, []), labels(spark, [])).count() == 0


def test_quality_learns_thresholds(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(5000)}" + ("%%" if bad and rng.random() < 0.8 else "") for _ in range(rng.randrange(60, 90))]
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), 0))
    got = quality.quality_rules(table(spark, rows), labels(spark, marks[:200])).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got)
    assert quality.learn_rules({"n_words": np.arange(9.0)}, np.zeros(9, bool)) == []


def test_pipeline_stages_keep_columns_and_catch_plants(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    line = lambda k, n=70: " ".join(f"{k}x{rng.randrange(10**6)}" for _ in range(n))
    passage = line("passage")
    rows = [(i, f"{line(i)}\n{line(i)}", "en", f"src{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, f"{line(i)}\n{passage}", "en", "src0", 0) for i in range(5)]
    copied = line("copy", 30)
    rows += [(200 + i, copied, "en", "src1", 0) for i in range(4)]
    rows += [(300 + i, f"{line(i)} you idiot moron worthless trash clown", "en", "src2", 0) for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(0, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"o{k}"))
        now = spark.read.parquet(str(tmp_path / f"o{k}"))
        if k < 4:
            assert now.columns == docs.columns
        after[name] = now.collect()
    assert {r.doc_id for r in after["toxicity"]} == {r[0] for r in rows if r[0] < 300}
    assert sum(passage in r.text for r in after["line_dedup"]) == 1
    ids = sorted(r.doc_id for r in after["near_dedup"])
    assert ids == [*range(40), *range(100, 105), 200]
    assert {r.doc_id for r in after["source_mix"]} <= set(ids)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "packing"]
    total = pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0]
    assert total == sum(r.length for r in after["packing"])


CLASHING = ["mask", "cut", "lines", "full", "drop", "kept", "row", "number", "key", "dropped", "keep", "gone", "node", "print", "id", "p", "_lines", "_text", "_key", "_drop", "n", "u", "at", "doc"]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, tmp_path, k):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels(spark, [(1, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    texts = [(1, None), (2, ""), (2, ""), (3, long_line(1)), (3, long_line(1)), (4, "a\n" + long_line(1)), (None, "no id " + long_line(2)), (None, None), (5, " ".join(f"z{i}" for i in range(60_000)))]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *[f"{c}:{i}" for c in CLASHING]) for i, t in texts], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    name, stage = pipeline.STAGES[k]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = stage(spark, docs, str(tmp_path))
    rows = got.collect()
    if k < 4:
        assert got.columns == docs.columns
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "toxicity":
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t in texts)
    elif name == "line_dedup":
        assert {r.doc_id: r.text for r in rows if r.doc_id == 4} == {4: "a"} and ids == {1: 1, 2: 2, 3: 2, 4: 1, None: 2, 5: 1}
    elif name == "near_dedup":
        assert ids == {1: 1, 3: 1, None: 1, 5: 1}  # the line of 4 makes it a near copy of 3
    elif name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None}
