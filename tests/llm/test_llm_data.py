"""Tokenizers, packing, URL rules, chat formatting, mixing and search against brute force, and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annmatrix.llm import bpe, chat, mixing, packing, queries, token_counts, topk, url_filter
from annmatrix.llm.common import tokenizer_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PIECES = ["'s", "'ll", "'re ", "'v", " ", "  ", "\n", "\t\n", "the", " ing", "A", "é", "é", "ß", "中文", "١", "½", "12", "!?", "...", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "😀", "\x1c", "\x85", " ", "\x00", "’", "_", "ﬁ"]


@pytest.mark.parametrize("name", NAMES)
def test_tokens_equal_the_library(name):
    library = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    made = bpe.load(tokenizer_path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=30))
    def check(parts):
        text = "".join(parts)
        want = library.encode(text, add_special_tokens=False).ids
        counts, ids = made.encode([text, "", text], True)
        assert ids[0].tolist() == ids[2].tolist() == want and counts.tolist() == [len(want), 0, len(want)]

    check()


def test_tokens_of_many_special_strings():
    made = bpe.load(tokenizer_path(NAMES[0]))
    library = tokenizers.Tokenizer.from_file(tokenizer_path(NAMES[0]))
    text = "<|endoftext|>a" * 60_000
    counts, _ = made.encode([text], False)
    assert counts[0] == 120_000 == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", NAMES)
def test_tokens_of_long_texts_and_rebuilt_states(name, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(PIECES) for _ in range(30_000)) + "a" * 3000 + " " * 500
    library = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    monkeypatch.setattr(bpe, "BLOCK", 2000)
    monkeypatch.setattr(bpe, "MOST_STATES", 200)
    made = bpe.Tokenizer(tokenizer_path(name))
    counts, ids = made.encode(["x", text], True)
    assert ids[1].tolist() == library.encode(text, add_special_tokens=False).ids and counts[1] == len(ids[1])


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "z") for i, t in rows], "doc_id long, text string, n_tokens string, piece int, vector string")


def test_token_counts_of_odd_tables(spark):
    rows = [(1, None), (None, ""), (2, "Hello world"), (2, "Hello world"), (3, "word " * 2000)]
    got = sorted(tuple(r) for r in token_counts.count_tokens(documents(spark, rows)).fillna(-1, ["doc_id"]).collect())
    assert got == [(-1, 0, 0, False), (1, 0, 0, False), (2, 11, 2, False), (2, 11, 2, False), (3, 10000, 2001, True)]
    assert token_counts.count_tokens(documents(spark, [])).count() == 0


def pieces_brute(rows, capacity):
    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), capacity):
            out.append((i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())))
    return out


def test_packing_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["tall", "blue", "running", "ox"]) for _ in range(rng.randrange(90)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 700), (5, rows[5][1])]
    got = packing.pack(documents(spark, rows).repartition(12), capacity=128).toPandas()
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(pieces_brute(rows, 128))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 128
    assert got["sequence_id"].nunique() <= 1.02 * math.ceil(got["length"].sum() / 128) + 1
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_goes_on_as_long_as_it_merges(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    rows = [(i, "ox " * (99 if i % 2 else 26)) for i in range(160)]
    got = packing.pack(documents(spark, rows).repartition(40), capacity=128).toPandas()
    assert got["sequence_id"].nunique() <= 90


def test_packing_items_that_never_fit_together(spark):
    rows = [(i, "ox " * 69) for i in range(60)]
    got = packing.pack(documents(spark, rows).repartition(20), capacity=128).toPandas()
    assert got["sequence_id"].nunique() == 60 and (got["length"] == 70).all()


def test_best_fit():
    assert sorted(map(sorted, packing.best_fit([6, 4, 5, 5, 1], 10))) == [[0, 1], [2, 3], [4]]
    assert packing.best_fit([], 10) == []


URLS = [
    "https://a.example.net/en/1?x#y", "http://example.net/en/", "http://example.net/en", "HTTP://EXAMPLE.NET/de/", "http://x.example.com/de/a", "http://example.com/fr/", "http://b.org/fr/2",
    "http://org/fr/", "http://net", "http://net/", "http://notexample.com/de/", "http://myexample.net.evil.com/en/", "ftp://u@h.net:80/p;q", "no scheme/net/", "", None, "://net/", "http://net?/x", "http://É.NET/é",
    "http://a..net//", "https://q.example.net/en/" + "s" * 100_000,
]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in rows], "page_id long, url string, host string, rule string, verdict string")
    want = sorted(((i if i is not None else -1), *[x or "" for x in verdict(u)]) for i, u in rows)
    for bound in (50_000, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
        got = url_filter.filter_urls(pages, url_filter.RULES).collect()
        assert sorted(((r.page_id if r.page_id is not None else -1), r.host, r.path, r.rule or "", r.verdict) for r in got) == want
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], default="block").collect()} == {"block"}
    quoted = url_filter.filter_urls(pages, [("block", "a.example.net", "/en/1"), ("allow", "x'y\\", "/")]).where("rule is not null").collect()
    assert [r.page_id for r in quoted if r.page_id is not None] == [0]


def test_chat_round_trip(spark):
    nasty = ["", chat.PROBE, "<turn user>\nx</turn>\n", "\\", "\\\\l\\s\\g", "a\\l<b>\\", "</turn>\n</turn>\n", "é😀" * 10, "<image 1.1>", "x" * 200_000]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(50, 1, "assistant", None), (50, None, None, "first"), (51, 0, "as<s>\\", "odd role"), (51, 0, "as<s>\\", "odd role"), (None, 0, "user", "no id")]
    table = spark.createDataFrame([(*r, "f", "t") for r in rows], "conv_id long, turn long, role string, text string, formatted string, start string")
    back = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(table)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1]))
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2] or "", r[3] or "") for r in turns]
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert back[c].loss_text == said
    got = {r.conv_id: r for r in chat.digests(table).collect()}
    one = [r for r in rows if r[0] == 3]
    assert got[3].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in one).encode()).hexdigest()
    assert got[3].loss_chars == sum(len(r[3]) for r in one if r[2] == "assistant")
    assert chat.digests(table.limit(0)).count() == 0


def test_chat_typed_parts(spark):
    parts = [("text", "see <this>", None), ("image", None, "a.png"), ("text", "\\and", None), ("audio", None, "b.wav"), ("hologram", None, "c"), (None, "plain", None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "fine", None), ("document", None, "d.pdf")]), (1, 2, "user", None)], "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string>>")
    r = chat.format_conversations(rows, parts_col="content").first()
    assert r.formatted == "<turn user>\nsee \\lthis\\g<image 1.2>\\sand<audio 1.4><hologram 1.5>plain</turn>\n<turn assistant>\nfine<document 2.2></turn>\n<turn user>\n</turn>\n"
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, 2, "image", "a.png", 576), (1, 4, "audio", "b.wav", 250), (1, 5, "hologram", "c", 0), (2, 2, "document", "d.pdf", 1024)]
    assert r.expanded_tokens == 1850
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["fine<document 2.2>"]


def sources(spark, rows):
    return spark.createDataFrame([(i, f"t{i}", s, "c", 9) for i, s in rows], "doc_id long, text string, source string, copy string, _n int")


def test_mixing_hits_the_weights_and_is_stable(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(20_000)] + [(20_000, None)]
    docs = sources(spark, rows)
    mixed = mixing.mix(docs, {"big": 1.0, "small": 1.0})
    counts = {r[0]: r[1] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] - 10_000) < 400 and abs(counts["small"] - 10_000) < 400 and None not in counts
    per = mixed.where("source = 'small'").groupBy("doc_id").count().toPandas()["count"]
    assert abs(per.var() + (2000 - len(per)) / 2000 * per.mean() - 5) < 2  # as much spread as a Poisson of mean 5
    again = mixing.mix(docs.repartition(13), {"big": 1.0, "small": 1.0})
    assert mixed.exceptAll(again).isEmpty() and again.exceptAll(mixed).isEmpty()
    assert mixed.columns == ["doc_id", "text", "source", "_n", "copy"]
    ids = [r.doc_id for r in mixed.select("doc_id").limit(50).collect()]
    assert ids != sorted(ids)


def test_mixing_odd_tables(spark):
    assert mixing.mix(sources(spark, [])).count() == 0
    odd = mixing.mix(sources(spark, [(None, None), (1, None), (1, None)]), total=50.0)
    assert odd.groupBy("doc_id").count().count() == 2
    assert mixing.mix(sources(spark, [(1, "a'b"), (2, "b")]), {"a'b": 1.0}, total=5.0).select("source").distinct().count() == 1
    large = mixing.rates(sources(spark, [(1, "a")]), total=2000.0).first()
    assert large.draws == 4 and abs(large.cdf[-1] - 1) < 1e-9
    many = mixing.mix(sources(spark, [(i, "a") for i in range(300)]), total=1200.0).groupBy("doc_id").count().toPandas()["count"]
    assert abs(many.mean() - 1200) < 10 and 800 < many.var() < 1700  # a Poisson's variance is its mean


def test_mixing_keeps_clashing_columns(spark):
    names = ["_n", "_u", "_at", "_key", "_copy", "_source", "_cdf", "n", "u", "at", "key", "number", "known", "draws", "cdf", "row"]
    docs = spark.createDataFrame([(i, "a", *[f"{c}{i}" for c in names]) for i in range(40)], "doc_id long, source string, " + ", ".join(f"{c} string" for c in names))
    got = mixing.mix(docs, total=3.0, copy_col=None)
    assert got.columns == docs.columns and got.count() > 40
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, row string")


def search_brute(rows, k=5, every=50):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 37])
def test_search_against_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(float).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [0.5, 0.25]), (700, []), (None, [1.0] * 8)]
    rows += [(100, rows[100][1]), (7, rows[50][1])]
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4 if block == 37 else 4096)
    for pivots in (1, None):
        got = topk.top_k(vectors(spark, rows), pivots=pivots).collect()
        assert sorted(map(tuple, got)) == search_brute(rows)


def test_search_copies_only_what_is_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centers = np.eye(40)
    rows = [(i, (centers[i % 40 if i % 50 else i // 50 % 40] + rng.normal(size=40) * 0.01).tolist()) for i in range(4000)]
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    made = topk.plan(topk.saved(topk.quantize(vectors(spark, rows), 256.0, "vec_id", "embedding")), 5, 50, 300)
    blocks = made.queries.select("block").distinct().count()
    assert blocks >= 20 and made.data.count() < 0.15 * blocks * len(rows)
    pairs = made.queries.groupBy("block", "piece").count().join(made.data.groupBy("block", "piece").agg(F.count(F.lit(1)).alias("n")), ["block", "piece"]).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert pairs < 0.15 * 80 * len(rows)
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows)).collect())) == search_brute(rows)


def test_search_odd_tables(spark):
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(50, [1.0])])).count() == 0
    few = [(50, [1.0, 2.0]), (51, [2.0, 0.5]), (52, [-3e8, 1.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, few)).collect())) == search_brute(few)
    huge = [(50, [3e6, 1.0]), (51, [3e6, 0.5]), (52, [2e6, 1.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, huge)).collect())) == search_brute(huge)
    beyond = [(50, [1e30, 1.0]), (51, [1e30, 0.5]), (52, [-3e38, 1.0]), (53, [0.0, 2.0])]
    want = [(50, 1, 51, (1 << 63) - 1), (50, 2, 53, 256 * 512), (50, 3, 52, -(1 << 63))]
    assert sorted(map(tuple, topk.top_k(vectors(spark, beyond)).collect())) == want
    most = spark.createDataFrame([(50, [1.7e308]), (51, [1.7e308]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(most).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (51, (1 << 63) - 1)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    from test_contracts import compare

    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])


def test_queries_run_over_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert {f"op{i}" for i in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
    for q in ("op2_toxicity", "op5_token_counts"):
        assert queries.QUERIES[q](spark, sf_dir).count() == n
    assert queries.QUERIES["op10_best_fit_packing"](spark, sf_dir).select("doc_id").distinct().count() == n
    assert queries.QUERIES["op8_line_dedup"](spark, sf_dir).agg(F.count("text")).first()[0] <= n
