"""Ranked search, byte-level BPE and centroid clustering against plain versions and public libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, clusters, ranking
from tidemark.llm.text import as_bytes

# -- ranked search -----------------------------------------------------------


def naive_ranking(docs, items, k=10):
    """docs: (id, text) rows, items: id -> list of texts."""
    def terms(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(ranking.TERM, lower)

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, texts in items.items():
        found = []
        for place, (i, c) in enumerate(held):
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in {t for text in texts for t in terms(text)} if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, place))
        if found:
            out[item] = [(None if none else i, -s) for s, none, i, _ in sorted(found)[:k]]
    return out


def ranked(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, ts in items.items() for t in ts], "item_id long, text string, doc_id int")
    rows = ranking.rank_documents(frame, asked, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_ranking_equals_a_naive_one(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[9][1]), (5000, None), (5001, ""), (5002, " .,!")]
    docs += [(6000, "W1-w2_W3 é É naïve Éa ЖЖ жж 数据 w1\x00w2")]
    items = {i: [" ".join(rng.choices(words, k=12))] for i in range(20)}
    items |= {50: [docs[7][1], "É 数据 ЖЖ"], 51: [""], 52: ["nowhere"], 53: [None], 54: ["w1"], 55: ["É", "é W1"]}
    wanted = naive_ranking(docs, items)
    assert ranked(spark, docs, items) == wanted
    # Several groups of queries and other lengths of the result change nothing else.
    assert ranked(spark, docs, items, group_terms=40) == wanted
    assert ranked(spark, docs, items, k=1) == {i: rows[:1] for i, rows in wanted.items()}
    assert ranked(spark, docs, {}) == {} and ranked(spark, [], items) == {} and ranked(spark, [(1, None)], items) == {}


def test_accumulators_are_limited_and_scores_stay_exact():
    rng = np.random.default_rng(5)
    n_docs, df = 4000, np.array([3000, 2500, 30, 12, 1800])
    held = [np.sort(rng.choice(n_docs, n, replace=False)) for n in df]
    owner, term = np.concatenate(held), np.repeat(np.arange(5), df)
    impact = ranking.impacts(rng.integers(1, 9, len(owner)), rng.integers(20, 90, n_docs)[owner], n_docs, 55 * n_docs)
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    full = np.zeros(n_docs, np.int64)
    np.add.at(full, owner, weight[term] * impact)
    best = np.lexsort((np.arange(n_docs), -full))[:10]
    for parts in (1, 4):
        ranker = ranking.Ranker([np.arange(5)], df, weight, 10)
        for part in range(parts):
            here = owner % parts == part
            ids = np.arange(part, n_docs, parts)
            ranker.add(ids, np.zeros(len(ids), bool), owner[here] // parts, term[here], impact[here])
        scores, ids, _ = ranker.best[0]
        assert ids.tolist() == best.tolist() and scores.tolist() == full[best].tolist()
        assert 6 * ranker.created < np.count_nonzero(full)


def test_terms_of_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["", "ab " * 300, "x" * 500, " ".join(rng.choices(["ab", "cd", "é", "zz9"], k=400)), "cd", "  "]
    asked = ranking.Terms.of([["ab", "é"], ["x" * 500, "zz9"]])
    data, offsets = as_bytes(pa.array(texts, pa.large_string()))
    whole = ranking.count_terms(asked, data, offsets)
    monkeypatch.setattr(ranking.term_pieces, "__defaults__", (64,))
    for a, b in zip(whole, ranking.count_terms(asked, data, offsets), strict=True):
        assert a.tolist() == b.tolist()
    assert whole[0].tolist() == [0, 300, 1, 400, 1, 0]


# -- byte-level BPE ------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def own_ids(tokenizer, texts):
    import pyarrow as pa
    import regex
    ids, counts = tokenizer.encode_block(texts, as_bytes(pa.array(texts, pa.large_string()))[0], bpe.Merged(tokenizer.ranks),
                                         regex.compile(tokenizer.pattern).findall)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


TEXTS = ["", " ", "\n\n  \t x", "I'll we've don't 'S it's", "naïve café – 数据处理 жизнь 🙂🏽 नमस्ते", "a" * 3000, "ab" * 700 + " 1234567890" * 9,
         "<|endoftext|> <|startoftext|>", "   x 　y", "q7Rk2ZpX9vLm4TtB8wYc1NdF" * 5, "\x00\x01\x7f", "zażółć gęślą jaźń",
         "\U00032407\U00032427's a\U0003d027s ՘'s", "é" * 200, "supercalifragilisticexpialidocious antidisestablishmentarianism"]


def test_ids_equal_the_public_library(tokenizer, library):
    assert own_ids(tokenizer, TEXTS) == [library.encode_ordinary(t) for t in TEXTS]
    for a, b in bpe.NEWER:
        for c in (a, b):
            text = f"{chr(c)}'s a{chr(c)}a 1{chr(c)}1 {chr(c)}"
            assert own_ids(tokenizer, [text, "x"])[0] == library.encode_ordinary(text), hex(c)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(st.sampled_from("ab '\n1é🙂stlve"), max_size=60)), min_size=1, max_size=5))
def test_any_text_equals_the_public_library(tokenizer, library, texts):
    assert own_ids(tokenizer, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_token_has_a_slot_of_its_own(tokenizer):
    slots = np.sort(tokenizer.ids)
    assert len(slots) == tokenizer.hash.slots == len(tokenizer.ranks) and len(np.unique(slots)) == len(slots)
    for keys in (np.arange(1, 2, dtype=np.uint64), np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64)):
        assert sorted(bpe.PerfectHash(keys).slot(keys).tolist()) == list(range(len(keys)))


def test_merging_finds_the_lowest_rank_leftmost(tokenizer):
    def plain(piece):
        parts = [piece[i: i + 1] for i in range(len(piece))]
        while True:
            ranks = [(tokenizer.ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == 10**9:
                return [tokenizer.ranks[p] for p in parts]
            i = min(ranks)[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choices(b"aab tionesr\xc3\xa9", k=rng.randrange(1, 40)))
        assert bpe.merge(piece, tokenizer.ranks) == plain(piece)


def test_round_trip_in_spark(spark, tokenizer, library):
    texts = [None, *TEXTS, *TEXTS, "word " * 40_000]
    frame = spark.createDataFrame([(i, t, "old", None) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    frame = frame.repartition(2)
    encoded = bpe.encode_texts(frame, tokenizer)
    assert encoded.columns == ["doc_id", "text", "decoded", "ids"]
    rows = bpe.decode_ids(encoded, tokenizer).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.encode_texts(frame.limit(0), tokenizer).count() == 0 and bpe.decode_ids(encoded.limit(0), tokenizer).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 64, None]), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode_ids(odd, tokenizer).orderBy("doc_id").collect()] == [
        b"", tokenizer.decode(np.array([64]))[0].tobytes(), b""]
    with pytest.raises(ValueError):
        tokenizer.decode(np.array([60_000]))


# -- clustering ----------------------------------------------------------------

def naive_clusters(rows, k, rounds, seed=3):
    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p)), i) for i, p in enumerate(points))

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    points = [v for _, v in first]
    for _ in range(rounds):
        groups = [[] for _ in points]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        points = [[sum(c) // len(g) for c in zip(*g)] if g else p for g, p in zip(groups, points)]
    return Counter((i, *reversed(nearest(v))) for i, v in kept), points


def clustered(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster int, id string")
    assigned, table = clusters.cluster_vectors(frame.repartition(3), **options)
    assert assigned.columns == ["vec_id", "cluster", "distance"]
    table = {r["cluster"]: r for r in table.collect()}
    found = Counter(tuple(r) for r in assigned.collect())
    for c, r in table.items():
        assert r["n"] == sum(n for key, n in found.items() if key[1] == c)
        assert r["cluster_inertia"] == sum(n * key[2] for key, n in found.items() if key[1] == c)
        assert r["inertia"] == sum(n * key[2] for key, n in found.items())
    return found, [table[c]["centroid"] for c in sorted(table)]


@pytest.mark.parametrize("k,rounds", [(1, 2), (3, 0), (6, 4), (40, 3)])
def test_clusters_equal_a_naive_version(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0]) + rng.choice([0, 0, 0.1]) for _ in range(3)]) for i in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [rows[5]] * 40 + [(None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (3, [0.0, 0.0, 0.0])]
    broken = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 1.0, 1.0]), (905, [1.0, float("inf"), 1.0])]
    assert clustered(spark, rows + broken, clusters=k, rounds=rounds, dims=3) == naive_clusters(rows, k, rounds)


def test_few_or_no_vectors(spark):
    assert clustered(spark, [(1, [0.5])], dims=1) == (Counter({(1, 0, 0): 1}), [[512]])
    assert clustered(spark, [(1, None)], dims=1) == (Counter(), [])
    assert clustered(spark, [], dims=4) == (Counter(), [])
    equal = [(i, [0.25, 0.5]) for i in range(20)]
    assert clustered(spark, equal, dims=2)[0] == Counter({(i, 0, 0): 1 for i in range(20)})


def test_long_vectors_stay_exact_or_are_an_error(spark):
    far = 2.0 ** 17  # 2**27 in scaled components
    rows = [(i, [far * (i % 3 - 1), far * (i % 2), float(i)]) for i in range(12)]
    assert clustered(spark, rows, clusters=4, rounds=3, dims=3) == naive_clusters(rows, 4, 3)
    with pytest.raises(Exception, match="too long"):
        clustered(spark, [(1, [1e30, 0.0, 0.0])], dims=3)


def test_orchard_measures_fewer_centroids_and_breaks_ties_by_number():
    rng = np.random.default_rng(9)
    points = rng.integers(-50, 50, (300, 2)) * 20
    points[[7, 90, 200]] = points[3]
    x = np.concatenate((rng.integers(-1000, 1000, (2000, 2)), points, (points[:-1] + points[1:]) // 2))
    search = clusters.Orchard(points)
    best, distance = search.nearest(x)
    every = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()
    assert search.measured < 0.5 * every.size
