"""Language identification, toxicity, near-copies and benchmark leaks on small cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, leaks, nearcopies, toxicity
from tidemark.llm.text import BLOCK_BYTES, as_bytes, run_hashes, runs, text_blocks

EDGES = [None, "", " ", "\n\n", "123 456 !!", "word", "a b c d", "x" * 300_000, "é " * 3000]


def frame_of(spark, texts):
    rows = [(i, t, "en", "s", 3.5, 9, [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, predicted int, leaks array<int>")


# -- arrays of text --------------------------------------------------------

def test_blocks_cover_every_row_once():
    texts = ["a" * n for n in (0, 5, BLOCK_BYTES, 3, 2 * BLOCK_BYTES, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    seen = [x for first, end, part in text_blocks(batch, "t") for x in part.to_pylist()]
    assert seen == [t or "" for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    texts = pa.array(["alpha beta", "", "xx alpha", "beta\talphabet"], pa.large_string())
    data, offsets = as_bytes(texts)
    starts, ends, owner = runs(data != 0x20, offsets)
    words = [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
    assert words == ["alpha", "beta", "xx", "alpha", "beta\talphabet"] and owner.tolist() == [0, 0, 2, 2, 3]
    hashes = run_hashes(data, starts, ends)
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4


# -- language --------------------------------------------------------------

ALPHABETS = {"aa": "bcdfga", "bb": "lmnopa", "cc": "rstuvé"}


def sentence(rng, lang, words=60):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(words))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    rows = rng.integers(60, 130, (3, 9)).astype(np.uint8)
    labels = np.array([0, 1, 1])
    def make(dtype):
        r = np.random.default_rng(2)
        f = lambda *s: (r.normal(size=s) / 3).astype(dtype)
        table = f(3, 512, 4)
        table[:2] += 0.5
        return language.LanguageModel(["a", "b"], table, 0.3 * f(3, 2, 4, 4), f(2, 4, 2), f(2))
    model = make(np.float32)
    def loss():
        raised, sums = language._exponentials(language._run(model, rows))
        mask = language._LETTER[rows].T
        picked = np.log((raised / sums[..., None])[:, np.arange(3), labels])
        return -float((picked * mask).sum() / mask.sum())
    grads = language._gradients(model, rows, labels)
    for weights, grad in zip(model.weights(), grads, strict=True):
        flat, size = weights.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(size))[:3]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(size[i], rel=0.08, abs=2e-4)


def test_windows_cover_whole_texts():
    texts = pa.array(["", "a" * 128, "b" * 129, "c"], pa.large_string())
    rows, owner = language.windows_of(*as_bytes(texts))
    assert owner.tolist() == [1, 2, 2, 3] and (rows > 0).sum(axis=1).tolist() == [128, 128, 1, 1]


def test_languages_are_learned_and_edges_defined(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame(rows + [(900, None, "aa"), (901, "x y", None)], "doc_id long, text string, lang string")
    model = language.fit_languages(train, docs_per_language=40, epochs=4, least_steps=30)
    assert model.languages == ["aa", "bb", "cc"]
    again = language.fit_languages(train.repartition(3), docs_per_language=40, epochs=4, least_steps=30)
    assert all(np.array_equal(a, b) for a, b in zip(model.weights(), again.weights(), strict=True))
    fresh = [(lang, sentence(rng, lang, 200)) for lang in ["aa", "bb", "cc"] * 10]
    texts = [t for _, t in fresh] + EDGES + [sentence(rng, "aa", 10) + " " + sentence(rng, "bb", 3000)]
    found = language.predict_languages(frame_of(spark, texts), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found[:30]] == [lang for lang, _ in fresh]
    assert [r["lang_pred"] for r in found[30:35]] == ["und"] * 5 and all(r["score"] == 0 for r in found[30:35])
    assert found[-1]["lang_pred"] == "bb"  # the whole text counts, not its beginning
    assert all(0 <= r["score"] <= 1 for r in found) and found[0]["predicted"] == 9
    none = language.fit_languages(train.limit(0))
    assert [r["lang_pred"] for r in language.predict_languages(frame_of(spark, ["abc"]), none, keep=["doc_id"]).collect()] == ["und"]
    assert language.predict_languages(frame_of(spark, ["a"]).limit(0), model).count() == 0


def test_copies_do_not_crowd_out_other_texts(spark):
    rng = random.Random(6)
    copy = sentence(rng, "aa")
    rows = [(copy, "aa")] * 400 + [(sentence(rng, lang), lang) for lang in ["aa", "bb"] * 30]
    given, train = [], language.train
    frame = spark.createDataFrame(rows, "text string, lang string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "train", lambda x, y, names, **options: given.append(y) or train(x, y, names, **options))
        model = language.fit_languages(frame, docs_per_language=25, least_steps=40)
    assert Counter(given[0].tolist()) == {0: 50, 1: 50}  # two windows of each text
    # Repeated rows are predicted alike, and equally likely languages go to the first.
    found = language.predict_languages(frame, model).select("text", "lang_pred", "score").distinct()
    assert found.count() == 61
    even = language.LanguageModel(["a", "b"], *(np.zeros_like(w) for w in model.weights()))
    assert language.predict_languages(frame.limit(3), even).select("lang_pred").distinct().collect()[0][0] == "a"


def test_few_rows_are_trained_as_long_as_many():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 100, (40, 16)).astype(np.uint8)
    rows[20:] += 10
    model = language.train(rows, np.repeat([0, 1], 20), ["a", "b"], least_steps=60)
    chances = language.document_probabilities(model, rows.reshape(-1), np.arange(0, 641, 16))
    assert (chances.argmax(axis=1) == np.repeat([0, 1], 20)).all() and chances.max(axis=1).mean() > 0.9


# -- toxicity --------------------------------------------------------------

def test_every_label_is_learned(spark, monkeypatch):
    rows = [(f"{name} {i} words", f"l{name:03d}") for name in range(300) for i in range(1 + name % 3)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    given, train = [], language.train
    monkeypatch.setattr(language, "train", lambda x, y, names, **options: given.append(y) or train(x, y, names, **options))
    model = language.fit_languages(frame, epochs=1, least_steps=1)
    assert model.languages == [f"l{name:03d}" for name in range(300)]
    assert Counter(given[0].tolist()) == {name: 1 + name % 3 for name in range(300)}
    assert language.predict_languages(frame, model).where("lang_pred = 'und'").count() == 0


def toxic_rows(rng, n):
    plain, bad = [f"word{i}" for i in range(40)], ["vileness", "hateful", "scummy"]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        words = rng.choices(plain, k=12) + (rng.choices(bad, k=2) if label else [])
        # The data are biased: toxic texts mention one group far more often.
        if rng.random() < (0.8 if label else 0.1):
            words.append("muslim")
        elif rng.random() < 0.3:
            words.append(rng.choice(["christian", "hindu", "jewish"]))
        rows.append((i, " ".join(words) if i % 7 else " ".join(words).upper(), label))
    return rows


def test_identity_terms_lose_their_pull(spark):
    rows = toxic_rows(random.Random(6), 600)
    frame = spark.createDataFrame(rows + [(9000, None, 0), (9001, "x", None)], "doc_id long, text string, label int")
    probes = pa.array([f"word1 word2 {g} word3" for g in ("muslim", "christian", "hindu")], pa.large_string())
    free, fair = (toxicity.fit_toxicity(frame, fairness=f) for f in (0.0, 50.0))
    assert 200 < fair.pairs == free.pairs
    spread = [np.ptp(toxicity.score_texts(probes, m)) for m in (free, fair)]
    assert spread[1] < 0.35 * spread[0]
    fresh = toxic_rows(random.Random(7), 300)
    scored = toxicity.score_toxicity(frame_of(spark, [t for _, t, _ in fresh] + EDGES), fair).orderBy("doc_id").collect()
    right = [r["predicted"] == label for r, (_, _, label) in zip(scored, fresh, strict=False)]
    assert np.mean(right) > 0.95
    assert len(scored) == 300 + len(EDGES) and all(0 <= r["score"] <= 1 for r in scored)
    assert scored[300]["score"] == scored[301]["score"] and scored[0]["leaks"] == [1]


def test_toxicity_without_both_labels(spark):
    one = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, label int")
    assert toxicity.score_toxicity(frame_of(spark, ["a"]), toxicity.fit_toxicity(one)).first()["predicted"] == 0
    assert toxicity.score_toxicity(frame_of(spark, ["a"]), toxicity.fit_toxicity(one.limit(0))).first()["score"] == 0.5
    assert toxicity.score_toxicity(frame_of(spark, ["a"]).limit(0), toxicity.fit_toxicity(one)).count() == 0


def test_terms_of_other_languages_and_repeated_rows(spark):
    rng = random.Random(11)
    rows = [(i, t.replace("muslim", "juif").replace("MUSLIM", "JUIF").replace("christian", "chrétien").replace("hindu", "hindou"), y)
            for i, t, y in toxic_rows(rng, 500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    probes = pa.array([f"word1 word2 {g} word3" for g in ("juif", "chrétien", "hindou", "musulman")], pa.large_string())
    free, fair = (toxicity.fit_toxicity(frame, fairness=f) for f in (0.0, 50.0))
    assert fair.pairs > 150 and np.ptp(toxicity.score_texts(probes, fair)) < 0.35 * np.ptp(toxicity.score_texts(probes, free))
    none = toxicity.fit_toxicity(frame, identity_terms={})
    assert none.pairs == 0
    # A group of copies is learned once, so it does not outweigh the others.
    copies = frame.unionByName(spark.createDataFrame([(9999, rows[0][1], rows[0][2])] * 400, frame.schema))
    again = toxicity.fit_toxicity(copies, fairness=50.0)
    assert again.pairs == fair.pairs
    scored = toxicity.score_toxicity(copies.withColumn("score", F.lit("x")), again).where("doc_id = 9999")
    assert scored.select("score", "predicted").distinct().count() == 1 and scored.count() == 400


def test_toxicity_query_learns_and_spares_neutral_mentions(spark, tmp_path):
    """The registered query on a table with terms: quality on held-out rows, neutral mentions stay clean."""
    from tidemark.llm import queries
    rows = toxic_rows(random.Random(12), 900)
    neutral = [(5000 + i, f"word{i % 40} word{i % 7} muslim word{i % 11} word{i % 13}") for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + neutral, "doc_id long, text string")
    docs.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["doc_id"]: r for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) + 40
    held = [(found[i]["predicted"], y) for i, _, y in rows if found[i]["held_out"]]
    assert len(held) > 200 and np.mean([p == y for p, y in held]) > 0.95
    assert sum(p for p, y in held if not y) <= 0.02 * len(held) and all(found[5000 + i]["predicted"] == 0 for i in range(40))


# -- near-copies -----------------------------------------------------------

def weighted_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def probability_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a if i in b)


def naive_classes(texts, threshold=0.8):
    sets = [weighted_shingles(t) for t in texts]
    root = list(range(len(texts)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and probability_jaccard(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similarity_is_the_exact_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (dict(zip(rng.choice(40, 25, replace=False).tolist(), rng.integers(1, 5, 25).tolist(), strict=True)) for _ in "ab")
        pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)]))
        want = probability_jaccard(Counter(a), Counter(b))
        assert nearcopies.similarity(pack(a), pack(b)) == pytest.approx(want)
        values = np.concatenate([pack(a)[0], pack(b)[0]])
        seen = nearcopies.signatures(np.repeat([0, 1], 25), nearcopies.mix(values), np.concatenate([pack(a)[1], pack(b)[1]]), 2, 4000)
        assert (seen[0] == seen[1]).mean() == pytest.approx(want, abs=0.05)


def test_classes_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = list(EDGES) + ["a b c d", "word"]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(copy))
    texts += [texts[-1]] * 5 + ["spam " * 300, "spam " * 280, "spam  spam\n" * 140]
    want = naive_classes(texts)
    frame = frame_of(spark, texts)
    found = {r["doc_id"]: (r["class_id"], r["class_docs"]) for r in nearcopies.near_classes(frame.repartition(4)).collect()}
    size = Counter(want)
    assert found == {i: (c, size[c]) for i, c in enumerate(want)}
    kept = nearcopies.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("share, rows", [(2000, 500), (5, 3)])
def test_components_with_hot_nodes(spark, monkeypatch, share, rows):
    """Two stars, one around its largest node, a long path and loose pairs, with and without dealing out."""
    monkeypatch.setattr(nearcopies, "HOT_SHARE", share)
    monkeypatch.setattr(nearcopies, "HOT_ROWS", rows)
    from tidemark.llm.scratch import Scratch
    edges = [(1, i) for i in range(2, 90)] + [(500, i) for i in range(300, 400)] + [(i, i + 1) for i in range(600, 640)]
    edges += [(89, 300), (700, 701), (702, 702), (701, 700)]
    name = lambda i: i.to_bytes(3, "big")
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "leader binary, node binary").repartition(4)
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {name(i): name(find(i)) for i in root if i != 702}
    got = {bytes(r["node"]): bytes(r["label"]) for r in nearcopies.components(frame, Scratch(spark, "test")).collect()}
    assert got == want


def test_a_chain_of_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:i * 3] + [f"n{k}" for k in range(i * 3)] + words[i * 3:]) for i in range(8)]
    texts = [" ".join([f"c{j}" for j in range(i * 4)] + words[i * 4:]) for i in range(14)]
    assert {r["class_id"] for r in nearcopies.near_classes(frame_of(spark, texts)).collect()} == set(naive_classes(texts)) == {0}


def test_a_bucket_of_few_long_texts(spark, monkeypatch):
    # 2.4 MB each, so the bucket has two blocks; the hash leaves one of them empty.
    rng = random.Random(1)
    base = [f"{rng.randrange(10 ** 9):09d}" for _ in range(240_000)]
    texts = []
    for _ in range(3):
        changed = list(base)
        for i in range(0, len(base), 20):
            changed[i] = f"{rng.randrange(10 ** 9):09d}"
            base[i] = f"{rng.randrange(10 ** 9):09d}"
        texts.append(" ".join(changed))
    monkeypatch.setattr(nearcopies, "_band_rows", lambda frame: frame.select("node", F.lit(1).cast("long").alias("bucket")))
    shared = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in ((shared[0], shared[1]), (shared[0], shared[2]), (shared[1], shared[2]))]
    assert all(0.55 < x < 0.65 for x in alike)
    for threshold, classes in ((0.8, 3), (0.5, 1)):
        found = nearcopies.near_classes(frame_of(spark, texts), threshold=threshold).collect()
        assert len(found) == 3 and len({r["class_id"] for r in found}) == classes


def test_texts_of_a_joined_class_are_not_compared_again(monkeypatch):
    """Variants of two texts, each a class of its own at first: exact comparisons grow with the links, not with the pairs."""
    rng = random.Random(4)
    bases = [[f"{k}{i}" for i in range(60)] for k in "ab"]
    texts = []
    for i in range(120):
        words = bases[i % 2] * (1 + i % 3)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 9)}"
        texts.append(" ".join(words))
    sets = nearcopies._sets(pa.array(texts, pa.large_string()))
    labels = [i.to_bytes(2, "big") for i in range(len(texts))]
    exact, calls = nearcopies.similarity, []
    monkeypatch.setattr(nearcopies, "similarity", lambda a, b: calls.append(1) or exact(a, b))
    block = nearcopies._Block([(label, i > 0, *own) for i, (label, own) in enumerate(zip(labels, sets, strict=True))])
    found = [(a, b) for b, own in zip(labels[1:], sets[1:], strict=True) for a in block.links(b, own, 0.8)]

    def classes(links):
        of = {label: label for label in labels}
        for a, b in links:
            of = {k: of[a] if v == of[b] else v for k, v in of.items()}
        return {frozenset(k for k in of if of[k] == v) for v in of.values()}

    near = [(labels[i], labels[j]) for i in range(len(texts)) for j in range(i) if exact(sets[i], sets[j]) >= 0.8]
    assert classes(found) == classes(near) and len(classes(near)) < 60
    assert len(found) == len(texts) - len(classes(near)) and len(calls) < 2 * len(texts) < len(near)
    for own in sets:  # no similar text is passed over
        likely = set(block.likely(own, np.ones(len(texts), bool), 0.8))
        assert {j for j, other in enumerate(sets) if exact(own, other) >= 0.8} <= likely


def test_near_copies_of_nothing_and_of_equal_rows(spark):
    assert nearcopies.near_classes(frame_of(spark, ["a"]).limit(0)).count() == 0
    same = frame_of(spark, ["one two three four five six"] * 4 + [None, None]).withColumn("doc_id", F.lit(5).cast("long"))
    assert nearcopies.keep_first(same).count() == 3
    nulls = same.withColumn("doc_id", F.lit(None).cast("long"))
    assert nearcopies.keep_first(nulls).count() == 3


# -- leaks -----------------------------------------------------------------

def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_equal_a_full_alignment():
    rng = random.Random(9)
    lower = leaks._lower_table()
    for _ in range(150):
        item = "".join(rng.choice("abcde fgh") for _ in range(rng.randrange(8, 110))).strip() or "abcdefgh"
        copy = list(item)
        for _ in range(rng.randrange(0, len(item) // 9 + 1)):
            at, how = rng.randrange(len(copy)), rng.random()
            if how < 0.4:
                copy[at] = rng.choice("xyz")
            elif how < 0.7 and len(copy) > 1:
                del copy[at]
            else:
                copy.insert(at, rng.choice("xyz"))
        text = "Some lead "[rng.randrange(10):] + "".join(copy).upper().replace(" ", " \n ") + " tail"[:rng.randrange(6)]
        index = leaks.index_items([("i", item)])
        plain = lambda t: "".join(map(chr, leaks.normalised([t], lower)[0]))
        found = leaks.find_leaks(["other", text, ""], index)
        if len(plain(item)) < leaks.Q:
            assert not found
            continue
        edits = fewest_edits(plain(item), plain(text))
        assert [f[4] for f in found] == ([edits] if edits <= index.edits[0] else [])
        for owner, _, start, end, e in found:
            assert owner == 1 and fewest_edits(plain(item), plain(text[start:end])) == e


def test_leaks_of_whole_tables(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, ""), (4, "short"),
             (5, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"), (5, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich")]
    texts = [*EDGES, f"Intro é. {items[0][1].upper()}\n{items[4][1]} end", "x" * 200_000 + " the quick brown fox jumps over a lazy dog near the river bank",
             "the quick brown fox jumps over", items[4][1]]
    frame, table = frame_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    found = [r["leaks"] for r in leaks.mark_leaks(frame, table).orderBy("doc_id").collect()]
    n = len(EDGES)
    assert all(not x for x in found[:n]) and [x["item_id"] for x in found[n]] == [1, 5]
    assert texts[n][found[n][0]["start"]:found[n][0]["end"]] == items[0][1].upper()
    assert [(x["item_id"], x["start"]) for x in found[n + 1]] == [(1, 200_001)] and not found[n + 2] and len(found[n + 3]) == 1
    blocks = leaks.mark_leaks(frame, table, keep=["doc_id"], block_chars=70).orderBy("doc_id").collect()
    assert [r["leaks"] for r in blocks] == found
    assert leaks.mark_leaks(frame, table.limit(0), keep=["doc_id"]).where(F.size("leaks") > 0).count() == 0
    assert leaks.mark_leaks(frame.limit(0), table).count() == 0
