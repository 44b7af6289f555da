"""Packing, leaks and text statistics."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import regex

from skyweave.llm.leaks import LeakParams, find_leaks, fingerprints, similarity, words_of
from skyweave.llm.packing import GeneticParams, cross, evolve, fitness, pack_items, pack_texts, token_counts
from skyweave.llm.quality import quality

SMALL = GeneticParams(shard_items=60, islands=2, population=4, epochs=2, generations=3)


def test_packing_keeps_every_item_and_the_capacity(spark):
    rng = random.Random(3)
    sizes = {k: rng.choice([0, 1, 5, 17, 40, 63, 100, 101, 250, 300]) for k in range(300)}
    rows = [(k, s, "x") for k, s in sizes.items()] + [(7, 3, "x"), (None, 5, "x"), (900, None, "x"), (901, -4, "x"), (5, sizes[5], "x")]
    got = pack_items(spark.createDataFrame(rows, "id long, size long, container string"), "id", "size", 100, SMALL).collect()
    load, parts = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container] += r["size"]
        parts[r.id, r.copy, r.whole].append((r.part, r.parts, r["size"]))
    assert max(load.values()) <= 100
    # every row is an item: those that share a key too, and those without one
    expect = defaultdict(int)
    for k, s, _ in rows:
        expect[k, max(s or 0, 0)] += 1
    assert {(k, copy, whole) for k, copy, whole in parts} == {(k, c, whole) for (k, whole), n in expect.items() for c in range(n)}
    for (_, _, whole), found in parts.items():
        assert sum(s for _, _, s in found) == whole and len(found) == max(1, -(-whole // 100)) == found[0][1]
        assert sorted(p for p, _, _ in found) == list(range(len(found)))
    fewest = -(-sum(max(s or 0, 0) for _, s, _ in rows) // 100)
    assert sum(1 for v in load.values() if v) <= 1.05 * fewest + 1


def test_packing_repeats_itself_and_takes_nothing(spark):
    df = spark.createDataFrame([(k, (k * 37) % 90 + 1) for k in range(150)], "id long, size long")
    a, b = (sorted(map(tuple, pack_items(df.repartition(p), "id", "size", 100, SMALL).collect())) for p in (3, 5))
    assert a == b
    assert pack_items(df.limit(0), "id", "size", 100).count() == 0
    with pytest.raises(ValueError):
        pack_items(df, "id", "size", 0)


def test_crossover_keeps_the_items_and_evolution_does_not_get_worse():
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 60, 80)
    people = evolve(sizes, [], 100, GeneticParams(generations=0), (1,))
    child = cross(people[0], people[1], sizes, 100, 0.3, rng)
    assert len(child) == 80 and np.bincount(child, weights=sizes).max() <= 100 and (np.bincount(child) > 0).all()
    later = evolve(sizes, people, 100, GeneticParams(generations=30), (1,))
    assert fitness(later[0], sizes, 100) >= fitness(people[0], sizes, 100)


def triplets(n, capacity, rng):
    """Three items fill a container exactly: best fit, largest first, pairs them badly."""
    out = []
    for _ in range(n):
        a = int(rng.integers(int(capacity * 0.38), int(capacity * 0.49)))
        b = int(rng.integers(capacity // 4, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    return np.array(out)


@pytest.mark.parametrize("mix,saved", [("triplets", 20), ("uniform", 4), ("halves", 8)])
def test_the_genetic_step_beats_best_fit(mix, saved):
    rng = np.random.default_rng(0)
    sizes = {"triplets": triplets(300, 1024, rng), "uniform": rng.integers(200, 600, 900), "halves": rng.integers(250, 520, 900)}[mix]
    bins = lambda g: int(evolve(sizes, [], 1024, GeneticParams(generations=g), (1,))[0].max()) + 1
    best_fit, evolved = bins(0), bins(18)
    assert -(-int(sizes.sum()) // 1024) <= evolved <= best_fit - saved


def test_islands_pack_better_than_best_fit(spark):
    sizes = triplets(200, 1024, np.random.default_rng(5)).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    count = lambda p: pack_items(df, "id", "size", 1024, p).select("container").distinct().count()
    alone = count(GeneticParams(generations=0, epochs=1, islands=1))
    assert count(GeneticParams()) <= alone - 10


def test_tokens_of_whole_texts(spark):
    long = "word and another, 12 times; " * 3000
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, long)], "id long, t string")
    got = {r.id: r.size for r in token_counts(df, "id", "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 20_000
    packed = pack_texts(df, "id", "t", 1024).collect()
    assert {r.id for r in packed} == {1, 2, 3, 4} and {r.id for r in packed if r.parts > 1} == {4}


def plain_words(text):
    kept = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    return regex.findall(r"[\p{L}\p{N}]+", kept.lower())


def leaked(docs, items, n=9):
    out = set()
    for d, t in docs:
        mine = plain_words(t or "")
        grams = {tuple(mine[i : i + n]) for i in range(len(mine) - n + 1)}
        for k, u in items:
            w = plain_words(u or "")
            if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
                out.add((d, k))
    return out


def test_words_follow_the_statement():
    for text in ("Él niño—dijo: «ﬁn»", "a​b soft­hyphen ÇA", "Straße 3½ x²", "İstanbul IŞIK", "", "naïve café 12,5"):
        assert words_of(text) == plain_words(text)


@pytest.mark.parametrize("index_windows,chunk", [(1_000_000, 32_768), (15, 16)])
def test_leaks_equal_brute_force(spark, index_windows, chunk):
    rng = random.Random(8)
    vocabulary = ["río", "Sea", "hill", "boat", "naïve", "12", "wind", "stone", "café", "road", "ß", "tower"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([5, 9, 14, 25]))) for k in range(25)] + [(90, None), (91, ""), (92, "hill " * 12)]
    docs = []
    for k in range(80):
        t = text(rng.choice([0, 3, 20, 120]))
        if k % 2:
            words = items[k % 25][1].split()
            a = rng.randrange(max(1, len(words) - 8))
            t += ", " + " / ".join(words[a : a + rng.choice([8, 9, 12])]).upper() + ". " + text(4)
        docs.append((k, t))
    docs += [(200, None), (201, ""), (202, "hill " * 9), (203, items[3][1] + " " + text(400)), (1, docs[1][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, windows int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(d, "doc_id", "text", i, "item_id", "text", LeakParams(index_windows=index_windows, chunk_words=chunk)).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.exact_windows} == leaked(docs, items)
    assert find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_blocks_find_all_fingerprints_within_the_radius():
    from skyweave.llm.leaks import _Index

    rng = np.random.default_rng(2)
    p = LeakParams()
    words = [f"w{k}" for k in range(300)]
    index = _Index([(0, words, fingerprints(words, p)), (1, words[:20], fingerprints(words[:20], p))], p)
    assert len(index.prints) == 292 and index.holders(0) == [0, 1] and index.holders(291) == [0]
    flips = []
    for k in range(len(index.prints)):
        bits = rng.choice(64, rng.integers(0, 4), replace=False)
        flips.append(index.prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0)))
    row, other = index.candidates(np.array(flips))
    assert {(k, k) for k in range(len(flips))} <= set(zip(row.tolist(), other.tolist(), strict=True))


def test_a_window_of_many_items_is_indexed_once(spark, monkeypatch):
    from skyweave.llm import leaks

    monkeypatch.setattr(leaks, "CANDIDATE_PAIRS", 3)
    shared = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(k, shared if k else shared + " ten") for k in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"begin {shared} ten end"), (2, shared + "; " + shared)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact_windows for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 0): 2, (2, 0): 2} | {(1, k): 1 for k in range(1, 50)} | {(2, k): 2 for k in range(1, 50)}


def test_similarity_is_weighted():
    a = list("abcdefghi")
    assert similarity(a, a, 5) == 1.0 and similarity(a, list("xbcdefghi"), 5) == pytest.approx(20 / 30)
    assert len(fingerprints(a, LeakParams())) == 1 and len(fingerprints(a[:8], LeakParams())) == 0


def judged(text, common):
    words = [w for w in regex.split(r"[ \t\r\n ]+", text or "") if w]
    chars = sum(map(len, words))
    lines = [x.strip(" \t\r ") for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    hits = sum(w.lower().strip(".,;:!?…\"'()[]«»¿¡–—") in common for w in words)
    symbols = sum(c in "#$%&*+/<=>@\\^_|~{}[]•" for w in words for c in w)
    if len(words) < 3:
        return True
    return (
        not 2.5 <= chars / len(words) <= 11
        or symbols > 0.08 * chars
        or (len(lines) >= 3 and sum(x[-1] in ".!?…;:" for x in lines) < len(lines) / 2)
        or hits / len(words) < 0.1
    )


def test_quality_rules_and_profiles(spark):
    texts = [
        None, "", "   ", "two words", "The boat and the hill are by the sea.", "a b c d e f", "- one\n- the two\n- three of the", "the a #### $$$$ of and",
        "Ends here.\nAnd the next: \nof the last; \r\n", "the end of it all and the more.", "incomprehensibilities antidisestablishmentarianism the counterrevolutionaries",
        "«The» (and) of, — who knows it", "x" * 5000, "the and of " * 4000, "| a | the |\n| b | of |\n| c | d |", "zzz yyy xxx www vvv uuu", "the\tboat\nof",
    ]
    common = {"the", "and", "of", "el"}
    words = spark.createDataFrame([("en", w) for w in ("the", "and", "of")] + [("es", "el"), (None, "x"), ("en", None)], "lang string, word string")
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "the boat of the sea", 1), (3, "two words", 1)], "doc_id long, text string, words int")
    got = quality(df, "doc_id", "text", words).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: r.not_prose for r in got if r.doc_id is not None} == {k: judged(t, common) for k, t in enumerate(texts)}
    by = {r.doc_id: r for r in got}
    assert by[13].profile.startswith("prose") and by[0].profile == "junk" and by[0].divergence is None
    assert quality(df.limit(0), "doc_id", "text", words).count() == 0
    assert {r.profile for r in quality(df, "doc_id", "text", words.limit(0)).collect()} <= {"junk", "table", "list", "prose"}


def planted(seed, n):
    """Texts of known structure in three languages, and the common words of these languages."""
    rng = random.Random(seed)
    common = {
        "en": "the and of to in a is that for it was on with as his they at be this from".split(),
        "es": "el la de que y en los se del las un por con una su para es al lo como".split(),
        "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es".split(),
    }
    stem = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    texts = []
    for k in range(n):
        kind = ("prose:en", "prose:es", "prose:de", "list", "table", "junk")[k % 6]
        if kind.startswith("prose"):
            sentence = lambda words: " ".join(rng.choice(words) if rng.random() < 0.5 else stem() for _ in range(rng.randint(7, 15))).capitalize() + "."
            t = " ".join(sentence(common[kind[6:]]) for _ in range(rng.randint(2, 6)))
        elif kind == "list":
            words = rng.choice(list(common.values()))
            t = "\n".join(f"- {stem()} {rng.choice(words)} {stem()}" for _ in range(rng.randint(4, 12)))
        elif kind == "table":
            t = "\n".join(f"| {stem()} | {rng.randint(10, 9999)} | {rng.random():.2f} | {stem()} |" for _ in range(rng.randint(3, 9)))
        else:
            t = "".join(rng.choice("abcdef0123456789$#@{}<>;") for _ in range(rng.randint(40, 160)))
        texts.append((k, t, kind))
    return texts, [(lang, w) for lang, words in common.items() for w in words]


@pytest.mark.parametrize("seed,n", [(1, 120), (2, 900)])
def test_divergence_tells_structures_apart(spark, seed, n):
    texts, common = planted(seed, n)
    df = spark.createDataFrame(texts, "doc_id long, text string, kind string")
    got = {r.doc_id: r.profile for r in quality(df, "doc_id", "text", spark.createDataFrame(common, "lang string, word string")).collect()}
    for kind in {k for _, _, k in texts}:
        right = [got[d] == kind for d, _, k in texts if k == kind]
        assert sum(right) >= 0.95 * len(right), (kind, sum(right), len(right))


def test_sparse_word_divergence_equals_the_dense_one():
    from skyweave.llm.quality import Profiles, divergence

    rng = np.random.default_rng(4)
    profiles = Profiles.prototypes({"x": ["a", "b", "c"], "y": ["c", "d"]})
    dense = rng.integers(0, 4, (6, 5)).astype(float)
    dense[:, 4] += 1
    dense /= dense.sum(1, keepdims=True)
    doc, word = np.nonzero(dense)
    assert profiles.word_divergence(doc, word, dense[doc, word], 6) == pytest.approx(divergence(dense, profiles.words))
