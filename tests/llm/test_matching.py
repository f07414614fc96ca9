"""Near duplicates and benchmark decontamination against brute force."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, DOCS, awkward, empty
from tidemark.llm import common
from tidemark.llm import order_minhash as omh
from tidemark.llm import qgram_decontamination as qd
from tidemark.llm.common import as_text, components, labelled, mix, shingle_hashes, word_hashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_plain():
    draw = random.Random(1)
    for _ in range(300):
        a = np.array(draw.choices(range(4), k=draw.randint(0, 14)))
        b = a.copy() if draw.random() < 0.3 else np.array(draw.choices(range(4), k=draw.randint(0, 14)))
        most = draw.randint(0, 8)
        assert omh.edit_distance(a, b, most) == min(distance(a.tolist(), b.tolist()), most + 1)


def test_banded_equals_plain():
    draw = random.Random(11)
    for _ in range(1500):
        letters = draw.choice([2, 4, 30])
        a = draw.choices(range(letters), k=draw.randint(1, 120))
        b = list(a)
        for _ in range(draw.randint(0, 60)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 2)] = draw.choices(range(letters), k=draw.randint(0, 2))
        if draw.random() < 0.2:
            b = draw.choices(range(letters), k=draw.randint(1, 120))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if b:
            most, exact = draw.randint(0, 50), distance(a, b)
            assert omh.banded(a, b, most) == min(exact, most + 1)
            assert exact <= omh.two_diagonals(np.array(a), np.array(b)) == omh.two_diagonals(np.array(b), np.array(a))
            own = np.array(a, np.uint32)
            assert omh.pairs_of(own).tolist() == np.sort(labelled(shingle_hashes(mix(own.astype(np.uint64)), omh.PAIR))).tolist()
            assert omh.edit_distance(np.array(a), np.array(b), most) == min(exact, most + 1)


def test_words_and_labels():
    texts = ["Hello, WORLD hello", "", None, "ünï É a1_b2", "x"]
    hashes, at = word_hashes(as_text(pa.array(texts)))
    assert np.diff(at).tolist() == [3, 0, 0, 4, 1]
    assert hashes[0] == hashes[2] != hashes[1]
    assert word_hashes(as_text(pa.array(["b2"])))[0][0] == hashes[6]
    assert len(shingle_hashes(hashes[:3], 5)) == 1 and len(shingle_hashes(np.arange(9, dtype=np.uint64), 5)) == 5
    assert len(set(labelled(np.array([7, 7, 7, 8], np.uint64)).tolist())) == 4


def brute_links(data):
    """Pairs of ids whose texts are linked by definition, and those of them that agree in a sketch."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    odd = np.random.default_rng(20190724).integers(0, 1 << 63, omh.SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    texts, keys = {}, {}
    for i, t, *_ in data:
        texts.setdefault(i, (tuple(split(t)), t))
    for i, (_, t) in texts.items():
        kmers = shingle_hashes(word_hashes(as_text(pa.array([t])))[0], omh.K)
        keys[i] = set(omh.sketch(labelled(kmers), kmers, odd, omh.PICKS).tolist()) if len(kmers) else set()
    linked, met = [], []
    for a, b in itertools.combinations(texts, 2):
        (wa, ta), (wb, tb) = texts[a], texts[b]
        if not wa or not wb:
            same = bool(ta) and ta == tb
        else:
            most = int(0.2 * max(len(wa), len(wb)) + 1e-9)
            same = wa == wb or abs(len(wa) - len(wb)) <= most and distance(wa, wb) <= most
        if same:
            linked.append((a, b))
            if wa == wb or keys[a] & keys[b]:
                met.append((a, b))
    return list(texts), linked, met


def classes_of(ids, links):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def brute_classes(data):
    ids, _, met = brute_links(data)
    return classes_of(ids, met)


def near_corpus(seed, groups=6, n=90):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 6)))
    passage = [word() for _ in range(25)]
    data = []
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([3, 12, 60, 150]))]
        for _ in range(draw.choice([1, 3, 12])):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 15))):
                at = draw.randrange(len(own))
                own[at : at + draw.randint(0, 2)] = [word() for _ in range(draw.randint(0, 2))]
            data.append(own)
        half = len(base) // 2
        data.append(base[half:] + base[:half])  # moved about: no copy if it is long
    while len(data) < n:
        data.append([word() for _ in range(draw.randint(1, 40))] + passage * draw.randint(0, 1) + [word() for _ in range(draw.randint(0, 40))])
    draw.shuffle(data)
    case = lambda w: w.upper() if draw.random() < 0.2 else w
    return [(i, draw.choice([" ", ", ", "\n"]).join(map(case, w)), None, None, 0) for i, w in enumerate(data)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"rounds": 0, "block": 3}])
def test_classes_equal_brute_force(spark, seed, options):
    data = near_corpus(seed)
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(data, DOCS), **options).collect()}
    ids, linked, met = brute_links(data)
    # every link that a sketch finds, and nine tenths of all at least
    assert got == classes_of(ids, met) and len(met) >= 0.9 * len(linked)
    assert sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    assert len(set(got.values())) < len(got)


def test_large_group_of_near_copies(spark):
    """Members differ from one another; some link only through others. Few leaders, many blocks."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(120):
        own = list(base)
        for at in draw.sample(range(80), draw.choice([0, 1, 1, 2, 3, 5])):
            own[at] = f"x{i}_{at}"
        data.append((i, " ".join(own), None, None, 0))
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(data, DOCS), rounds=1, block=16).collect()}
    assert got == brute_classes(data)


def test_spread_edits(spark):
    """Substitutions spread over a text are edits, however many of its five-word runs they touch."""
    words = [f"w{i}" for i in range(100)]
    data = [(0, " ".join(words), None, None, 0)]
    for n in (2, 4, 8, 12):
        data.append((n, " ".join(f"x{n}y{i}" if i % (100 // n) == 3 and i // (100 // n) < n else w for i, w in enumerate(words)), None, None, 0))
    data.append((50, " ".join(words[50:] + words[:50]), None, None, 0))
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(data, DOCS)).collect()}
    assert got == {0: 0, 2: 0, 4: 0, 8: 0, 12: 0, 50: 50}


def test_lemma_leaves_out_no_link():
    draw = random.Random(12)
    for _ in range(2000):
        a = draw.choices(range(6), k=draw.randint(1, 30))
        b = list(a)
        for _ in range(draw.randint(0, 7)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = draw.choices(range(6), k=draw.randint(0, 1))
        if not b:
            continue
        x, y = (omh._words(np.array(w, np.uint32).tobytes()) for w in (a, b))
        if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
            assert omh.alike(*(omh.sorted_labels(w[0].astype(np.uint64)) for w in (x, y)), 0.8)
            assert omh.linked(x[0], y[0], 0.8) and omh.possible(len(a), np.array(len(b)), np.array(len(np.intersect1d(x[1], y[1]))), 0.8)
        else:
            assert not omh.linked(x[0], y[0], 0.8)


def test_hot_leader_and_hot_passage(spark):
    """Thousands of texts in one bucket: copies of one leader, and texts that share only a passage."""
    draw = random.Random(13)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    passage, base = [word() for _ in range(60)], [word() for _ in range(90)]
    data = []
    for i in range(1500):
        own = [word() for _ in range(draw.randint(60, 90))] + passage
        if i % 2:
            own = list(base)
            own[draw.randrange(90)] = word()
        data.append((i, " ".join(own), None, None, 0))
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(data, DOCS), block=128).collect()}
    assert all(c == (1 if i % 2 else i) for i, c in got.items())


def test_near_awkward(spark):
    rows = omh.near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    got = {(r.doc_id, r.class_id, r.class_size) for r in rows}
    assert {(5, 5, 3), (6, 5, 3), (1, 1, 1), (2, 2, 1), (4, 4, 1), (None, None, 1)} <= got
    kept = omh.representatives(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)]
    assert omh.near_duplicates(empty(spark)).count() == 0 and omh.representatives(empty(spark)).count() == 0


def test_null_id_beside_its_copy(spark):
    text = "a b c d e f g h"
    kept = omh.representatives(spark.createDataFrame([(None, text, None, None, 0), (9, text, None, None, 0), (None, "other words", None, None, 0)], DOCS))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(9, text), (None, "other words")}


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked if top(x) != x}


@pytest.mark.parametrize("few", [0, 1 << 15])
def test_components_in_the_cluster_and_on_the_driver(spark, few, monkeypatch):
    draw = random.Random(6)
    links = [(draw.randrange(90), draw.randrange(90)) for _ in range(60)] + [(i + 1, i) for i in range(300, 330)] + [(7, 7), (9_000, 9_000)]
    gathered = []
    own = common.joined
    monkeypatch.setattr(common, "joined", lambda edges: gathered.append(edges.count()) or own(edges))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test", few).collect()}
    of = classes_of(sorted({x for e in links for x in e}), links)
    assert got == {x: top for x, top in of.items() if top != x}
    assert bool(gathered) == (few > 0)
    assert components(spark.createDataFrame([(5, 5)], "a long, b long"), "test", few).count() == 0


def test_words_of_nodes_without_a_shuffle_of_texts(spark):
    """All nodes keep their words, few other texts stay, and no row with words is shuffled or left behind."""
    prints = spark.range(20_000).select(F.col("id").alias("uid"), F.col("id").cast("string").cast("binary").alias("words"))
    nodes = spark.range(0, 20_000, 10).select(F.col("id").alias("node"))
    found = omh._words_of(prints, nodes)
    rows = {r.node: bytes(r.words) for r in found.collect()}
    assert set(range(0, 20_000, 10)) <= set(rows) and len(rows) < 2_000 + 0.12 * 18_000
    assert all(w == str(n).encode() for n, w in rows.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\(uid", plan)
    # with fewer bits than nodes other texts stay, and no node is lost
    assert set(range(0, 20_000, 10)) <= {r.node for r in omh._words_of(prints, nodes, most_bits=64).collect()}
    assert omh._words_of(prints, nodes.limit(0)).count() == 0


def test_tables_with_words_are_deleted(spark):
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    omh.near_duplicates(spark.createDataFrame(near_corpus(3), DOCS)).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before}
    assert not left & {"omh-prints", "omh-nodes", "omh-words", "omh-buckets"}, left


def test_within_equals_plain():
    draw = random.Random(12)
    for _ in range(1500):
        letters = draw.choice([2, 4, 30])
        a, b = (draw.choices(range(letters), k=draw.randint(0, 90)) for _ in range(2))
        if draw.random() < 0.7:
            b = list(a)
            for _ in range(draw.randint(0, 30)):
                at = draw.randrange(len(b) + 1)
                b[at : at + draw.randint(0, 2)] = draw.choices(range(letters), k=draw.randint(0, 2))
        most = draw.randint(0, 60)
        assert omh.within(omh.masks_of(a), len(a), b, most) == (distance(a, b) <= most), (a, b, most)


def test_blocks_count_common_words_of_all_pairs_at_once(monkeypatch):
    """Texts with a common passage: no pair's words are held against each other, and the links are those of brute force."""
    draw = random.Random(13)
    passage = [draw.randrange(10**6) for _ in range(30)]
    texts = []
    for i in range(40):
        own = passage + [draw.randrange(60) for _ in range(draw.randint(4, 20))]
        texts += [own] + ([own[:-2] + [7, 8], own + [9]] if i % 5 == 0 else [])
    texts.append([])
    table = pa.table({"side": [2] * len(texts), "root": list(range(len(texts))), "words": [np.array(t, np.uint32).tobytes() for t in texts]})
    pair = lambda *_: pytest.fail("a pair at a time")
    monkeypatch.setattr(omh, "alike", pair)
    for masked in (omh.MASKED, 0):
        monkeypatch.setattr(omh, "MASKED", masked)
        out = omh._blocks(0.8)(table)
        brute = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)]
        assert brute and classes_of(range(len(texts)), list(zip(out["ra"].to_pylist(), out["rb"].to_pylist(), strict=True))) == classes_of(range(len(texts)), brute)


def infix(item, text):
    """Fewest edits of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def plain(text):
    return " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower()))


def test_leaks_equal_brute_force(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghé", k=draw.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 4, 12, 25])))) for i in range(25)]
    items += [(90, ""), (91, None), (92, "!!"), (93, items[0][1]), (None, "a text of an item without any number")]
    docs = []
    for i in range(70):
        own = [word() for _ in range(draw.randint(0, 60))]
        for _, text in draw.sample(items[:25], draw.randint(0, 2)):
            chars = list(text)
            for _ in range(draw.choice([0, 0, len(text) // 20, len(text) // 10, len(text) // 6])):
                at = draw.randrange(len(chars))
                chars[at : at + draw.randint(0, 1)] = draw.choice(["", "z", "q"])
            own.insert(draw.randint(0, len(own)), draw.choice(["".join(chars), "".join(chars).upper()]))
        docs.append((i, draw.choice([" ", "\n", "... "]).join(own), None, None, 0))
    index = qd.build_index(items, qd.Q, qd.BUDGET)
    budget = dict(zip(zip(index.ids, index.texts, strict=True), index.edits.tolist(), strict=True))
    expected = {}
    for i, text, *_ in docs:
        for (item, body), most in budget.items():
            found, body = plain(text), body.decode()
            edits = (0 if f" {body} " in f" {found} " else 99) if len(body.encode()) < qd.Q else infix(body.encode(), f" {found} ".encode())
            if edits <= most:
                expected[i, item] = edits
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for blocks in (2 << 20, 300):
        out = qd.contamination(frame, bench, keep=["doc_id"], block_bytes=blocks).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*").collect()
        got = {}
        for r in out:
            got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
        assert got == expected and len(got) > 20
    texts = {d[0]: d[1] for d in docs}
    for r in out:
        if r.edits == 0:
            assert plain(texts[r.doc_id][r.start : r.end]) in {t.decode() for t in index.texts}


def test_leaks_awkward(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "text here for all to see and read")], "item_id long, text string")
    rows = qd.contamination(awkward(spark), bench).collect()
    assert len(rows) == len(AWKWARD) and rows[0].score == "own score"
    assert sorted((r.doc_id or 0, [x.item_id for x in r.leaks]) for r in rows if r.leaks) == [(0, [1]), (5, [2]), (5, [2]), (6, [2])]
    none = bench.where("false")
    assert all(r.leaks == [] for r in qd.contamination(awkward(spark), none).collect())
    assert qd.contamination(empty(spark), bench).count() == 0


def test_repetitive_texts_and_items(spark):
    """A text and an item that say the same over and over: work grows with the text, not with its square."""
    import time

    items = [(1, "la la la lo " * 100), (2, "ab " * 60), (3, "one two three four five six seven eight")]
    docs = [(1, "la " * 20_000, None, None, 0), (2, "la la la lo " * 6000, None, None, 0), (3, "ab " * 30, None, None, 0), (4, "x " * 500 + "ab " * 70, None, None, 0)]
    began = time.time()
    out = {r.doc_id: r.leaks for r in qd.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert time.time() - began < 60
    assert {x.item_id for x in out[2]} == {1} and {x.item_id for x in out[4]} == {2} and out[3] == []
    assert len(out[2]) >= 50 and all(x.edits == 0 for x in out[2])
    # one letter in twelve differs, which the budget of one in ten allows
    assert {x.item_id for x in out[1]} == {1} and all(0 < x.edits <= 119 for x in out[1])


def test_thinned_places_reach_the_same_cells():
    draw = random.Random(14)
    for _ in range(500):
        spots = sorted(draw.sample(range(200), draw.randint(1, 60)))
        step, hit = draw.randint(1, 30), draw.randrange(400)
        cells = lambda ps: {(hit - p + 300) // step for p in ps}  # noqa: B023, E731
        assert cells(qd.thinned(spots, step)) == cells(spots)


def test_leaks_in_pieces_of_a_long_text(monkeypatch):
    """A long text is searched in pieces with the same result."""
    draw = random.Random(15)
    word = lambda: "".join(draw.choices("abcdefghé", k=draw.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 5, 12])))) for i in range(12)]
    own = [word() for _ in range(3000)]
    for _, t in items * 6:
        own.insert(draw.randrange(len(own)), t[:-1] + draw.choice([t[-1], "z"]))
    own.insert(700, "!" * 500 + items[5][1].replace(" ", " ... " * 40))
    text = " ".join(own)
    index = qd.build_index(items, qd.Q, qd.BUDGET)
    whole = qd._kernel(index, qd.Q)(as_text(pa.array([text])))[0].to_pylist()[0]
    monkeypatch.setattr(qd, "PIECE", 2000)
    cut = qd._kernel(index, qd.Q)(as_text(pa.array([text])))[0].to_pylist()[0]
    found = lambda hits: {(h["item_id"], h["start"], h["end"]) for h in hits if not h["edits"]}
    assert found(whole) == found(cut) and len(found(cut)) > 20
    assert {h["item_id"] for h in whole} == {h["item_id"] for h in cut}


def test_chunks_of_a_long_text(monkeypatch):
    """Kernels that go through a text by chunks give what they give for the whole."""
    from tidemark.llm import common, cube_mixing, knn_quality, language_mixture

    draw = random.Random(16)
    texts = as_text(pa.array(["".join(draw.choices("aB é\n#\U0001f600z1", k=n)) for n in (0, 1, 5000, 3, 999)] + [None, " ", "word " * 700]))
    kernels = {
        "hashes": lambda: [x.tolist() for x in word_hashes(texts)],
        "counts": lambda: cube_mixing.word_counts(texts)[0].to_pylist(),
        "terms": lambda: knn_quality.terms(texts, 256).tolist(),
        "trigrams": lambda: sorted((d, c) for docs, codes in language_mixture.trigrams(texts, 1024) for d, c in zip(docs.tolist(), codes.tolist())),
    }
    whole = {k: f() for k, f in kernels.items()}
    monkeypatch.setattr(common.chunks, "__defaults__", (7,))
    monkeypatch.setattr(common, "CHUNK", 7)
    assert {k: f() for k, f in kernels.items()} == whole
    assert whole["counts"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts.to_pylist()]
