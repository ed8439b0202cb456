import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark.llm.jaccard as J
import tidemark.llm.lines as L
from tidemark.llm.graph import star_components
from tidemark.llm.textkit import shingle_set, word_hashes, words


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def families(rng, groups, longest):
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for f in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, longest))]
        if f % 2:
            base[5:5] = passage
        for _ in range(rng.choice([1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("width,percent,block,hot", [(3, 90, 400, 64), (5, 80, 4, 2)])
def test_jaccard_equals_brute_force(spark, monkeypatch, width, percent, block, hot):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "HOT", hot)
    texts = families(random.Random(7), 8, 120)
    texts += texts[:3] + ["", None, " \t ", "a", "A", "a b"]
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(len(sets), links)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs, width=width, percent=percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_jaccard_spares_a_passage_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 8)
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(rng.choice([20, 30, 60]))]) for _ in range(150)]
    texts += [t + " more" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs, width=3, percent=90).collect()}
    assert got == {i: i if i < 150 else i - 150 for i in range(170)}
    sets = [shingle_set(h, 3) for h in word_hashes(texts)]
    rows = spark.createDataFrame([(i, str(i).encode(), len(s), t) for i, (s, t) in enumerate(zip(sets, texts))], "a long, node binary, n long, text string")
    keys = J.rare_tokens(rows.select("a", "n", "text"), 3, 90)
    assert keys.groupBy("key").count().agg({"count": "max"}).first()[0] == 2


def test_jaccard_cuts_no_larger_share_again_as_groups_grow(spark, monkeypatch):
    rng = random.Random(23)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    seen = []
    plain = J.written

    def spy(df, name, by=None):
        out = plain(df, name, by)
        if name == "tokens":
            seen.append(out.count())
        return out

    monkeypatch.setattr(J, "written", spy)
    passage = words(120)
    texts = [" ".join(passage + words(60)) for _ in range(150)] + [" ".join(words(100)) for _ in range(50)]
    for rows in (texts[:30] + texts[150:160], texts):  # five times as many of each kind
        got = J.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), width=5, percent=80)
        assert got.where("doc_id <> component_id").isEmpty()
    assert len(seen) == 2 and 0 < seen[1] <= 6 * seen[0]


def test_jaccard_asks_blocks_not_classes(spark):
    rows = spark.range(100).selectExpr("1L AS key", "id AS a", "id % 2 AS block", "cast(cast(id AS string) AS binary) AS label", "1L AS size")
    found = J._larger_elsewhere(rows, rows)
    key = lambda r: str(r).encode()
    want = {(a, 1 - a % 2) for a in range(100) if any(key(b) > key(a) for b in range(1 - a % 2, 100, 2))}
    assert {tuple(r) for r in found.collect()} == want
    assert found.count() <= 100  # a row for each set and other block; the classes there are 50


def test_jaccard_many_classes_of_common_tokens(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 20)
    rng = random.Random(29)
    phrases = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(14)]
    texts = [" ".join(phrases[i] for i in sorted(rng.sample(range(14), rng.choice([9, 10, 11])))) for _ in range(160)]
    sets = [set(shingle_set(h, 5).tolist()) for h in word_hashes(texts)]
    want = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=5, percent=80).collect()}
    assert got == dict(enumerate(want))
    assert 10 < len(set(want)) < 160


def test_jaccard_empty_and_null_ids(spark):
    kind = "doc_id long, text string"
    assert J.jaccard_components(spark.createDataFrame([], kind)).count() == 0
    rows = J.jaccard_components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None)], kind)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]


def test_hashes_do_not_depend_on_the_batch(monkeypatch):
    import tidemark.llm.textkit as K

    texts = ["one two  three", None, "", "É à\x0bz " * 50, "x"]
    alone = [word_hashes([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, word_hashes(texts)))
    monkeypatch.setattr(K, "PIECE", 16)
    assert all((a == b).all() for a, b in zip(alone, K.word_hashes(texts)))
    assert [len(a) for a in alone] == [len(words(t)) for t in texts]
    assert len(shingle_set(np.array([1, 2], np.uint64), 3)) == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = roots(141, links)
    assert got == {i: want[i] for i in {x for p in links for x in p}}
    assert star_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_automaton_equals_plain_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé😀 ") for _ in range(rng.randint(1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é", "😀"])
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= edits and b:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select(*[L.within_edits(F.col("a"), F.col("b"), F.lit(m), edits) & (F.char_length("a") - F.char_length("b") <= m) for m in range(edits + 1)])
    assert [list(r) for r in found.collect()] == [[distance(a, b) <= m for m in range(edits + 1)] for a, b in pairs]
    assert found.count() > 200


def test_within_edits_of_any_number(spark):
    line = "the quick brown fox jumps over the lazy dog"
    others = [line[2:], line[5:], line[6:], line[:10] + "éé😀" + line[13:-2], line[:4] + line[10:]]
    df = spark.createDataFrame([(line, o) for o in others], "a string, b string")
    got = [r[0] for r in df.select(L.within_edits(F.col("a"), F.col("b"), F.lit(5), 5)).collect()]
    assert got == [distance(line, o) <= 5 for o in others] == [True, True, False, True, False]


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    letters = "abcde fghij"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(12, 70))).strip() for _ in range(20)]

    def edited(s):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(["", rng.choice(letters), rng.choice(letters) + s[i]]) + s[i + 1 :]
        return s.strip() or "x"

    lines = [edited(rng.choice(base)) for _ in range(150)]
    docs = spark.createDataFrame([(k, "\n".join(lines[k * 5 : k * 5 + 5])) for k in range(30)] + [(90, None), (91, ""), (92, " \n ")], "doc_id long, text string")
    flat = [(k, j, x.strip(L.BLANK)) for k in range(30) for j, x in enumerate(lines[k * 5 : k * 5 + 5]) if x.strip(L.BLANK)]
    near = lambda a, b: a == b or distance(a, b) <= min(L.EDITS, min(len(a), len(b)) // L.CHARS_PER_EDIT)
    want = roots(len(flat), [(i, j) for i in range(len(flat)) for j in range(i) if near(flat[i][2], flat[j][2])])
    got = {(r.doc_id, r.line_no): r for r in L.line_classes(docs).collect()}
    assert set(got) == {(k, j) for k, j, _ in flat}
    pairs = {(want[i], got[k, j].class_id) for i, (k, j, _) in enumerate(flat)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert {i for i, (k, j, _) in enumerate(flat) if got[k, j].kept} == set(want)
    kept = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    assert kept[90] is None and kept[91] == "" and len(kept) == 33


def test_lines_null_and_repeated_ids_long_lines_and_clashing_names(spark):
    long = "y" * 30_000
    rows = [(None, "same line here twice\n\nother words of its own"), (3, "same line here twice"), (3, "same line here twice"), (4, long + "a\n" + long + "b"), (5, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1, [2]) for i, t in rows], "doc_id long, text string, doc string, lines int, line array<int>")
    got = L.line_classes(docs).collect()
    assert len(got) == 6 and sorted(r.class_size for r in got) == [1, 2, 2, 3, 3, 3]
    assert sorted((r.doc_id, r.kept) for r in got if r.class_size == 3 and r.doc_id) == [(3, True), (3, True)]
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {None: "\nother words of its own", 3: "same line here twice", 4: long + "a", 5: None}


def test_lines_empty(spark):
    assert L.line_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
