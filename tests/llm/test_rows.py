import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, exact, langid, mixing, quality, scratch, sharding, toxicity, weak

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "Text"), (4, "Text"), (None, "text"), (7, "É" * 5000), (8, "tEXT"), (9, "é" * 5000)]
KIND = "doc_id long, text string"


def frame(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], KIND + ", id string, size int")


def test_exact(spark):
    got = [tuple(r) for r in exact.exact_duplicates(frame(spark)).collect()]
    group = [r for r in got if r[4] == hashlib.sha256(b"text").hexdigest()]
    assert len(got) == len(ODD) and all(r[1] == 8 and r[2] == 4 for r in group) and len(group) == 4
    assert [r[0] for r in group if r[3]] == [8]
    assert {r[0]: (r[1], r[2], r[3]) for r in got if r[0] in (1, 2, 7, 9)} == {1: (2, 2, False), 2: (2, 2, True), 7: (7, 1, True), 9: (9, 1, True)}
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_with_a_filter_that_is_joined(spark, monkeypatch):
    monkeypatch.setattr(exact, "SENT_WORDS", 0)
    assert sum(r.kept for r in exact.exact_duplicates(frame(spark)).collect()) == 5


def test_exact_in_slices_reads_each_row_once(spark, monkeypatch):
    """A filter of several slices gives the same rows, and each slice's join scans its own folder only."""
    rows = [(i, f"text {i % 1500}") for i in range(2000)] + [(None, "text 3"), (5, None)]
    whole = sorted(map(str, exact.exact_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(exact, "SENT_WORDS", 150)
    assert sorted(map(str, exact.exact_duplicates(frame(spark, rows)).collect())) == whole
    hashed = scratch.written(spark.createDataFrame(rows, "id long, text string").select("id", F.sha2("text", 256).alias("text_sha256")), "hashed")
    located = exact._located(hashed, len(rows))
    marked = exact._marked(located, exact.repeated_filter(located))
    plan = marked._jdf.queryExecution().toString()
    assert plan.count("slices]") > 0 and marked.count() == len(rows) and all("slice" in line for line in plan.splitlines() if "PartitionFilters" in line and "slices]" in line)


def test_exact_filter_marks_all_repeats_and_little_else(spark):
    texts = [f"text {i}" for i in range(6000)] + [f"again {i % 100}" for i in range(300)] + ["hot"] * 500
    hashed = spark.createDataFrame(list(enumerate(texts)), "id long, text_sha256 string")
    located = exact._located(hashed, len(texts))
    marked = {r.id for r in exact._marked(located, exact.repeated_filter(located)).where("maybe").collect()}
    assert marked >= set(range(6000, 6800)) and len(marked) < 800 + 6000 * 0.06


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot copy " * 9, "x" * rng.randint(0, 900), None])) for i in range(3000)] + ODD
    got = sharding.shard(frame(spark, rows), 7).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    loads = {}
    for r in got:
        loads.setdefault(r.shard, []).append(r)
    totals = [sum(r["size"] for r in v) for v in loads.values()]
    assert len(loads) == 7 and max(totals) - min(totals) <= 2 * max(size(t) for _, t in rows)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in loads.values())
    assert sharding.shard(frame(spark, []), 7).count() == 0


def targets_by_hand(sizes, weights, share, cap):
    total, target, open_ = sum(sizes) * share, [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * level > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mixing(spark):
    rng = random.Random(4)
    sources = ["b", "a", None, "é", "Z"]
    rows = [(i, "w " * rng.choice([0, 3, 40, 900]), rng.choice(sources)) for i in range(400)] + [(900, None, "a"), (900, "w w", "a"), (900, "w w", "a")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], KIND + ", source string, target string")
    got = mixing.mix_sources(docs, block_words=16).collect()
    assert len(got) == len(rows)
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == o) for o in order]
    want = dict(zip(order, targets_by_hand(sizes, [[5, 2, 1][i % 3] for i in range(len(order))], 1.5, 2.0)))
    by_id = {i: s for i, _, s in rows}
    for o, size in zip(order, sizes):
        own = [r for r in got if by_id[r.doc_id] == o]
        assert all(r.target == pytest.approx(want[o]) and r.source_size == size for r in own)
        assert abs(sum(r.taken for r in own) - want[o]) <= 1
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mixing.mix_sources(docs.repartition(5), block_words=16).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in got) == sorted((r.doc_id, r["size"], r.taken) for r in again)
    assert mixing.mix_sources(docs.where(F.lit(False))).count() == 0


def test_mixing_keeps_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_WORDS", 200)
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 40]), rng.choice(["a", "b"])) for i in range(90)]
    rows += [(None, rng.choice([0, 7, 50]), rng.choice(["a", "b"])) for _ in range(60)] + [(7, 11, "b")] * 40 + [(7, 30, "b"), (None, 5, None)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], KIND + ", source string")
    want, order = [], ["a", "b", None]
    sizes = [sum(n for _, n, s in rows if s == o) for o in order]
    for o, size, target in zip(order, sizes, targets_by_hand(sizes, [5, 2, 1], 1.5, 2.0)):
        first = 0
        for i, n, _ in sorted((r for r in rows if r[2] == o), key=lambda r: (r[0] is None, hashlib.md5(str(r[0]).encode()).hexdigest(), r[1])):
            want.append((str(i), n, size, sum(max(0, min(n, min(size, math.floor(target + 0.5) - k * size) - first)) for k in range(3))))
            first += n
    got = mixing.mix_sources(docs, block_words=16).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r["size"], r.source_size, r.taken) for r in got) == sorted(want)


def test_slots_decide_when_a_document_comes(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(i, rng.choice([0, 5, 40, 200]), rng.choice(["a", "b", None])) for i in range(120)]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], KIND + ", source string")
    order = ["a", "b", None]
    sizes = [sum(n for _, n, s in rows if s == o) for o in order]
    targets = targets_by_hand(sizes, [5, 2, 1], 1.5, 2.0)
    total = sum(targets)
    slots, ranks = int(total // 16) + 1, [[], [], []]
    for i in range(slots):
        x = i * mixing.GOLDEN % 1 * total
        ranks[next(k for k in range(3) if x < sum(targets[: k + 1]))].append(i)
    want = {}
    for k, (o, size, target) in enumerate(zip(order, sizes, targets)):
        first = 0
        for i, n, _ in sorted((r for r in rows if r[2] == o), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            rank = first // 16
            want[i] = None if not n or first >= min(size, math.floor(target + 0.5)) else ranks[k][rank] if rank < len(ranks[k]) else slots + rank * 3 + k + 1
            first += n
    got = {r.doc_id: r.first_slot for r in mixing.mix_sources(docs, block_words=16).collect()}
    assert got == want
    monkeypatch.setattr(mixing, "GOLDEN", 0.25)
    assert got != {r.doc_id: r.first_slot for r in mixing.mix_sources(docs, block_words=16).collect()}


def test_slots_follow_the_weights(spark):
    t = spark.createDataFrame([(1, 6000.0, 3000), (2, 3000.0, 3000), (3, 1000.0, 3000)], "place int, target double, source_size long")
    slots = [r.place for r in mixing.slot_schedule(t, 10).orderBy("slot").collect()]
    for n in (50, 200, 1000):
        assert all(abs(slots[:n].count(p) - n * w) <= 5 for p, w in ((1, 0.6), (2, 0.3), (3, 0.1)))


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "", None, "<\\|x|> <|", "a\nb", "", "<|im_end|>\n"]
    rows = [(i % 3, t, ["user", "assistant", None][t % 3], x, "clash") for i, x in enumerate(texts * 3) for t in (i,)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df)
    role, text = chat.read_back(F.col("formatted"), F.col("spans"))
    for r in out.select("conv_id", "n_turns", "rewrites", "formatted", role.alias("roles"), text.alias("texts")).collect():
        mine = sorted([(t, role or "", x or "") for c, t, role, x, _ in rows if c == r.conv_id])
        assert list(zip(r.roles, r.texts)) == [(a, b) for _, a, b in mine] and not r.rewrites and r.n_turns == len(mine)
        assert r.formatted.count("<|im_start|>") == len(mine)
    assert chat.format_chats(df.where("conv_id = 99")).count() == 0


def test_chat_sees_rewritten_history():
    def strips(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t.upper()}" for i, (r, t) in enumerate(turns))

    text, spans, rewrites = chat.locate_turns([("user", "ab"), ("assistant", "cd")], strips, frozenset(["assistant"]))
    assert rewrites and text == "[user]AB[assistant]cd" and text[spans[1]["text_begin"] : spans[1]["text_end"]] == "cd"


def test_chat_locates_earlier_turns_after_a_rewrite():
    def drops_thoughts(turns):  # only the last turn shows what is in brackets
        return "".join(f"[{r}]{t if i == len(turns) - 1 else re.sub('<.*?>', '', t)};" for i, (r, t) in enumerate(turns))

    text, spans, rewrites = chat.locate_turns([("user", "ab"), ("assistant", "<x>cd"), ("user", "ef")], drops_thoughts, frozenset(["assistant"]))
    assert rewrites and text == "[user]ab;[assistant]cd;[user]ef;"
    assert [text[s["text_begin"] : s["text_end"]] for s in spans] == ["ab", "cd", "ef"]
    text, spans, _ = chat.locate_turns([("user", "ab"), ("assistant", "cd")], lambda ts: f"{len(ts)} turns", frozenset())
    assert [s["text_begin"] == s["text_end"] for s in spans] == [True, True]


def test_chat_null_ids_repeated_rows_and_long_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, None, None, None)] + [(3, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (i % 7)) for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [got[k].n_turns for k in (None, 2, 3)] == [3, 1, 150] and got[None].formatted.count("<|im_start|>user") == 2
    assert all(got[3].formatted[s.text_begin : s.text_end] == rows[4 + i][3] for i, s in enumerate(got[3].spans))


def test_shards_of_equal_ids_equal_a_plain_layout(spark, monkeypatch):
    """Hot equal texts under one id; and, with one range, the same layout as a plain loop over the records in order."""
    rows = [(7, "hot")] * 400 + [(None, "hot")] * 100 + [(i, f"text {i} " * (i % 50)) for i in range(300)]
    got = sharding.shard(frame(spark, rows), 6).collect()
    loads = [sum(r["size"] for r in got if r.shard == k) for k in range(6)]
    assert len(got) == 800 and max(loads) - min(loads) <= 2 * max(len(t) + 16 for _, t in rows)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(6))
    monkeypatch.setattr(sharding, "_splitters", lambda *_: [])
    monkeypatch.setattr(sharding, "OVERFULL", 10**6)
    keyed = spark.createDataFrame(rows, KIND).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length("text") + 16).alias("size")).collect()
    total, at, first, want = sum(r["size"] for r in keyed), 0, {}, []
    for n, r in enumerate(sorted(keyed, key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0))):
        k = min(5, int((at + r["size"] / 2) * 6 / total))
        want.append((str(r.doc_id), r["size"], k, n - first.setdefault(k, n)))
        at += r["size"]
    got = sharding.shard(frame(spark, rows), 6).collect()
    assert sorted((str(r.doc_id), r["size"], r.shard, r.slot) for r in got) == sorted(want)


def test_quality_takes_odd_rows_and_equals_a_plain_score(spark):
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(12)).capitalize() + ".") for i in range(60)] + [(None, "### " * 40)] * 3 + [(5, "AA!! " * 3000), (5, None), (6, "")]
    model = quality.train_quality(frame(spark, rows))
    got = sorted(((str(r.doc_id), round(r.score, 9), r.good) for r in quality.score_quality(frame(spark, rows), model).collect()))
    want = []
    for i, text in rows:
        at, share, _ = quality.shapes(text)
        s = 1 / (1 + math.exp(-(sum(float(model.linear.weights[a]) * x for a, x in zip(at, share)) + model.linear.bias))) if len(at) else 0.0
        want.append((str(i), round(s, 9), s >= 0.5))
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in sorted(want)] and all(abs(x[1] - y[1]) < 1e-5 for x, y in zip(got, sorted(want)))


def language_rows():
    words = {"aa": ["the", "thing", "with", "other", "then"], "bb": ["der", "nicht", "schön", "und", "eine"]}
    rng = random.Random(6)
    return [(i, " ".join(rng.choice(words[l]) for _ in range(60)), l) for i in range(60) for l in (("aa", "bb")[i % 2],)], words


def test_languages(spark):
    rows, words = language_rows()
    model = langid.train_language_model(spark.createDataFrame(rows, KIND + ", lang string"))
    mixed = " ".join(words["aa"] * 30 + words["bb"] * 12)
    docs = frame(spark, [(100, rows[1][1]), (101, mixed), (102, "12 34 !"), (103, None), (104, "x"), (None, rows[0][1])])
    got = {r.doc_id: r for r in langid.identify_languages(docs, model).collect()}
    assert got[100].lang_pred == "bb" and got[None].lang_pred == "aa" and got[100].score > 0.99
    assert got[101].languages == ["aa", "bb"] and abs(got[101].shares[0] - 30 / 42) < 0.1
    assert got[102].lang_pred == got[103].lang_pred == "und" and got[103].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.train_language_model(spark.createDataFrame([], KIND + ", lang string"))
    assert langid.identify_languages(docs, none).where("lang_pred <> 'und'").count() == 0


def test_languages_of_a_text_in_four(spark):
    words = {"aa": ["the", "thing", "with"], "bb": ["der", "nicht", "schön"], "cc": ["quello", "perché", "sono"], "dd": ["jestem", "żeby", "którzy"]}
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(w) for _ in range(80)), l) for i, (l, w) in enumerate(list(words.items()) * 10)]
    model = langid.train_language_model(spark.createDataFrame(rows, KIND + ", lang string"))
    text = " ".join(w[k % 3] for w, n in zip(words.values(), (80, 60, 40, 20)) for k in range(n))
    docs = frame(spark, [(1, text), (1, text), (2, "² ½ Ⅷ 7 _"), (3, text * 40), (4, " ".join(["the thing with"] * 400 + ["schön nicht der"] * 2))])
    got = langid.identify_languages(docs, model).collect()
    assert len(got) == 5 and [r.lang_pred for r in got if r.doc_id == 2] == ["und"]
    for r in (r for r in got if r.doc_id in (1, 3)):
        assert r.languages == ["aa", "bb", "cc", "dd"] and all(abs(s - w) < 0.04 for s, w in zip(r.shares, (0.4, 0.3, 0.2, 0.1)))
    assert next(r for r in got if r.doc_id == 4).languages == ["aa", "bb"]


def test_fit_rows_are_drawn_one_by_one(spark, monkeypatch):
    """Rows of one id, of a null id, and rows that are equal in all columns are drawn like any others."""
    for rows in ([(7, f"text {i}") for i in range(4000)], [(None, f"text {i}") for i in range(4000)], [(7, "same")] * 4000):
        drawn = frame(spark, rows).where(scratch.row_draw("doc_id", "text") < 0.05).count()
        assert 100 < drawn < 320
    monkeypatch.setattr(quality, "FIT_ROWS", 100)
    docs = frame(spark, [(7, f"This is some line of text, number {i}.") for i in range(2000)])
    assert quality.train_quality(docs).linear is not None


def test_leaks_with_ids_of_type_int(spark):
    item = " ".join(f"word{i}x" for i in range(30))
    items = spark.createDataFrame([(None, "nothing of it is there " * 4), (5, item)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean text")], "doc_id int, text string")
    got = decontaminate.find_leaks(docs, items)
    assert got.schema["item_id"].dataType.simpleString() == "int" and [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 5)]


def test_chat_roles_come_back_whole(spark):
    roles = ["us\0er", "a\\b", "a\\nb", "a\nb\\", "\\\\n", "<|im_end|>", "<\\|x", ""]
    rows = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(roles)], "conv_id int, turn int, role string, text string")
    chats = chat.format_chats(rows)
    back = chats.select(chat.read_back(F.col("formatted"), F.col("spans"))[0].alias("roles")).first().roles
    assert back == roles


def test_chat_text_with_a_private_character_after_a_rewrite():
    render = lambda turns: ("".join(f"[{t}]" for _, t in turns) if len(turns) < 3 else "new " + "".join(f"({t})" for _, t in turns))
    turns = [("user", "one \ue000 two"), ("assistant", "x\ue000"), ("user", "three")]
    text, spans, rewrites = chat.locate_turns(turns, render, frozenset(["assistant"]))
    assert rewrites and [text[s["text_begin"] : s["text_end"]] for s in spans] == [t for _, t in turns]


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", langid.held_out(F.col("doc_id"), 5, 0).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_toxicity(spark):
    rng = random.Random(8)
    plain = [f"p{i}" for i in range(300)]
    bad = ["grumx", "zorbl", "idiot"]
    rows = []
    for i in range(600):
        toxic = int(i % 6 == 0)
        w = [rng.choice(plain) for _ in range(40)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, KIND + ", toxic int")
    model = toxicity.train_toxicity(df.where("doc_id < 400"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    assert sum((got[i] >= 0.3) == bool(t) for i, _, t in rows[400:]) >= 195
    odd = toxicity.score_toxicity(frame(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.3 for r in odd)
    assert toxicity.train_toxicity(df.where(F.lit(False))).linear is None


def test_label_model_estimates_without_truth():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.2
    right = [0.95, 0.9, 0.85, 0.8, 0.75]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) + 1 for a in right], 1)
    votes[rng.random(votes.shape) < 0.2] = weak.ABSTAIN
    votes = np.concatenate((votes, votes[:, 4:]), 1)  # a voter that only repeats another
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit_votes(rows, counts, prior=0.3, restarts=1)
    assert abs(model.prior - 0.2) < 0.03 and all(abs(a - b) < 0.04 for a, b in zip(model.accuracy(), right))
    assert model.weight[4] < 0.6 and model.weight[5] < 0.6 and model.weight[0] > 0.75
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.96


def test_toxicity_overrules_wrong_labels_and_takes_odd_rows(spark):
    rng = random.Random(18)
    rows = []
    for i in range(900):
        toxic = i % 5 == 0
        w = [f"p{rng.randrange(300)}" for _ in range(40)] + ([rng.choice(["grumx", "zorbl", "idiot"]) for _ in range(4)] if toxic else [])
        rows.append((i, " ".join(w), int(toxic) if i % 10 or i > 120 else 0))  # wrong for thirteen toxic rows
    rows += [(None, "grumx zorbl " + rows[1][1], 1), (None, rows[3][1], 0), (2, rows[2][1], None), (3, rows[3][1], 0), (3, None, 0), (4, "", 0), (6, "LOUD! " * 4000, 0)]
    df = spark.createDataFrame(rows, KIND + ", toxic int")
    model = toxicity.train_toxicity(df)
    assert model.votes.accuracy()[-1] < 0.995
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df.where("doc_id BETWEEN 7 AND 899"), model).collect()}
    assert sum((s >= 0.3) == (i % 5 == 0) for i, s in got.items()) >= 0.98 * len(got)
    assert all(got[i] >= 0.3 for i in range(10, 121, 10))


def test_quality(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(200)]
    junk = [" ".join(word() + rng.choice(["###", "$$$", "%%%"]) for _ in range(40)) for _ in range(20)] + [" ".join(word().upper() + "!!" for _ in range(40)) for _ in range(20)]
    rows = list(enumerate(good + junk))
    df = spark.createDataFrame(rows, KIND)
    model = quality.train_quality(df)
    got = {r.doc_id: r.good for r in quality.score_quality(df, model).collect()}
    assert sum(got[i] for i in range(200)) >= 198 and sum(got[i] for i in range(200, 240)) <= 2
    assert [r.score for r in quality.score_quality(frame(spark, ODD[:3]), model).collect()] == [0.0, 0.0, 0.0]
    assert quality.train_quality(df.where(F.lit(False))).linear is None


def test_leaks(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}x" for i in range(4000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 90))] for _ in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(80)]
    whole, gone = [], [rng.choice(vocabulary) for _ in range(100)]
    for k in range(10):
        rows.append((1000 + k, " ".join(gone[: k * 7] + [w.upper() + "," for w in items[k]] + gone)))
        changed = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in items[k]]
        rows.append((2000 + k, " ".join(gone + changed + gone)))
        whole += [(1000 + k, k), (2000 + k, k)]
    bench = spark.createDataFrame([(k, " ".join(x), "clash") for k, x in enumerate(items)] + [(98, None, ""), (99, " ", "")], "item_id long, text string, item string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, rows + ODD), bench).collect()}
    assert {p for p in whole if p[0] < 2000} <= got <= set(whole) and len(got) >= 18
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark), bench.where(F.lit(False))).count() == 0


def test_leaks_recall_and_brute_force(spark, monkeypatch):
    """Verbatim and paraphrased passages, one longer than a segment's old overlap and across its end, against a plain search."""
    monkeypatch.setattr(decontaminate, "SEGMENT", 256)
    rng = random.Random(20)
    vocabulary = [f"v{i}x" for i in range(5000)]
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary)
    items = [[word() for _ in range(rng.choice([8, 20, 60, 120]))] for _ in range(60)] + [[word() for _ in range(1500)]]
    rows, exact_ones, changed_ones = [], set(), set()
    for k, item in enumerate(items):
        pad = [word() for _ in range(rng.randint(0, 700))]
        rows.append((k, " ".join(pad + item + [word() for _ in range(200)])))
        exact_ones.add((k, k))
        changed = [w for w in item if rng.random() > 0.08]
        changed = [word() if rng.random() < 0.1 else w for w in changed]
        rows.append((1000 + k, " ".join(pad + changed + [word() for _ in range(200)])))
        share = decontaminate.common_subsequence(item, changed) / len(item)
        if share >= decontaminate.SAME:
            changed_ones.add((1000 + k, k))
    rows += [(5000 + i, " ".join(word() for _ in range(400))) for i in range(60)] + [(None, " ".join(items[0])), (9000, None)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.find_leaks(spark.createDataFrame(rows, KIND), bench).collect()}
    assert len(exact_ones & set(got)) >= 0.98 * len(exact_ones) and (60, 60) in got and (None, 0) in got
    assert len(changed_ones & set(got)) >= 0.9 * len(changed_ones)
    texts = dict(rows)
    for (d, k), share in got.items():  # no pair but what a plain comparison with the whole text finds
        assert d is None or share <= decontaminate.common_subsequence(items[k], texts[d].split()) / len(items[k]) + 1e-9
        assert d is None or d % 1000 == k or share >= decontaminate.ALIKE


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(11)
    for _ in range(50):
        a, b = [[rng.randrange(6) for _ in range(rng.randint(1, 90))] for _ in range(2)]
        assert decontaminate.common_subsequence(a, b) == plain(a, b)
