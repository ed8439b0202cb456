import random

import corpus_pipeline


def test_pipeline_keeps_what_each_stage_should(spark, tmp_path):
    rng = random.Random(12)
    english = ["the", "of", "and", "this", "other", "thing", "with", "where"]
    vocabulary = [f"{a}{b}er" for a in ("th", "wh", "st", "pr") for b in "aeioulmnrst"] + english
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(300)) for _ in range(n))
    clean = [(i, text(120), "en", f"s{i % 3}") for i in range(60)]
    near = [(100 + i, clean[i][1].replace(" ", " ", 1) + " extra", "en", "s0") for i in range(10)]
    item = text(40)
    leak = [(200, text(50) + " " + item + " " + text(50), "en", "s1")]
    junk = [(300, "123 !! 456", None, "s1"), (301, None, None, "s2"), (302, "", "en", None)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in clean + near + leak + junk]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        after[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    assert set(after["language"]) == everything - {300, 301, 302}
    assert set(after["near_duplicates"]) == everything - {300, 301, 302} - {r[0] for r in near}
    assert after["decontamination"] == [r[0] for r in clean]
    assert set(after["mixing"]) <= set(after["decontamination"]) and all(after["mixing"].count(i) <= 2 for i in set(after["mixing"]))
    assert after["sharding"] == after["mixing"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == after["sharding"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_by_row_where_ids_are_null_or_repeated(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = [f"{a}{b}er" for a in ("th", "wh", "st", "pr") for b in "aeioulmnrst"] + ["the", "of", "and", "with"]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(300)) for _ in range(n))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = lambda stage, rows: sorted(((r.doc_id, r.text, r.source) for r in stage(spark, frame(rows), str(tmp_path)).collect()), key=str)
    item = text(40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(i, text(120), "s0") for i in [*range(-5, 15), *[None] * 8, *[7] * 4]]

    assert after(corpus_pipeline.language, clean + [(None, "12 !! 3", "s0"), (7, None, "s0"), (7, "45 6", "s0")]) == sorted(clean, key=str)
    leaks = [(i, text(50) + " " + item + " " + text(50), "s1") for i in (None, 7)]
    assert after(corpus_pipeline.decontamination, clean + leaks) == sorted(clean, key=str)

    copied = {r: r[1] + " extra" for r in (clean[0], clean[22], clean[24], clean[30])}
    copies = [(i, t, "s0") for t in copied.values() for i in (None, None, 99, 99)] + [clean[3]] * 3 + [clean[25]] * 3 + [(None, "", "s0")] * 2
    got = after(corpus_pipeline.near_duplicates, clean + copies)
    keep = [r for r in clean if r[0] is not None or r not in copied]
    assert [r for r in got if r[0] != 99] == sorted(keep + [(None, "", "s0")] * 2, key=str)
    assert sorted(r[1] for r in got if r[0] == 99) == sorted(t for r, t in copied.items() if r[0] is None)

    two = [(i, t, "s0" if n % 2 else "s1") for n, (i, t, _) in enumerate(clean)] + [(None, clean[0][1], "s1")] * 3
    took = {k: sum(r[2] == k for r in after(corpus_pipeline.mixing, two)) for k in ("s0", "s1")}
    words = {k: sum(len(r[1].split()) for r in two if r[2] == k) for k in ("s0", "s1")}
    want = targets_by_hand([words["s0"], words["s1"]])
    assert all(abs(took[k] * 120 - w) <= 120 for k, w in zip(("s0", "s1"), want))


def targets_by_hand(sizes):
    """Weights 5 and 2 of half as much again, twice its own for a source at most."""
    first = min(2 * sizes[0], 1.5 * sum(sizes) * 5 / 7)
    return [first, min(2 * sizes[1], 1.5 * sum(sizes) - first)]


def test_stages_with_columns_of_clashing_names(spark, tmp_path):
    """Given columns named as the stages' own come through every stage as they were."""
    rng = random.Random(14)
    vocabulary = [f"{a}{b}er" for a in ("th", "wh", "st", "pr") for b in "aeioulmnrst"] + ["the", "of", "and", "with"]
    names = ["key", "again", "times", "mixed", "nth", "gone", "equal", "row", "score", "component_id", "id", "size"]
    rows = [(i % 30, " ".join(rng.choice(vocabulary) + str(rng.randrange(300)) for _ in range(100)), "en", "s0", 1, *[f"{n}{i}" for n in names]) for i in range(40)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows + rows[:2], kind)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == kind.replace(" long", "").replace(" string", "").split(", ")
        assert set(map(tuple, docs.collect())) <= set(rows) and docs.count() >= 40
    assert corpus_pipeline.sharding(spark, docs, str(tmp_path)).count() == docs.count()
