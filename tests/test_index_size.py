import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import index
from tidemark.operators.index import StoredIndex
from tidemark.operators.search import tokens


def test_words_are_counted_in_place(spark):
    texts = ["b a b c a b", "", None, "one", "x " * 300 + "y", "  ,"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    counted = rows.select("i", F.explode(index._counted(tokens(F.col("text")))).alias("x"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.x.term): r.x.tf for r in counted.collect()}
    assert got == {(i, w): n for i, t in enumerate(texts) for w, n in Counter((t or "").replace(",", " ").split()).items()}


def test_more_text_is_more_tasks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("d", str(i), f"word{i} other{i % 7} same") for i in range(200)], "type string, ref string, text string")
    files = {}
    for size in (1 << 25, 500):
        monkeypatch.setattr(index, "TASK_BYTES", size)
        made = StoredIndex(spark, f"{tmp_path}/{size}", create=True)
        made.add(rows)
        files[size] = {r.file for r in made._read("files", index.FILES).select("file").collect()}, {(r.term, r.docs) for r in made.postings([("a", "z")]).collect()}
    assert len(files[1 << 25][0]) <= 4 < len(files[500][0]) and files[1 << 25][1] == files[500][1]


def test_blocks_of_many_pieces(spark):
    """Pieces of a few tokens, in any order, merge into whole blocks; fewer rows are shuffled than words of documents."""
    rng = random.Random(3)
    docs = [(i, i // 16, i % 16, [rng.choice(["a", "b", "é", "x" * 9]) for _ in range(i % 12)]) for i in range(100)]
    rng.shuffle(docs)
    rows = spark.createDataFrame([(i, r, o, len(w), w) for i, r, o, w in docs] + [(100, 6, 4, 0, None)], "doc long, range long, offset smallint, n int, words array<string>").repartition(3)
    want: dict[tuple, list] = {}
    for i, r, o, words in sorted(docs):
        for w, k in Counter(words).items():
            want.setdefault((w, r), []).append((o, k, i % 12))
    for most in (1, 60, 1_000_000):
        runs = index._runs(rows, most)
        blocks = index._merged(runs.repartitionByRange(2, "term", "range").sortWithinPartitions("term", "range"))
        got = {(b.term, b.range): b for b in blocks.collect()}
        assert {k: list(zip(b.offsets, b.tfs, b.lens)) for k, b in got.items()} == want
        assert all((b.docs, b.tf_max, b.len_min) == (len(b.offsets), max(b.tfs), min(b.lens)) for b in got.values())
    assert runs.count() < sum(len(x) for x in want.values()) / 2
