import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.sources import history, sinks
from tidemark.streaming import commands as streams


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_histories(spark, tmp_path):
    write(tmp_path / "u.zsh_history", b"old one\n: 1748851200:3;git status\n: 1748851201:0;echo \\\nmore\nlost line\n:: kept\n: 1748851202:0;bad \xff byte\n")
    write(tmp_path / "u.bash_history", "#1698544800\n#1698544801\nmake all\nplain\n#99\n")
    write(tmp_path / "fish_history", "- cmd: ls -la\n  when: 1700000000\n- cmd: a\\nb\n")
    write(tmp_path / "ConsoleHost_history.txt", "Get-Item `\nx\n\ndir\n")
    rows = history.read_histories(spark, str(tmp_path / "*history*"))
    got = {}
    for r in rows.orderBy("path", "position").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.timestamp, r.command))
    assert got["u.zsh_history"] == [(None, "old one"), (1748851200, "git status"), (1748851201, "echo more"), (None, ":: kept"), (1748851202, "bad � byte")]
    assert got["u.bash_history"][:2] == [(1698544801, "make all"), (None, "plain")]
    assert got["fish_history"] == [(1700000000, "ls -la"), (None, "a b")]
    assert got["ConsoleHost_history.txt"] == [(None, "Get-Item x"), (None, "dir")]


ODD_HISTORIES = {
    "zsh": [": 17488{0:05d}:3;git add {0}", ": 17488{0:05d}:0;echo {0} \\", "more {0}", "lost {0}", "lost {0} \\", ":: kept {0}", ":: kept {0} \\", ": 17488{0:05d}:0;", "", "__ts_hook {0}", " : 5:5;no stamp", ": 99999999999999999999:1;far {0}"],
    "bash": ["#16985{0:05d}", " #16985{0:05d}", "make {0}", "plain {0} \\", "", "  ", "echo {0}\\", "# note {0}", "#99"],
    "fish": ["- cmd: ls {0}", "  when: 17000{0:05d}", "  paths:", "    - a{0}", "- cmd: a\\n{0}", "- cmd: ", "  when: soon", "junk {0}"],
    "powershell": ["Get-Item {0} `", "x{0}", "", "dir {0}", "   ", "a {0}`"],
}


def odd_history(kind, seed, n):
    rng = random.Random(seed)
    first = [": 1748800000:0;begin"] if kind == "zsh" and seed % 2 else []
    lines = first + [rng.choice(ODD_HISTORIES[kind]).replace("__ts_hook", history.HOOKS[0]).format(rng.randrange(300)) for _ in range(n)]
    return "\n".join(lines).encode() + rng.choice([b"", b"\n", b" \xff\xc3\n"])


@pytest.mark.parametrize("kind", list(ODD_HISTORIES))
def test_ranges_of_a_history_hold_each_record_once(kind, monkeypatch):
    """Every way of cutting gives the records of the whole, also where the search for a beginning starts with few bytes."""
    monkeypatch.setattr(history, "BACK", 8)
    for seed in range(12):
        content = odd_history(kind, seed, 60)
        file = io.BytesIO(content)
        whole = list(history.records(file, kind, 0, len(content), False))
        assert seed > 3 or whole
        for size in (1, 7, 40, 333):
            if kind == "zsh" and not seed % 2:
                break  # such a file stays whole
            parts = [r for at in range(0, len(content), size) for r in history.records(file, kind, at, min(at + size, len(content)), kind == "zsh" and at > 0)]
            assert parts == whole, (seed, size)
        for end in range(0, len(content), 13):  # what is settled is never taken back
            to = history.settled(io.BytesIO(content[:end]), end, kind)
            stamped = kind == "zsh" and history._stamped_before(file, to)
            assert list(history.records(io.BytesIO(content[:end]), kind, 0, to, False)) + list(history.records(file, kind, to, len(content), stamped)) == whole, (seed, end)


def test_history_source_does_not_depend_on_ranges(spark, tmp_path):
    for kind, name in (("zsh", ".zsh_history"), ("bash", ".bash_history"), ("fish", "fish_history"), ("powershell", "ConsoleHost_history.txt")):
        (tmp_path / kind).mkdir()
        write(tmp_path / kind / name, odd_history(kind, 5, 400))
    write(tmp_path / "zsh" / "plain.zsh_history", "a\nb \\\nc\n" * 50 + ": 1748851200:3;git status\nlost\n")
    write(tmp_path / "zsh" / "_SUCCESS", "x")
    write(tmp_path / "zsh" / ".part.crc", "x")
    write(tmp_path / "bash" / "empty_history", "")
    rows = lambda n: sorted((r.path, r.position, r.timestamp or 0, r.command) for r in history.read_histories(spark, "file://" + str(tmp_path), split_bytes=n).collect())
    whole = rows(1 << 20)
    assert {r[0].rsplit("/", 1)[-1] for r in whole} == {".zsh_history", ".bash_history", "fish_history", "ConsoleHost_history.txt", "plain.zsh_history"}
    assert rows(700) == whole and sum(r[0].endswith("plain.zsh_history") for r in whole) == 101
    with pytest.raises(Exception, match="FileNotFound"):
        history.read_histories(spark, str(tmp_path / "none")).collect()


def test_stream_of_growing_histories(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    contents = {"a.zsh_history": odd_history("zsh", 7, 120), "fish_history": odd_history("fish", 3, 120), "u.bash_history": odd_history("bash", 4, 120) + b"end\n"}
    rounds = 3
    for i in range(1, rounds + 1):
        for name, content in contents.items():
            write(folder / name, content[: len(content) * i // rounds])
        q = history.stream_histories(spark, str(folder), split_bytes=500).writeStream.format("parquet").option("path", str(tmp_path / "t")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    key = lambda r: (r.path, r.position, r.timestamp or 0, r.command)
    got = sorted(key(r) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    files = [r.path for r in history.listed(str(folder), None)]
    waits = {p: history.settled(io.BytesIO(contents[p.rsplit("/", 1)[-1]]), len(contents[p.rsplit("/", 1)[-1]]), history.kind_of(p)) for p in files}
    assert got == sorted(k for k in map(key, history.read_histories(spark, str(folder)).collect()) if k[1] < waits[k[0]]) and len(got) > 60


def test_merge_keeps_the_first(spark):
    df = spark.createDataFrame([("b", 1, 5, 0, "ls", 1), ("a", 1, 5, 0, "ls", 2), ("a", 2, None, 0, "ls", 3)], "path string, position long, timestamp long, duration long, command string, user_id long").drop("user_id")
    got = history.merge_histories(df, []).collect()
    assert sorted((r.path, r.timestamp) for r in got if r.timestamp) == [("a", 5)] and len(got) == 2


def test_commit_log(spark, tmp_path):
    write(tmp_path / "log.txt", "h1|100|add | pipe\nbroken\nh2|x|y\n|5|z\n")
    assert [tuple(r) for r in history.read_commit_log(spark, str(tmp_path / "log.txt")).collect()] == [("h1", 100, "add | pipe")]
    write(tmp_path / "num.txt", "3\t1\ta.py\n-\t-\tb.png\n4\t0\tc.py\n")
    assert tuple(history.read_change_volume(spark, str(tmp_path / "num.txt")).first()) == (7, 1)


def test_merged_branches(spark):
    m = spark.createDataFrame([(0, "Merge branch 'x'"), (1, "Merge pull request #3 from u/y"), (2, "Merge branch 'x'"), (3, "z")], "position long, message string")
    assert [r.branch for r in history.merged_branches(m).orderBy("position").collect()] == ["x", "y"]


def test_exports_block_whole_sessions(spark):
    s = spark.createDataFrame([(1, 0, 60, 60, None, False), (2, 0, 0, 0, None, False)], "id long, start_time long, end_time long, duration_seconds long, project_id long, is_legacy boolean")
    c = spark.createDataFrame([(1, 1, 0, "vault read x", 0, False), (1, 2, 5, "ls", 0, False)], "session_id long, id long, timestamp long, command string, exit_code int, is_legacy boolean")
    links = spark.createDataFrame([(1, "abcdef123", 3, "fix: x")], "session_id long, hash string, t long, message string")
    p = spark.createDataFrame([], "id long, name string, path string")
    nested = sinks.nested_export(s, c, links, p)
    rows = sinks.csv_export(nested).orderBy("session_id").collect()
    assert [r.command for r in rows] == ["[BLOCKED]", "[BLOCKED]", None] and rows[0].commits == "abcdef1: fix: x"
    assert sinks.markdown_export(nested).count() == 2
    assert sinks.journal(s, c, p).count() == 1


def feed(spark, tmp_path, parts, schema):
    source = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))


def test_stream_sessions_equal_batch(spark, tmp_path):
    schema = "user_id long, ts timestamp, command string"
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s, __import__("datetime").UTC)
    parts = [[(1, at(0), "a"), (1, at(1800), "b")], [(1, at(3601), "c"), (1, at(99999), "d")], [(1, at(199999), "e")]]
    out = streams.stream_sessions(feed(spark, tmp_path, parts, schema), ["user_id"])
    q = out.writeStream.outputMode("append").format("memory").queryName("stream_sessions_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.n_commands, (r.end - r.start).total_seconds()) for r in spark.table("stream_sessions_test").collect())
    assert (2, 1800.0) in got and (1, 0.0) in got


def test_stream_upsert_runs_again_without_change(spark, tmp_path):
    schema = "user_id long, timestamp long, command string"
    parts = [[(1, 5, "a"), (1, 5, "a")], [(1, 5, "a"), (1, 6, "b")]]
    empty = spark.createDataFrame([], schema)
    merge = lambda old, new: old.unionByName(new).distinct()
    q = streams.upsert_stream(feed(spark, tmp_path, parts, schema), merge, empty, str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    versions = sorted((tmp_path / "t").iterdir(), key=lambda p: int(p.name[1:]))
    assert spark.read.parquet(str(versions[-1])).count() == 2


def test_stream_distinct(spark, tmp_path):
    schema = "user_id long, ts timestamp, command string"
    t = __import__("datetime").datetime(2024, 1, 1)
    out = streams.stream_distinct(feed(spark, tmp_path, [[(1, t, "a")], [(1, t, "a"), (1, t, "b")]], schema), ["user_id"])
    q = out.writeStream.outputMode("append").format("memory").queryName("stream_distinct_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("stream_distinct_test").count() == 2


def test_scan_of_late_rows_can_be_sessioned_again(spark):
    from tidemark.operators.store import resession

    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 900)], "user_id long, id long, timestamp long")
    assert resession(rows, ["user_id"]).select("session_id").distinct().count() == 1
    assert resession(rows.where(F.lit(False)), ["user_id"]).count() == 0


def test_consolidated_stream_equals_a_batch(spark, tmp_path):
    kind = "user_id long, id long, timestamp long, command string"
    rows = [(u, 10 * n + u, 1000 * u + t, f"make part{n}") for u in (1, 2) for n, t in enumerate((0, 60, 5000, 5030, 5090, 20000, 20010, 40000))]
    done = spark.createDataFrame([], "user_id long, start_time long, end_time long, summary string, commands array<string>")
    at = {}
    for batch, upto in enumerate((3, 5, 8)):  # the second part continues a chunk that the first one leaves open
        part = [r for r in rows if (r[1] - r[0]) // 10 < upto and (r[1] - r[0]) // 10 >= (0, 3, 5)[batch]]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at["now"] = max(r[2] for r in part) + 100
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        streams.consolidate_stream(stream, ["user_id"], done, str(tmp_path / "out"), str(tmp_path / "state"), lambda: at["now"], every=None).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "chunks")).drop("batch")
    want = store.consolidate(spark.createDataFrame(rows, kind), done, ["user_id"], at["now"])
    pick = lambda df: sorted((r.user_id, r.start_time, r.end_time, r.summary) for r in df.collect())
    assert pick(got) == pick(want) and len(pick(got)) == 6
    assert spark.read.parquet(str(tmp_path / "out" / "waiting" / "v3")).count() == 2
