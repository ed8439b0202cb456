"""Ranked search over sessions: postings, prefix matches, exactness tiers, BM25, vectors."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import same_rows, with_project, with_tags
from tidemark.operators.store import FAR_FUTURE, matches_project
from tidemark.tables import written

TOKEN = r"[\p{L}\p{N}_]+"
K1, B = 1.5, 0.75
FOLLOWED = 256  # vectors that are compared with all clusters of a group at once
FOLLOWED_CELLS = 8_000_000  # numbers in such a product, at most


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, ref, tf): one row per term and document, pre-aggregated within tasks."""
    words = docs.select(F.col(id_col).alias("ref"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("term", "ref").agg(F.count("*").alias("tf"))


def index_rows(commands: DataFrame, commits: DataFrame, sessions: DataFrame) -> DataFrame:
    """(type, ref, text): commands and summaries refer to sessions, commits to their hash."""
    a = commands.select(F.lit("command").alias("type"), F.col("session_id").cast("string").alias("ref"), F.col("command").alias("text"))
    b = commits.select(F.lit("commit"), F.col("hash"), F.col("message"))
    return a.union(b).union(sessions.where("ai_summary IS NOT NULL").select(F.lit("summary"), F.col("id").cast("string"), "ai_summary")) if "ai_summary" in sessions.columns else a.union(b)


def prefix_match(text: Column, query: str, every: bool = True) -> Column:
    """Whether all (or any) of the query's words are in the text, each as a phrase whose last token is a prefix."""
    out = None
    for word in query.split():
        quoted = r"[^\p{L}\p{N}_]+".join(p for p in re.findall(r"\w+", word.lower()))
        if not quoted:
            continue
        hit = F.lower(text).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){quoted}")
        out = hit if out is None else (out & hit if every else out | hit)
    return F.lit(False) if out is None else out


def exactness_tier(sessions: DataFrame, commands: DataFrame, projects: DataFrame, query: str) -> DataFrame:
    """(id, tier): 0 exact command, 1 command prefix, 2 exact project, 3 project prefix, 4 in a project, 5 in a command, 6 other.

    Flags are computed per command and per session and the least one kept;
    project names count at both levels; the query is literal, without case.
    """
    q = query.strip().lower()
    c, p = F.lower(F.trim("command")), F.lower(F.coalesce(F.trim("project_name"), F.lit("")))
    of_command = F.when(c == q, 0).when(c.startswith(q), 1).when(c.contains(q), 5).otherwise(6)
    of_project = F.when(p == q, 2).when(p.startswith(q), 3).when(p.contains(q), 4).otherwise(6)
    a = with_project(commands, projects).select(F.col("session_id").alias("id"), F.least(of_command, of_project).alias("tier"))
    b = with_project(sessions, projects).select("id", of_project.alias("tier"))
    return a.unionByName(b).groupBy("id").agg(F.min("tier").alias("tier"))


def _newest(found: DataFrame, first: list[Column], limit: int | None) -> DataFrame:
    """Ranked, of equals the newest first; without a limit all, in no order."""
    return found if limit is None else found.orderBy(*first, F.col("start_time").desc(), F.col("id").desc()).limit(limit)


def standard_search(sessions: DataFrame, commands: DataFrame, commits: DataFrame, projects: DataFrame, query: str, since: int | None = None, until: int | None = None, limit: int | None = 50) -> DataFrame:
    """Sessions with the query in a command, a project name or a linked commit: best tier, then newest. A blank query lists all.

    ``commits`` has session_id and message. The query's % and _ are wildcards.
    """
    chosen = sessions
    if since is not None:
        chosen = chosen.where(F.col("start_time") >= since)
    if until is not None:
        chosen = chosen.where(F.col("start_time") <= until)
    if not query.strip():
        return _newest(chosen.withColumn("tier", F.lit(6)), [], limit)
    like = f"%{query.strip()}%"
    found = commands.where(F.col("command").ilike(like)).select(F.col("session_id").alias("id"))
    found = found.union(with_project(sessions, projects).where(F.col("project_name").ilike(like)).select("id")).union(commits.where(F.col("message").ilike(like)).select("session_id"))
    hits = written(chosen.join(found.distinct(), "id", "left_semi"), "hits")
    tier = exactness_tier(hits, commands.join(hits.select(F.col("id").alias("session_id")), "session_id", "left_semi"), projects, query)
    return _newest(hits.join(tier, "id"), [F.col("tier")], limit)


def index_is_current(rows: DataFrame, commands: DataFrame) -> bool:
    """Whether the index has each session's commands as often as the base has them."""
    base = commands.where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n"))
    indexed = rows.where("type = 'command'").groupBy(F.col("ref").cast(base.schema["session_id"].dataType).alias("session_id")).agg(F.count("*").alias("n"))
    return same_rows(base, indexed)


def index_differences(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """(type, ref, indexed, found): references whose texts the index and ``fresh`` do not hold equally often.

    The numbers count the texts that one side has more often. Both sides are
    added up together, so a reference is one row after one shuffle.
    """
    side = lambda df, n: df.select("type", "ref", "text", F.lit(n).alias("n"))
    texts = side(rows, 1).unionByName(side(fresh, -1)).groupBy("type", "ref", "text").agg(F.sum("n").alias("n")).where("n <> 0")
    more = lambda n: F.sum(F.greatest(n, F.lit(0)))
    return texts.groupBy("type", "ref").agg(more(F.col("n")).alias("indexed"), more(-F.col("n")).alias("found"))


def sync_index(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with all rows of the references in ``fresh`` replaced by those; other references stay untouched."""
    return rows.join(fresh.select("type", "ref").distinct(), ["type", "ref"], "left_anti").unionByName(fresh)


def advanced_search(
    sessions: DataFrame, commands: DataFrame, commits: DataFrame, projects: DataFrame, query: str = "", project: str | None = None, since: int | None = None, until: int | None = None,
    tags: DataFrame | None = None, wanted_tags: tuple[str, ...] = (), index: DataFrame | None = None, limit: int | None = 50, offset: int = 0,
) -> DataFrame:
    """One search over sessions: query, project, range and tags narrow it; then exactness, relevance and recency rank it.

    An ``index`` (see ``index_rows``) is used where it has what the base has;
    else, and for a blank query, the base is searched. Bounds are inclusive.
    Returns id, start_time, tier and score (0 without an index), the ``limit``
    rows (None: all) after the first ``offset``.
    """
    chosen = sessions.where(F.col("start_time").between(since if since is not None else 0, until if until is not None else FAR_FUTURE))
    # Each step is written, so that no task holds the sorts of all steps at once and only what is left goes on.
    if project:
        chosen = written(matches_project(chosen, commands, projects, project), "of_project")
    if wanted_tags:
        of_chosen = tags.join(chosen.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        chosen = written(with_tags(chosen, of_chosen, list(wanted_tags)), "tagged")
    if query.strip() and index is not None and index_is_current(index, commands):
        found = index_search(index, chosen, commands, projects, query, limit=None)
    else:
        found = standard_search(chosen, commands, commits, projects, query, limit=None).withColumn("score", F.lit(0.0))
    order = [F.col("tier"), F.col("score").desc(), F.col("start_time").desc(), F.col("id").desc()]
    out = found.select("id", "start_time", F.col("tier").cast("int").alias("tier"), "score").orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def index_search(rows: DataFrame, sessions: DataFrame, commands: DataFrame, projects: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """Sessions with all query words as prefixes within one indexed command, ranked by tier, BM25 and recency."""
    hits = rows.where((F.col("type") == "command") & prefix_match(F.col("text"), query)).select(F.col("ref").cast("long").alias("id")).distinct()
    docs = commands.join(hits.select(F.col("id").alias("session_id")), "session_id", "left_semi").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("command")), " ").alias("text"))
    ranked = bm25(docs, "session_id", "text", query.split()).withColumnRenamed("session_id", "id")
    chosen = sessions.join(hits, "id", "left_semi")
    tier = exactness_tier(chosen, commands.join(hits.select(F.col("id").alias("session_id")), "session_id", "left_semi"), projects, query)
    return _newest(chosen.join(tier, "id").join(ranked, "id", "left").fillna(0.0, ["score"]), [F.col("tier"), F.col("score").desc()], limit)


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str]) -> DataFrame:
    """Scores over all documents; repeated query terms add again; documents without a term have no row.

    Only the query's terms are kept after tokenising, so the shuffle carries
    matches, not postings of the whole corpus.
    """
    terms = [t.lower() for t in query]
    words = tokens(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("__id"), words.alias("__w"), F.size(words).alias("__n"))
    stats = sized.agg(F.count("*").alias("docs"), F.sum("__n").alias("total"))
    wanted = F.array(*map(F.lit, sorted(set(terms))))
    kept = sized.select("__id", "__n", F.explode(F.filter("__w", lambda w: F.array_contains(wanted, w))).alias("term"))
    tf = kept.groupBy("__id", "__n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.lit(0)
    for t in sorted(set(terms)):
        weight = F.when(F.col("term") == t, terms.count(t)).otherwise(weight)
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1 + 1e-9)
    mean = F.col("total") / (F.col("docs") + 1e-9)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("__n") / mean)) * weight
    return scored.groupBy("__id").agg(F.sum(part).alias("score")).withColumnRenamed("__id", id_col)


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def session_documents(sessions: DataFrame, commands: DataFrame, linked_commits: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, text): the project's name three times, then commands and commits."""
    c = commands.groupBy(F.col("session_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", F.col("id").alias("c"), "command"))), lambda x: x["command"]).alias("c"))
    m = linked_commits.groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list("message")).alias("m"))
    name = F.coalesce("project_name", F.lit(""))
    parts = F.concat(F.array(name, name, name), F.coalesce("c", F.array().cast("array<string>")), F.coalesce("m", F.array().cast("array<string>")))
    return with_project(sessions, projects).join(c, "id", "left").join(m, "id", "left").select("id", "start_time", F.array_join(parts, " ").alias("text"))


def ask(documents: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Prefix BM25 on words plus exact BM25 on word pairs, over documents with any query word; ties to the newest, then the least id.

    A term with an underscore counts as a pair. Scores tie in their first nine
    decimals: the sum's last bits depend on the order in which its parts arrive.
    """
    q = re.findall(r"\w+", query.lower())
    pairs = [f"{a}_{b}" for a, b in zip(q, q[1:])]
    terms = q + pairs
    words = tokens(F.col("text"))
    docs = documents.withColumn("w", words).where(prefix_match(F.col("text"), query, every=False))
    docs = docs.withColumn("all", F.concat("w", bigrams(F.col("w")))).withColumn("n", F.size("w"))
    stats = docs.agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    hit = lambda t: (lambda x: x == t) if "_" in t else (lambda x: x.startswith(t))
    counts = docs.select("id", "start_time", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.size(F.filter("all", hit(t))).alias("tf")) for i, t in enumerate(terms)])).alias("x")).select("id", "start_time", "n", "x.i", "x.tf").where("tf > 0")
    df = counts.groupBy("i").agg(F.count("*").alias("df"))
    scored = counts.join(F.broadcast(df), "i").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1 + 1e-9)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (F.col("total") / (F.col("docs") + 1e-9))))
    return scored.groupBy("id", "start_time").agg(F.sum(part).alias("score")).orderBy(F.round("score", 9).desc(), F.col("start_time").desc(), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def nearest(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, k: int) -> DataFrame:
    return vectors.select(id_col, cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])).alias("score")).orderBy(F.col("score").desc(), id_col).limit(k)


def hybrid(lexical: DataFrame, semantic: DataFrame, id_col: str, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """Both scores scaled to 0..1 over the candidates and mixed; without any lexical score all get 0.5."""
    both = semantic.withColumnRenamed("score", "s").join(lexical.withColumnRenamed("score", "l"), id_col, "left").fillna(0.0, ["l"])
    bounds = both.agg(*[f(c).alias(f"{c}_{name}") for c in ("s", "l") for name, f in (("low", F.min), ("high", F.max))])
    both = both.crossJoin(F.broadcast(bounds))  # one row

    def scaled(c: str) -> Column:
        return (F.col(c) - F.col(f"{c}_low")) / F.greatest(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(1e-9))

    flat = F.col("l_high") == 0
    both = both.select(id_col, scaled("s").alias("semantic"), F.when(flat, 0.5).otherwise(scaled("l")).alias("lexical"), flat.alias("no_lexical"))
    return both.withColumn("score", alpha * F.col("semantic") + (1 - alpha) * F.col("lexical")).orderBy(F.col("score").desc(), id_col).limit(k)


def expand_queries(queries: DataFrame, anchors: DataFrame, most: int = 8) -> DataFrame:
    """queries: id, query; anchors: word, anchor. The query with up to ``most`` anchors of its words that it lacks, in order."""
    words = queries.select("id", "query", F.posexplode(tokens(F.col("query"))).alias("pos", "word"))
    found = words.join(anchors, "word").where(~F.lower("query").contains(F.col("anchor"))).groupBy("id", "anchor").agg(F.min("pos").alias("pos"))
    added = found.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "anchor"))), lambda x: x["anchor"]), 1, most).alias("added"))
    return queries.join(added, "id", "left").select("id", F.concat_ws(" ", "query", F.array_join("added", " ")).alias("query"))


def verbalise(text: Column, meanings: dict[str, str]) -> Column:
    """Each known word is followed by its meaning in brackets."""
    known = F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.concat(w, F.lit(" ("), F.try_element_at(known, w), F.lit(")")), w)), " ")


def populate(results: DataFrame, commands: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """Search results with all and matching commands, and their commits (links: session_id, t, message)."""
    q = query.strip().lower()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", "command"))), lambda x: x["command"])
    c = commands.groupBy("session_id").agg(ordered.alias("commands"))
    m = links.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "message"))), lambda x: x["message"]).alias("commits"))
    out = results.join(c.withColumnRenamed("session_id", "id"), "id", "left").join(m.withColumnRenamed("session_id", "id"), "id", "left")
    return out.withColumn("matching", F.filter("commands", lambda x: F.lower(x).contains(q)))


def search_projects(projects: DataFrame, query: str) -> DataFrame:
    """Exact name, prefix, substring, then path; then by name."""
    q, name = query.lower(), F.lower("name")
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2).otherwise(3)
    return projects.where(F.col("name").ilike(f"%{query}%") | F.col("path").ilike(f"%{query}%")).withColumn("rank", rank).orderBy("rank", "name", "id")


def three_source_search(commands: DataFrame, summaries: DataFrame, daily: DataFrame, sessions: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, match_type): 1 command, 2 summary, 3 daily summary; the best per session, newest first."""
    hit = lambda df, c, kind: df.where(prefix_match(F.col(c), query)).select(F.col("session_id").alias("id"), F.lit(kind).alias("match_type"))
    every = hit(commands, "command", 1).unionByName(hit(summaries, "summary", 2)).unionByName(hit(daily, "summary", 3))
    best = every.groupBy("id").agg(F.min("match_type").alias("match_type"))
    return sessions.join(best, "id").orderBy("match_type", F.col("start_time").desc(), F.col("id").desc()).limit(limit)


def command_clusters(commands: DataFrame, by: list[str]) -> DataFrame:
    """Distinct commands grouped by first word, groups and members in first-seen order."""
    per = commands.withColumn("text", F.trim("command")).groupBy(*by, "text").agg(F.min(F.struct("timestamp", "id")).alias("first"))
    word = F.regexp_extract("text", r"^(\S+)", 1)
    return per.groupBy(*by, word.alias("word")).agg(F.min("first").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]).alias("commands"))


def _follow(vectors: np.ndarray, totals: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cluster of each vector in turn, and the sums and sizes of the clusters after them.

    A block of vectors is multiplied with the directions of all clusters at once,
    in single precision; those changed within the block are multiplied again for
    each vector. What reaches the threshold, less what rounding can take, is
    decided in double precision, so the result is that of the plain loop.
    """
    n, width, k = len(vectors), vectors.shape[1], len(counts)
    sums, sizes = np.zeros((k + n, width)), np.zeros(k + n, np.int64)
    sums[:k], sizes[:k] = totals, counts
    length = lambda x: np.sqrt((x * x).sum(axis=-1, keepdims=True))
    with np.errstate(all="ignore"):
        unit = lambda x: np.where(length(x) > 0, x / length(x), 0.0).astype(np.float32)
        means, asked = np.zeros((k + n, width), np.float32), unit(vectors)
        means[:k] = unit(totals / counts[:, None])
        least = np.float32(threshold - (width + 8) * 2.4e-7)
        out, at = np.empty(n, np.int64), 0
        while at < n:
            block, known = asked[at : at + max(1, min(FOLLOWED, FOLLOWED_CELLS // max(1, k)))], k
            like = block @ means[:known].T >= least
            moved: list[int] = []  # clusters of before the block that have changed in it
            for j in range(len(block)):
                v, own = vectors[at], np.flatnonzero(like[j])
                fresh = known + np.flatnonzero(means[known:k] @ block[j] >= least)
                for i in sorted({*own.tolist(), *moved}) + fresh.tolist():
                    mean = sums[i] / sizes[i]
                    scale = np.linalg.norm(mean) * np.linalg.norm(v)
                    if scale and float(mean @ v) / scale >= threshold:
                        break
                else:
                    i, k = k, k + 1
                sums[i] += v
                sizes[i] += 1
                means[i] = unit(sums[i] / sizes[i])
                if i < known and i not in moved:
                    moved.append(i)
                out[at] = i
                at += 1
    return out, sums[:k], sizes[:k]


def leader_clusters(rows: DataFrame, by: list[str], vector_col: str, order_col: str, threshold: float = 0.6, most: int = 5000) -> DataFrame:
    """Order-dependent clusters: each vector joins the first cluster whose mean is close enough, else starts one.

    The rule is sequential within a group. A group is folded ``most`` rows at a
    time, all groups at once; the sums and sizes of its clusters pass from part
    to part through written tables, so the result does not depend on ``most``,
    and a task holds one part and the clusters of one group. Vectors that are
    like nothing before are compared with every cluster, so the work grows with
    rows times clusters; it is done in products of matrices.
    """
    part = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order_col)) - 1) / most)
    numbered = written(rows.select(*by, order_col, vector_col).withColumn("part", part), "numbered")
    parts = (numbered.agg(F.max("part")).first()[0] or 0) + 1
    kept = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in [*by, order_col])
    schema = f"{kept}, cluster int, total array<double>, n long"
    names = [*by, order_col, "cluster", "total", "n"]

    def run(state: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):  # the group ended in an earlier part
            return pd.DataFrame(columns=names)
        state, pdf = state.sort_values("cluster"), pdf.sort_values(order_col)
        vectors = np.array(pdf[vector_col].tolist(), float)
        totals = np.array(state["total"].tolist(), float).reshape(-1, vectors.shape[1])
        out, sums, counts = _follow(vectors, totals, state["n"].to_numpy(np.int64), threshold)
        assigned = pdf.assign(cluster=out, total=None, n=None)[names]
        keys = pdf[by].iloc[0].to_dict()
        after = pd.DataFrame({**{k: [v] * len(sums) for k, v in keys.items()}, order_col: None, "cluster": range(len(sums)), "total": list(sums), "n": counts})[names]
        return pd.concat([assigned.astype(object), after.astype(object)])

    state, found = numbered.sparkSession.createDataFrame([], schema), []
    for k in range(parts):
        step = state.groupBy(*by).cogroup(numbered.where(F.col("part") == k).groupBy(*by)).applyInPandas(run, schema)
        step = written(step, "clusters") if parts > 1 else step
        state = step.where("n IS NOT NULL")
        found.append(step.where("n IS NULL").select(*by, order_col, "cluster"))
    return reduce(DataFrame.unionByName, found)
