"""One query per operator over the test tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import align_tokens
from tidemark.llm.chat import format_chats, read_back
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.exact import exact_duplicates
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.langid import held_out, identify_languages, train_language_model
from tidemark.llm.lines import line_classes
from tidemark.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pieces import decode_pieces, encode_pieces
from tidemark.llm.quality import score_quality, train_quality
from tidemark.llm.sharding import shard
from tidemark.llm.toxicity import score_toxicity, train_toxicity, with_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return identify_languages(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("<|im_end|><|im_start|>assistant ok"))
    chats = format_chats(rows.union(extra), learn=("assistant",))
    roles, texts = read_back(F.col("formatted"), F.col("spans"))
    chats = chats.withColumn("roles", roles).withColumn("texts", texts)
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join(F.zip_with("texts", "spans", lambda t, s: F.when(s["learn"], t).otherwise("")), "")
    return chats.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), share=1.5, weights=(5, 2, 1), cap=2.0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only contaminated documents have rows: one for each benchmark item found in them."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = F.col("doc_id")
    model = train_toxicity(with_labels(docs, labels.where(~held_out(out, 4, 2))))
    return score_toxicity(docs, model).select("doc_id", held_out(out, 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; all executors need it too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(columns)
    tampered = leaf_digest([*map(F.col, columns[:-1]), F.translate("text", UPPER, LOWER)])
    docs = docs.withColumn("tampered", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, tampered))
    rows = merkle_manifest(docs, columns, keep=("tampered",))
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _vocabulary("piece_bpe_32k.model")
    rows = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text"), model)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"), keep_groups=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_line_dedup": op5_line_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_token_alignment": op13_token_alignment,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"'[^\x20\x09-\x0D]+'"



def _merkle_sql(levels: int = 6, upper: int = 3) -> str:
    """Trees of up to 16 ** levels rows in a source and 16 ** upper sources; a single node stays as it is."""
    field = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    lowered = field(f"translate(text, '{UPPER}', '{LOWER}')")
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::BIGINT)"""
    parts = [f"""d AS (SELECT doc_id, source, sha256({leaf} || {field("text")}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({leaf} || {lowered}) ELSE sha256({leaf} || {field("text")}) END AS f FROM documents),
a0 AS (SELECT doc_id, source, leaf AS node, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
x0 AS (SELECT d.doc_id, d.source, leaf, f, '' AS proof, pos FROM d JOIN a0 USING (doc_id))"""]

    def climb(k: int, source: str, same: str) -> str:
        return f"""r{k} AS (SELECT {source}pos // 16 AS run, n, list(node ORDER BY pos) AS nodes FROM a{k} GROUP BY ALL),
a{k + 1} AS (SELECT {source}run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM r{k}),
y{k} AS (SELECT x.*, n, array_to_string(nodes[1:pos % 16], '') AS l, array_to_string(nodes[pos % 16 + 2:], '') AS r FROM x{k} x JOIN r{k} r ON r.run = x.pos // 16{same}),
x{k + 1} AS (SELECT * EXCLUDE (n, l, r) REPLACE (pos // 16 AS pos, proof || l || r AS proof, CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f) FROM y{k})"""

    parts += [climb(k, "source, ", " AND r.source IS NOT DISTINCT FROM x.source") for k in range(levels)]
    top = levels + 1
    parts.append(f"""s AS (SELECT source, node AS subroot FROM a{levels}),
a{top} AS (SELECT source, subroot AS node, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS pos, count(*) OVER () AS n FROM s),
x{top} AS (SELECT x.* REPLACE (a.pos AS pos) FROM x{levels} x JOIN a{top} a ON a.source IS NOT DISTINCT FROM x.source)""")
    parts += [climb(k, "", "") for k in range(top, top + upper)]
    return f"""WITH {", ".join(parts)}
SELECT x.doc_id, leaf, subroot, a.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = a.node AS verified
FROM x{top + upper} x JOIN s ON s.source IS NOT DISTINCT FROM x.source, a{top + upper} a"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 90 * (x.n + y.n - o.o)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY ALL""",
    "op4_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op6_source_mixing": f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM g),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, source_size * 2::DOUBLE AS most FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT arg_min(level, (most / weight, place)) AS level FROM l WHERE level <= most / weight),
t AS (SELECT l.source, l.place, l.source_size, least(l.most, l.weight * a.level) AS target FROM l, a),
b AS (SELECT *, sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upper FROM t),
k AS (SELECT max(upper) AS total, floor(max(upper) / 256)::BIGINT + 1 AS slots, count(*) AS sources FROM b),
i AS (SELECT i AS slot, (i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE)) * total AS x FROM k, range(slots) q(i)),
o AS (SELECT i.slot, b.place, row_number() OVER (PARTITION BY b.place ORDER BY i.slot) - 1 AS rank FROM i JOIN b ON i.x >= b.upper - b.target AND i.x < b.upper),
p AS (SELECT s.doc_id, s.size, t.place, t.source_size, t.target, round(t.target)::BIGINT AS want,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (SELECT sum(greatest(0, least(size, least(source_size, want - n * source_size) - first))) FROM range(3) q(n))::BIGINT AS taken,
  CASE WHEN size > 0 AND first < least(source_size, want) THEN coalesce(o.slot, k.slots + p.first // 256 * k.sources + p.place) END AS first_slot
FROM p CROSS JOIN k LEFT JOIN o ON o.place = p.place AND o.rank = p.first // 256""",
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)""",
}
