"""SentencePiece encoding against the library, and alignment against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import alignment, pieces

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
KIND = "doc_id long, text string, ids string, size int"
ODD = [None, "", " ", "   ", "▁", "a", "  a  b ", "\n\n", "漢字𠀀", "a\0b", "<s>x</s><0x41>", "<|endoftext|> x", "é́ü", "tab\t x", "Ünï …  cödé", "x" * 3000, "  a　 b", "don't  'tis", "aaaa" * 60 + " " * 37]
PARTS = ["a", "the", " ", "  ", "▁", "é", "漢", "\n", "ing", "0x", "'", "'s", "́", "-", "<s>", "�", " ", "\t", "…", "q", "zx"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], KIND)


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_as_the_library(text):
    model = pieces.load_pieces(MODEL)
    ids = LIBRARY.encode(text)
    assert model.encode(text) == ids and model.decode(ids) == LIBRARY.decode(ids)


@given(st.lists(st.integers(1, 31999) | st.integers(3, 262), max_size=12))
@settings(max_examples=300, deadline=None)
def test_decoding_of_any_ids(ids):
    assert pieces.load_pieces(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_backtracking_is_merging():
    """The encoding of single words, without any cut at blanks, against merging them step by step."""
    model, rng = pieces.Pieces(MODEL), random.Random(3)
    for _ in range(2000):
        word = "".join(rng.choice("▁▁abdehinorst") for _ in range(rng.randint(1, 30)))
        parts = list(word)
        while True:
            ranks = [model.rank.get(a + b, pieces.NO_RANK) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == pieces.NO_RANK:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [model.pieces[i] for i in model._word(word)] == parts


def test_kept_words_begin_anew(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 5)
    model, rng = pieces.Pieces(MODEL), random.Random(4)
    for _ in range(50):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa"]) for _ in range(20))
        assert model.encode(text) == LIBRARY.encode(text)


def test_encode_and_decode_frames(spark):
    rows = pieces.decode_pieces(pieces.encode_pieces(frame(spark, ODD), MODEL), MODEL).collect()
    assert len(rows) == len(ODD) and all(r.size == 0 for r in rows)
    for r in rows:
        assert r.ids == LIBRARY.encode(r.text or "") and r.decoded == LIBRARY.decode(r.ids)
    assert pieces.encode_pieces(frame(spark, []), MODEL).count() == 0


def plain_alignment(texts):
    """By the contract, with the libraries on whole texts."""
    a_side = tokenizers.Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    bytes_a, bytes_b = alignment.byte_level(BYTES)[1], alignment.piece_level(MODEL)[1]
    out, pairs = [], []
    for t in texts:
        groups = []
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, LIBRARY.encode(t)
            raw = (" " + t).encode()
            if b"".join(bytes_a[i] for i in a) == raw == b"".join(bytes_b[i] for i in b):
                ends = [set(np.cumsum([len(side[i]) for i in ids]).tolist()) for side, ids in ((bytes_a, a), (bytes_b, b))]
                cuts, cells = ends[0] & ends[1], defaultdict(lambda: ([], []))
                for k, (side, ids) in enumerate(((bytes_a, a), (bytes_b, b))):
                    at = n = 0
                    for i in ids:
                        cells[n][k].append(i)
                        at += len(side[i])
                        n += at in cuts
                groups = [cells[n] for n in sorted(cells)]
        out.append(groups)
        pairs.append(Counter((x, y) for ga, gb in groups for x in ga for y in gb))
    count = Counter(k for p in pairs for k in p)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for groups, p in zip(out, pairs):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sums = sum(n * count[k] for k, n in p.items()), sum(n for k, n in p.items() if count[k] == most[k[0]])
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(p.values()), sums[1], sums[0], text))
    return rows


def some_texts():
    rng = random.Random(5)
    words = ["the", "their", "there", "straße", "naïve", "漢字", "0x1f", "foo_bar", "don't", "\n", "—", "𠀀", "re-use", "Aß", "ﬁn", "  ", "tab\tx"]
    return [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)), *["the same copy"] * 30]


@pytest.mark.parametrize("slice_bytes", [16 << 20, 400])
def test_alignment_against_a_plain_version(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    texts = some_texts()
    docs = frame(spark, texts).repartition(3, "doc_id")
    got = {r.doc_id: r for r in alignment.align_tokens(docs, BYTES, MODEL).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_alignment(texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want, texts[i]
        assert r.groups_sha256 == (hashlib.sha256(want[-1].encode()).hexdigest() if want[-1] else "")


def test_alignment_parts_in_this_process(monkeypatch):
    """Records, runs and merging with limits of a few rows, against counting."""
    for name, value in {"LINKS": 40, "CHUNK": 2, "WIDE": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    rng = np.random.default_rng(6)
    want, runs = Counter(), []
    for task in range(5):
        held, docs = alignment._Runs(task), 30
        group_doc = np.sort(rng.integers(0, docs, 80))
        ga, gb = (np.sort(np.r_[np.arange(80), rng.integers(0, 80, 200)]) for _ in range(2))
        a, b = rng.integers(0, 90, len(ga)), rng.integers(0, 7, len(gb))
        links = Counter((int(x), int(y), int(group_doc[g])) for g in range(80) for x in a[ga == g] for y in b[gb == g])
        seen = Counter()
        for records, times in alignment._records(group_doc, ga, gb, a, b, 0):
            held.add(records, times)
            for r, n in zip(records.tolist(), times.tolist()):
                side, other, doc = r >> 43, r >> 22 & (1 << 21) - 1, r & (1 << 22) - 1
                seen[(side & (1 << 15) - 1) * alignment.RADIX + (side >> 15), other, doc] += n
        assert seen == links
        want.update((x, y) for x, y, _ in links)  # once for each document
        held.close()
        runs += held.rows
    got = Counter()
    for radix in {r["radix"] for r in runs}:
        keys, counts = alignment.merged([alignment._gaps_summed(r["keys"], "<u4") for r in runs if r["radix"] == radix])
        assert all(keys[1:] > keys[:-1])
        for k, n in zip(keys.tolist(), counts.tolist()):
            side = k >> 21
            got[(side & (1 << 15) - 1) * alignment.RADIX + (side >> 15), k & (1 << 21) - 1] += n
    assert got == want


def test_alignment_of_odd_rows(spark):
    rows = [(None, "a b", "x", 1), (None, "a b", "x", 1), (3, None, None, None), (3, "", "", 2)]
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in alignment.align_tokens(spark.createDataFrame(rows, KIND), BYTES, MODEL, keep_groups=False).collect())
    assert got == [(0, 2, 4), (0, 2, 4), (3, 0, 0), (3, 0, 0)]
    assert alignment.align_tokens(spark.createDataFrame([], KIND), BYTES, MODEL).count() == 0


def test_texts_put_together_from_words(monkeypatch):
    """In this process, with few words kept and few pairs held at a time."""
    for name, value in {"LINKS": 30, "WORDS": 7, "KEPT": 25, "WIDE": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    texts, aligner, runs = some_texts(), alignment._Aligned(BYTES, MODEL), alignment._Runs(0)
    want, links = plain_alignment(texts), Counter()
    for at in range(0, len(texts), 9):
        counts, spelled = aligner.texts([t or "" for t in texts[at : at + 9]], runs)
        runs.docs += len(texts[at : at + 9])
        got = list(zip(*(counts[c].tolist() for c in aligner.COUNTS), spelled))
        assert got == [(*w[:4], w[-1]) for w in want[at : at + 9]]
    for records, times in zip(runs.records, runs.times):
        assert len(set(records.tolist())) == len(records)
        for r, n in zip(records.tolist(), times.tolist()):
            links[r & (1 << 22) - 1] += n
    assert all(links[i] == w[3] for i, w in enumerate(want))


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_words_are_cut_where_both_sides_cut(text):
    side = tokenizers.Tokenizer.from_file(BYTES)
    side.encode_special_tokens = True
    ask_a, ask_b = alignment._aligner(BYTES, MODEL).ask_a, alignment._aligner(BYTES, MODEL).ask_b
    if text and "▁" not in text:
        words = alignment.blank_words(" " + text)
        assert "".join(words) == " " + text
        assert sum(ask_a(words), []) == side.encode(" " + text, add_special_tokens=False).ids
        assert sum(ask_b(words), []) == LIBRARY.encode(text)
