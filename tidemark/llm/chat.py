"""Chat formatting by incremental rendering of a black-box template.

The template is only called, never inspected. Rendering each prefix of a
conversation and comparing it with the one before gives the turn's span; a
turn whose output does not continue the last one shows that the template
rewrites history. Rendering the turn once more with a probe for its text
gives the place of the text within the span. After a rewrite, earlier turns are
located anew, by a probe in the whole conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.grouped import by_group

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]
PROBES = range(0xE000, 0xF900)  # private-use characters, for which templates have no rule

_CONTROL = re.compile(r"<(\\*)\|")
SPAN = "struct<begin:bigint,text_begin:bigint,text_end:bigint,end:bigint,learn:boolean>"


def escape(text: str) -> str:
    """Puts a backslash into every ``<|``, and one more where there are some, so no control string is left."""
    return _CONTROL.sub(r"<\1\\|", text)


def render_chatml(turns: Turns) -> str:
    """Marks each turn; backslashes and line ends inside roles are escaped as well."""
    role = lambda r: escape(r.replace("\\", "\\\\").replace("\n", "\\n"))
    return "".join(f"<|im_start|>{role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def unescaped(text: Column) -> Column:
    """The text before ``escape``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def common_prefix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def locate_turns(turns: Turns, render: Render, learn: frozenset[str]) -> tuple[str, list[dict], bool]:
    """The rendered conversation, each turn's span, and whether some turn changed what stood before it.

    A turn that rewrites history gets the part from the first change on. The turns
    before it are then found again in the last output: a span is the text alone,
    or empty where the template no longer shows the text as one piece. The probe is a
    private-use character that the conversation lacks; one with all 6,400 of them fails.
    """
    used = set().union(*(r + t for r, t in turns))
    probe = next(chr(c) for c in PROBES if chr(c) not in used)
    before, spans, rewrites = render([]), [], False
    for k, (role, text) in enumerate(turns):
        head = turns[:k]
        after = render([*head, (role, text)])
        begin = len(before) if after.startswith(before) else common_prefix(before, after)
        rewrites |= not after.startswith(before)
        at, to = _place(render([*head, (role, probe)]), probe, after, begin)
        spans.append({"begin": begin, "text_begin": at, "text_end": to, "end": len(after), "learn": role in learn})
        before = after
    if rewrites:
        for k, (role, _) in enumerate(turns[:-1]):
            at, to = _place(render([*turns[:k], (role, probe), *turns[k + 1 :]]), probe, before, 0)
            spans[k] |= {"begin": at, "text_begin": at, "text_end": to, "end": to}
    return before, spans, rewrites


def _place(probed: str, probe: str, shown: str, begin: int) -> tuple[int, int]:
    """Where the text that the probe stands for is in the output; an empty span at its end if it isn't there as one piece."""
    at = probed.rfind(probe)
    tail = len(probed) - at - 1
    whole = at >= begin and at + tail <= len(shown) and probed[:at] == shown[:at] and probed[at + 1 :] == shown[len(shown) - tail :]
    return (at, len(shown) - tail) if whole else (len(shown), len(shown))


def format_chats(rows: DataFrame, render: Render = render_chatml, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, n_turns, formatted, spans and rewrites.

    ``spans`` has, for each turn in order, where it and its text begin and end
    in ``formatted`` (code points), and whether the text is to be learned.
    Turns are ordered by ``turn_col``, then role and text; null texts and roles
    are empty; null turns come first; a null conversation id is one
    conversation; repeated rows are turns of their own. A conversation is
    rendered in one task, as its output is one string; the time is quadratic
    in its turns, as a black box leaves no other way to see a rewritten history.
    Other columns are ignored; an empty table gives an empty result.
    """
    conv_type = rows.schema[conv_col].dataType.simpleString()
    learned = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids = None, []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids[:] = [batch.schema.field("conv").type]
                yield batch

        for g in by_group(typed(), "conv"):
            text, spans, rewrites = locate_turns(list(zip(g["role"], g["text"])), render, learned)
            kind = kind or pa.list_(pa.struct([(k, pa.bool_() if k == "learn" else pa.int64()) for k in spans[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(g["conv"][:1], ids[0]), pa.array([len(spans)], pa.int64()), pa.array([text]), pa.array([spans], kind), pa.array([rewrites])], names=["conv", "n_turns", "formatted", "spans", "rewrites"])

    order = ["conv", "turn", "role", "text"]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))]
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), *texts)
    turns = turns.repartition("conv").sortWithinPartitions(*order)
    out = turns.mapInArrow(run, f"conv {conv_type}, n_turns bigint, formatted string, spans array<{SPAN}>, rewrites boolean")
    return out.withColumnRenamed("conv", conv_col)


def read_back(formatted: Column, spans: Column) -> tuple[Column, Column]:
    """From the output of ``format_chats`` with the chatml template: role and text of each turn, unescaped, as arrays."""

    def piece(begin: Column, end: Column) -> Column:
        return F.substring(formatted, (begin + 1).cast("int"), (end - begin).cast("int"))

    def role(s: Column) -> Column:
        header = F.regexp_extract(piece(s["begin"], s["text_begin"]), r"^<\|im_start\|>([^\n]*)\n$", 1)
        parts = F.split(unescaped(header), r"\\\\", -1)  # at doubled backslashes; what is left of them are line ends
        return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")

    return F.transform(spans, role), F.transform(spans, lambda s: unescaped(piece(s["text_begin"], s["text_end"])))
