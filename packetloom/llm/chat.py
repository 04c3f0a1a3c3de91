"""Chat formatting: a template rendered turn by turn as a black box, with each turn's span and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.common import query, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

TURN, END, LINE = "<|turn|>", "<|end|>", "\n"
#: Control strings of this template and of common chat formats; none of them survives inside a text (fixed values).
CONTROL = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Two texts that differ in their only character; no template writes either by itself.
PROBES = ("", "")


def escape(text: str) -> str:
    """Double every backslash, and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template: ``<|turn|>role\\ntext<|end|>\\n`` per turn, role and text escaped (a line end in a role too)."""
    return "".join(f"{TURN}{escape(role).replace(LINE, chr(92) + 'n')}{LINE}{escape(text)}{END}{LINE}" for role, text in turns)


def without_earlier_thoughts(turns: list[Turn]) -> str:
    """A template that rewrites history: it drops ``<think>`` blocks of all assistant turns but the last one."""
    last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    strip = lambda t: re.sub(r"<think>.*?</think>", "", t, flags=re.DOTALL)
    return marked_turns([(r, strip(t) if r == "assistant" and i != last else t) for i, (r, t) in enumerate(turns)])


def parse(output: str) -> list[Turn]:
    """The turns in an output of ``marked_turns``."""
    out = []
    for piece in output.split(TURN)[1:]:
        role, _, rest = piece.partition(LINE)
        out.append((re.sub(r"\\(.)", lambda m: LINE if m[1] == "n" else m[1], role), unescape(rest[:rest.rindex(END)])))
    return out


def render(turns: list[Turn], template: Template = marked_turns) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """Render successive prefixes of ``turns`` and compare consecutive outputs.

    Returns the whole output, per turn ``(begin, end, text_begin, text_end)`` in it, and the first turn (from 0) whose
    rendering changes earlier output, or -1. From that turn on spans are not known and are left out.

    A turn's span is what its prefix adds. Its text is found by rendering the prefix twice more with one-character probes
    as the last text: their outputs differ in exactly that character.
    """
    before, spans = template([]), []
    for i in range(len(turns)):
        now = template(turns[:i + 1])
        if not now.startswith(before):
            return template(turns), spans, i
        probe = [template([*turns[:i], (turns[i][0], p)]) for p in PROBES]
        added = [p[len(before):] for p in probe]
        head = next((k for k, (a, b) in enumerate(zip(*added, strict=True)) if a != b), None) if len(added[0]) == len(added[1]) else None
        begin = len(before)
        if head is None:  # the template leaves this text out
            spans.append((begin, len(now), len(now), len(now)))
        else:
            tail = len(added[0]) - head - 1
            spans.append((begin, len(now), begin + head, len(now) - tail))
        before = now
    return before, spans, -1


def format_conversations(turns: DataFrame, template: Template = marked_turns, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans, loss_spans, rewrites_at``.

    ``spans`` holds each turn's role and offsets (code points) in ``formatted``; ``loss_spans`` the texts of turns whose role
    is in ``loss_roles``. ``rewrites_at`` is the first turn at which the template rewrites earlier output, null if it never
    does; such a conversation has no spans or loss from that turn on.

    Rows are dealt by conversation and sorted; a task walks them in order and holds one conversation at a time. Turns are
    ordered by number (null first), ties by role and text. Null texts and roles are empty; null ids are one conversation.
    """
    schema = ("conv_id long, formatted string, spans array<struct<role:string,begin:int,end:int,text_begin:int,text_end:int>>, "
              "loss_spans array<struct<begin:int,end:int>>, rewrites_at int")
    span = pa.struct([("role", pa.string()), *[(c, pa.int32()) for c in ("begin", "end", "text_begin", "text_end")]])
    loss = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    arrow = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span)), ("loss_spans", pa.list_(loss)), ("rewrites_at", pa.int32())])

    def finish(conv: int | None, said: list[Turn]) -> dict:
        out, spans, rewrites = render(said, template)
        marks = [{"role": said[i][0], "begin": a, "end": b, "text_begin": c, "text_end": d} for i, (a, b, c, d) in enumerate(spans)]
        return {"conv_id": conv, "formatted": out, "spans": marks, "rewrites_at": None if rewrites < 0 else rewrites,
                "loss_spans": [{"begin": m["text_begin"], "end": m["text_end"]} for m in marks if m["role"] in loss_roles]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, said, began, out, held = None, [], False, [], 0
        for batch in batches:
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if began and i != conv:
                    out.append(finish(conv, said))
                    held += len(out[-1]["formatted"])
                    said = []
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, held = [], 0
                conv, began = i, True
                said.append((role or "", text or ""))
        if began:
            out.append(finish(conv, said))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                        F.col(text_col).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the outputs of the default template say when read back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = parse(text)
                kept = "".join(unescape(text[s["begin"]:s["end"]]) for s in spans)
                digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(kept), digest(kept), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)


def _sql_length(text: str) -> str:
    """SQL for the code points that escaping adds to ``text``."""
    added = f"(length({text}) - length(replace({text}, chr(92), '')))"
    for c in CONTROL:
        added += f" + (length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}"
    return added


@query("op9_chat_formatting", f"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, v.turn, v.role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(turn, role))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum({len(TURN + LINE + END + LINE)} + length(role) + {_sql_length('role')} + (length(role) - length(replace(role, chr(10), ''))) + length(text) + {_sql_length('text')})::bigint as formatted_chars
from said group by conv_id""")
def op9_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(given.unionByName(added)))
