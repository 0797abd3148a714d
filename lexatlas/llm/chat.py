"""Chat formatting from event logs.

A conversation is an event log: (conv_id, seq, msg_id, event, role, text). Events are partitioned by conversation and
message, sorted by sequence, and folded into final messages: `message` opens one with its role and text, `delta` appends
to it, `edit` replaces its text, `regenerate` empties it so that the deltas that follow build it anew, `delete` removes
it. Then each message is rendered, in the order in which messages were opened.

The rendered form of a turn is  <|turn|>role\\ntext<|end|>\\n . A control string inside a role or text is escaped by one
more word joiner (U+2060) after its first character, which is taken away again when the output is read; so no control
string occurs in the output but those of the template. The loss mask covers each assistant text.

Output has a row per rendered turn, not per conversation: a conversation of any length is the concatenation of its rows,
and no task ever holds one whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.sources.workspace import map_arrow

TURN, CLOSE = "<|turn|>", "<|end|>"
#: Control strings of this template and of others in use; each begins with < or [.
CONTROL = (TURN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_REST = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in "<["}
_JOINER = "⁠"
_ESCAPE = "|".join(rf"\{first}(?={_JOINER}*(?:{rest}))" for first, rest in _REST.items())
_UNESCAPE = "|".join(rf"(?<=\{first}){_JOINER}(?={_JOINER}*(?:{rest}))" for first, rest in _REST.items())
#: Order of events with equal sequence.
EVENTS = ("message", "regenerate", "edit", "delta", "delete")
RENDERED = "conv_id long, position long, role string, rendered string, loss_start long, loss_chars long"


def escape(text: Column) -> Column:
    """Adds a joiner after the first character of each control string, with any number of joiners there already."""
    return F.regexp_replace(text, _ESCAPE, "$0" + _JOINER)


_unescape = re.compile(_UNESCAPE)


def unescape(text: str) -> str:
    return _unescape.sub("", text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the opening event), part (its number among those of its msg_id), role, text.

    Rows with equal conv_id and msg_id are one log, whatever their number of `message` events: each opens one more
    message, and other events act on the last opened; before any they open one with a null role. Order is by seq (null
    first), then kind of event, role and text, so ties and repeated rows have a defined result: a repeated `message`
    is two messages. A null msg_id is a value like others, as is a null conv_id. Null text: empty.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event")), F.lit(0))
    log = events.groupBy("conv_id", "msg_id").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("log"))
    opens = lambda x: x["kind"] == 1
    # each event with the number of the message it acts on and, within it, of the last event that sets the text anew
    number = F.transform("log", lambda x, i: F.struct(x["seq"].alias("seq"), x["kind"].alias("kind"), x["role"].alias("role"), x["text"].alias("text"), i.alias("i")))
    plain = F.when(F.size("log") == 1, F.transform("log", lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"), F.when(x["kind"] == 2, F.lit("")).otherwise(x["text"]).alias("text"), (x["kind"] == 5).alias("gone"))))
    state = "array<struct<seq:bigint,role:string,text:array<string>,gone:boolean>>"

    def step(messages: Column, x: Column) -> Column:
        fresh = F.struct(x["seq"].alias("seq"), x["role"].alias("role"), F.when(x["kind"] == 2, F.array().cast("array<string>")).otherwise(F.array(x["text"])).alias("text"), (x["kind"] == 5).alias("gone"))
        last = F.element_at(messages, -1)
        text = F.when(x["kind"] == 2, F.array().cast("array<string>")).when(x["kind"] == 3, F.array(x["text"])).when(x["kind"] == 5, last["text"]).otherwise(F.concat(last["text"], F.array(x["text"])))
        changed = F.struct(last["seq"].alias("seq"), F.coalesce(last["role"], x["role"]).alias("role"), text.alias("text"), (last["gone"] | (x["kind"] == 5)).alias("gone"))
        return F.when(opens(x) | (F.size(messages) == 0), F.concat(messages, F.array(fresh))).otherwise(F.concat(F.slice(messages, F.lit(1), F.size(messages) - 1), F.array(changed)))

    many = F.aggregate(number, F.array().cast(state), step, lambda ms: F.transform(ms, lambda m: F.struct(m["seq"].alias("seq"), m["role"].alias("role"), F.array_join(m["text"], "").alias("text"), m["gone"].alias("gone"))))
    messages = log.select("conv_id", "msg_id", F.posexplode(F.coalesce(plain, many)).alias("part", "m"))
    return messages.where(~F.col("m.gone")).select("conv_id", "msg_id", "part", F.col("m.seq").alias("seq"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """A row per turn: conv_id, seq, msg_id, part (their order), role, rendered, and where the loss mask begins in
    rendered and its length, in code points (null and 0 for turns without)."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.col("text"))
    head = F.concat(F.lit(TURN), F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"), F.lit("\n"))
    masked = F.col("role") == "assistant"
    shown = messages.withColumns({"_head": head, "_text": text})
    return shown.select("conv_id", "seq", "msg_id", "part", "role", F.concat("_head", "_text", F.lit(CLOSE + "\n")).alias("rendered"), F.when(masked, F.length("_head").cast("long")).alias("loss_start"), F.when(masked, F.length("_text").cast("long")).otherwise(F.lit(0).cast("long")).alias("loss_chars"))


def format_conversations(events: DataFrame) -> DataFrame:
    """fold, then render; an empty log gives no rows."""
    return render(fold(events))


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head, _, rest = rendered[len(TURN) :].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return unescape(role), unescape(rest[: -len(CLOSE) - 1])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Sums:
    """What is kept of a conversation while its turns pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, rendered: str, start: int | None, length: int) -> None:
        role, text = parse(rendered)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n, self.chars = self.n + 1, self.chars + len(rendered)
        if start is not None:
            masked = unescape(rendered[start : start + length])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    own, out = None, []
    for batch in batches:
        for conv_id, rendered, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_chars"))):
            if own is None or own.conv_id != conv_id:
                if own is not None:
                    out.append(own.row())
                own = _Sums(conv_id)
            own.add(rendered, start, length)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if own is not None:
        out.append(own.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation, from rendered turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest reads its conversation in order. Turns are sorted by Spark (on disk where need be) and pass one by one: a
    task keeps the state of one conversation's hashes, never its text.
    """
    rows = rendered.select("conv_id", "seq", "msg_id", "part", "rendered", "loss_start", "loss_chars")
    return map_arrow(rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "msg_id", "part", "rendered").select("conv_id", "rendered", "loss_start", "loss_chars"), _digest, DIGEST)
