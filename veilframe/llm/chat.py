"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

The template gives each role what stands before and after its turns and whether its text bears loss. Strings by which the
template marks turns are control strings. Inside texts they are broken up reversibly: a backslash becomes two, and a control
string gets a backslash and a dash behind its first character, so that the output can be read back without doubt.

The machine's state is the role of the turn before (none at the start); it allows system only first, user after none, system
or assistant, assistant after user. A turn that it doesn't allow is marked and formatted all the same, and the machine
goes on from its role; nothing is dropped.

Scale: turns are dealt by conversation and by chunks of TURNS turn numbers, so a conversation with a third of all rows
is formatted by many tasks. A task streams its turns in order and holds one chunk at a time, which is cut after TURNS turns. Chunks are
written once. The state at a chunk's start comes from the chunk before: a window over one small row per chunk. read_back() streams the
chunks of a conversation in order, because a digest over a whole conversation has to.

Cases: null text and null role are empty strings; roles that the template doesn't know are written by name between marks of
their own; null turns come first, turns with equal numbers are ordered by role, then text; a null conversation id is a conversation of its own; an empty
table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices, table

#: role: before, after, bears loss. Fixed values.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
    "user": ("<s>[INST] ", " [/INST] ", False),
    "assistant": ("<s>[BOT] ", " </s>", True),
}
#: Marks of a turn of another role: before its name, behind its name, after its text.
OTHER = ("[ROLE] ", " [AS] ", " [/ROLE]")
CONTROLS = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[BOT]", "[ROLE]", "[AS]", "[/ROLE]")
#: The machine: role before, roles that may follow.
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
TURNS = 64
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    if not ("\\" in text or "<" in text or "[" in text):  # no control string begins with anything else
        return text
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\-{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text) if "\\" in text else text


def allowed(before: str | None, role: str) -> bool:
    return role in NEXT.get(before, tuple(TEMPLATE))


def segments(role: str, text: str, template: dict = TEMPLATE) -> list[tuple[str, bool]]:
    """Text segments of a turn, each with its loss flag."""
    if role in template:
        before, after, loss = template[role]
        return [(before, False), (escape(text), loss), (after, False)]
    return [(OTHER[0] + escape(role) + OTHER[1], False), (escape(text), False), (OTHER[2], False)]


CHUNK = "conv_id long, chunk long, no long, first_role string, last_role string, n_turns long, wrong array<int>, segments array<struct<text:string,loss:boolean>>"


def chunks_of(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """Formatted chunks, each by itself: no tells apart those of one range of turn numbers; wrong, the turns behind the first that the
    machine doesn't allow."""
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.floor(F.col("turn").cast("bigint") / turns).cast("bigint").alias("chunk"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text").drop("turn")
    segment = pa.struct([("text", pa.string()), ("loss", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no, held = None, 0, []

        def made():
            roles = [r for r, _ in held]
            wrong = [i for i in range(1, len(roles)) if not allowed(roles[i - 1], roles[i])]
            texts, flags = zip(*[x for r, text in held for x in segments(r, text)])
            parts = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(flags, pa.bool_())], fields=list(segment)))
            row = [(key[0], pa.int64()), (key[1], pa.int64()), (no, pa.int64()), (roles[0], pa.string()), (roles[-1], pa.string()), (len(roles), pa.int64()), (wrong, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in row], parts], names=["conv_id", "chunk", "no", "first_role", "last_role", "n_turns", "wrong", "segments"])

        for whole in batches:
            for b in slices(whole, 3):
                for conv, chunk, role, text in zip(*[c.to_pylist() for c in b.columns]):
                    if held and ((conv, chunk) != key or len(held) == turns):
                        yield made()
                        no, held = (no + 1 if (conv, chunk) == key else 0), []
                    key = conv, chunk
                    held.append((role, text))
        if held:
            yield made()

    return dealt.mapInArrow(run, CHUNK)


def format_chats(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, chunk, no, n_turns, invalid (numbers of turns in the chunk that the machine doesn't allow), segments."""
    chunks = materialize(chunks_of(rows, turns))
    before = F.lag("last_role").over(W.partitionBy("conv_id").orderBy("chunk", "no"))
    small = chunks.select("conv_id", "chunk", "no", "first_role", "last_role").withColumn("before", before)
    ok = F.lit(False)
    for state, roles in NEXT.items():
        ok = ok | ((F.col("before").isNull() if state is None else F.col("before") == state) & F.col("first_role").isin(*roles))
    ok = ok | (F.col("before").isNotNull() & ~F.col("before").isin(*[x for x in NEXT if x]) & F.col("first_role").isin(*TEMPLATE))
    small = small.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), F.col("no").alias("_n"), ok.alias("_ok"))
    out = chunks.join(small, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("chunk").eqNullSafe(F.col("_k")) & (F.col("no") == F.col("_n")))
    return out.select("conv_id", "chunk", "no", "n_turns", F.when(F.col("_ok"), F.col("wrong")).otherwise(F.concat(F.array(F.lit(0)), "wrong")).alias("invalid"), "segments")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted text: the other way round of segments(). What ends a turn can't stand inside one."""
    out, at = [], 0

    def until(mark: str, begin: int) -> tuple[str, int]:
        end = formatted.find(mark, begin)
        if end < 0:
            raise ValueError(f"no end of the turn at {at}")
        return unescape(formatted[begin:end]), end + len(mark)

    while at < len(formatted):
        role = next((r for r, (before, _, _) in TEMPLATE.items() if formatted.startswith(before, at)), None)
        if role:
            text, at = until(TEMPLATE[role][1], at + len(TEMPLATE[role][0]))
        elif formatted.startswith(OTHER[0], at):
            role, at = until(OTHER[1], at + len(OTHER[0]))
            text, at = until(OTHER[2], at)
        else:
            raise ValueError(f"no turn at {at}")
        out.append((role, text))
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_invalid long"


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted text and its loss flags alone."""
    rows = chunks.select("conv_id", "chunk", "no", F.size("invalid").alias("n_invalid"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.filter("segments", lambda s: s["loss"])["text"].alias("borne"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "no").drop("chunk", "no")
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, done = None, None, []

        def said():
            turns, loss, n, chars, total, bad = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), total, bad

        for whole in batches:
            for b in slices(whole, 2):
                for conv, bad, formatted, borne in zip(*[c.to_pylist() for c in b.columns]):
                    if state is None or conv != key:
                        if state:
                            done.append(said())
                        key, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                    for role, text in parse(formatted):
                        state[0].update(f"{role}\n{text}\n".encode())
                        state[2] += 1
                    for text in map(unescape, borne):
                        state[1].update(text.encode())
                        state[3] += len(text)
                    state[4] += len(formatted)
                    state[5] += int(bad)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                    done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(said(), kinds)], names=names)

    return rows.mapInArrow(run, DIGEST)


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
