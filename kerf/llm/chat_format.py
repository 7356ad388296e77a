"""Chat formatting with a grammar round trip.

Each turn is rendered as opener, text and closer of its role; a conversation is its turns one after another:

    conversation = turn*
    turn         = "[INST] " text " [/INST]"           role user
                 | "<<SYS>>" text "<</SYS>>"           role system
                 | "<s>" text "</s>"                   role assistant
                 | "<|turn:" role "|>" text "<|/turn|>"  any other role (its name escaped like a text)

A deterministic parser reads the text up to the first closer. MARK (U+001A) escapes: doubled it is itself, and alone it
is nothing, so that a control string with MARK after its first character is no longer one. A turn is rendered plain,
parsed again and compared with its source; while they differ, its conflicting control strings are escaped, first the
closer of its own role, then all of them. As the grammar is a repetition of turns that each end at their closer, the
parse of a conversation is the parses of its turns in order, and rendering needs no shuffle at any conversation size.

Cases: null texts and roles count as empty. Null turns come first, null conversation ids form one conversation, and
equal turns are ordered by role and text. Repeated rows are turns of their own. Empty tables give no segments. Other
columns of the input are not read and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\x1a"
FORMS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER_OPEN, OTHER_NAME_END, OTHER_CLOSE = "<|turn:", "|>", "<|/turn|>"
CONTROLS = [x for pair in FORMS.values() for x in pair] + [OTHER_OPEN, OTHER_NAME_END, OTHER_CLOSE, "[INST]", "[/INST]"]
LOSS_ROLE = "assistant"


def escape(text: str, controls: list[str]) -> str:
    text = text.replace(MARK, MARK + MARK)
    for c in sorted(controls, key=len, reverse=True):
        text = text.replace(c, c[0] + MARK + c[1:])
    return text


def unescape(text: str) -> str:
    return MARK.join(part.replace(MARK, "") for part in text.split(MARK + MARK))


def parse(segment: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the (escaped) text starts and ends, of each turn. Raises ValueError off the grammar."""
    at = 0
    while at < len(segment):
        for role, (opener, closer) in FORMS.items():
            if segment.startswith(opener, at):
                start = at + len(opener)
                break
        else:
            if not segment.startswith(OTHER_OPEN, at):
                raise ValueError("no turn starts here")
            name_end = segment.find(OTHER_NAME_END, at + len(OTHER_OPEN))
            if name_end < 0:
                raise ValueError("a role has no end")
            role, start, closer = unescape(segment[at + len(OTHER_OPEN) : name_end]), name_end + len(OTHER_NAME_END), OTHER_CLOSE
        end = segment.find(closer, start)
        if end < 0:
            raise ValueError("a turn has no end")
        yield role, unescape(segment[start:end]), start, end
        at = end + len(closer)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn and where its text lies in it, escaped no more than its round trip needs."""
    own = FORMS.get(role)
    for controls in ([], [own[1] if own else OTHER_CLOSE], CONTROLS):
        body = escape(text, controls)
        segment = f"{own[0]}{body}{own[1]}" if own else f"{OTHER_OPEN}{escape(role, CONTROLS)}{OTHER_NAME_END}{body}{OTHER_CLOSE}"
        try:
            got = list(parse(segment))
        except ValueError:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return segment, got[0][2], got[0][3]
    raise ValueError(f"no round trip for a turn of role {role!r}")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment (the formatted turn), and loss_start and loss_end, the code points of the
    segment under the loss mask (null where the role has no loss). Joined in order, segments are the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            loss = [r == LOSS_ROLE for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] if x else None for d, x in zip(done, loss)], pa.int64()), pa.array([d[2] if x else None for d, x in zip(done, loss)], pa.int64())],
                names=["conv_id", "turn", "role", "text", "segment", "loss_start", "loss_end"],
            )

    own = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = {x.name: x.dataType.simpleString() for x in own.schema}
    return own.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, segment string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its segments alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Segments stream through running digests, so a conversation of any length needs one turn's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        out: list[tuple] = []

        def done() -> None:
            if state is not None:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv_type = pa.int64()
        for batch in batches:
            conv_type = batch.column(0).type
            starts, ends = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for conv, segment, a, b in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), starts, ends):
                if state is None or conv != key:
                    done()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    loss = unescape(segment[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(segment)
            if out:
                yield flush()
                out.clear()
        done()
        if out:
            yield flush()

    order = ["conv_id", "turn", "role", "text"]
    own = formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", "text")
    dealt = own.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    kind = own.schema["conv_id"].dataType.simpleString()
    return dealt.drop("text").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
