"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only
its reply is trainable.  A turn is written as ``<|turn|>role\\n`` + text + ``<|end|>``; inside
roles and texts a backslash is doubled and a backslash parts ``<`` from ``|``, so ``<|`` occurs in
markers alone; in roles a newline becomes backslash-n.  The original comes back exactly.

A conversation is streamed: rows arrive sorted by conversation and turn, and a task holds the
prefix of one conversation.  The shuffle deals whole conversations; their length is what a
chat has, and each example holds its whole context, which is the format's own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
TRAINED_ROLE = "assistant"
#: Characters of examples that a task holds before it hands them on.
BATCH_CHARS = 1 << 20
EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, remainder boolean"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        nxt = text[i + 1 : i + 2]
        out += (text[at:i], "\n" if nxt == "n" else nxt)
        at = i + 2
    return "".join(out) + text[at:]


def write_turn(role: str, text: str) -> tuple[str, str]:
    """A turn's opening, and its text with the end marker."""
    return TURN + escape(role).replace("\n", "\\n") + "\n", escape(text) + END


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of formatted text; the inverse of :func:`write_turn`."""
    out = []
    for part in text.split(END)[:-1] if text else []:
        role, _, body = part.removeprefix(TURN).partition("\n")
        out.append((unescape(role), unescape(body)))
    return out


def expand(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn; conversations that end otherwise get one more, untrained.

    Columns: conv_id; example (0, 1, ...); n_turns, those in the text; text; loss_start and
    loss_end, the code points of the text that are trained; remainder, true for the extra row
    (loss span empty) that holds a conversation without a final assistant turn, so that no
    turn is lost.  Rows of equal turn are ordered by role and text and all kept; null role or
    text is empty, null turns come first and the rows of null conv_id form one conversation; an
    empty table gives no rows.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"conv": None, "open": False}
        rows: list[tuple] = []
        held = 0  # characters of examples not yet handed on

        def finish():
            if state["open"] and state["pending"]:
                rows.append((state["conv"], state["example"], state["turns"], "".join(state["parts"]), 0, 0, True))

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not state["open"] or conv != state["conv"]:
                    finish()
                    state = {"conv": conv, "open": True, "example": 0, "turns": 0, "parts": [], "chars": 0, "pending": False}
                head, body = write_turn(role, text)
                state["parts"] += (head, body)
                state["chars"] += len(head) + len(body)
                state["turns"] += 1
                state["pending"] = role != TRAINED_ROLE
                if role == TRAINED_ROLE:
                    whole = "".join(state["parts"])
                    state["parts"] = [whole]
                    rows.append((conv, state["example"], state["turns"], whole, state["chars"] - len(body), state["chars"] - len(END), False))
                    state["example"] += 1
                    held += len(whole)
                if held >= BATCH_CHARS or len(rows) >= 512:
                    yield _batch(rows)
                    rows, held = [], 0
        finish()
        if rows:
            yield _batch(rows)

    return dealt.mapInArrow(run, EXAMPLES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "remainder"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when parsed: turns, trained text, sizes.

    Examples of a conversation lie together and in order, as :func:`expand` leaves them; each
    must begin with the one before it, else the task fails.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def close(s: dict) -> tuple:
            return s["conv"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["formatted"], s["examples"]

        out: list[tuple] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end", "remainder")]
            for conv, text, start, end, remainder in zip(*cols, strict=True):
                if now is None or conv != now["conv"]:
                    if now is not None:
                        out.append(close(now))
                    now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "formatted": 0, "examples": 0, "before": ""}
                if not text.startswith(now["before"]):
                    raise ValueError(f"conversation {conv}: an example does not continue the one before it")
                for role, said in read_turns(text[len(now["before"]) :]):
                    now["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    now["turns"] += 1
                trained = unescape(text[start:end])
                now["loss"].update(trained.encode("utf-8", "surrogatepass"))
                now["loss_chars"] += len(trained)
                now["formatted"] += len(text)
                now["examples"] += not remainder
                now["before"] = text
            if out:
                yield _rows(out, schema)
                out = []
        if now is not None:
            out.append(close(now))
        if out:
            yield _rows(out, schema)

    return examples.mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -7L as conv_id, 0L as turn, 'user' as role, :said as text union all select -7L, 1L, 'assistant', :said", args={"said": said})
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(expand(table.unionByName(extra)))
