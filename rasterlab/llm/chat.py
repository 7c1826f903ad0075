"""Chat formatting by columnar byte assembly, and its reader."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm import kernels as K

# The template's marks, and strings that act as control marks in other common templates.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]"
#: One more backslash after the first character of a control string, however many stand there; and one less.
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"
_READ = re.compile(_UNESCAPE)


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(text, ""), pattern=_ESCAPE, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return _READ.sub(r"\1\2\3", text)


def escape_role(role: pa.Array) -> pa.Array:
    """Roles stand in a line of their own: backslashes and newlines are escaped too."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n")):
        role = pc.replace_substring(pc.fill_null(role, ""), a, b)
    return escape(role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(columns: list[pa.Array | bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all columns, row by row, in one buffer, and the start of every piece as (row, column) offsets.

    ``columns`` holds string columns and constants. Piece lengths give cumulative offsets; each column's bytes are
    copied to their places by scatter indices.
    """
    buffers = [(np.frombuffer(c, np.uint8), None) if isinstance(c, bytes) else K.text_buffer(c) for c in columns]
    lengths = np.stack([np.full(rows, len(b), np.int64) if o is None else np.diff(o) for b, o in buffers], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(offsets[-1], np.uint8)
    starts = offsets[:-1].reshape(rows, len(columns))
    for j, (data, offs) in enumerate(buffers):
        if offs is None:
            for i, byte in enumerate(data):
                out[starts[:, j] + i] = byte
        elif len(data):
            out[np.arange(len(data)) + np.repeat(starts[:, j] - offs[:-1], lengths[:, j])] = data
    return out, np.append(starts.ravel(), offsets[-1]).reshape(-1)


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant", piece_chars: int = 1 << 26) -> DataFrame:
    """``(conv_id, piece, formatted, n_turns, loss)``: each conversation's turns in order, as text for training.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text or role get a backslash after
    their first character, which ``read_chat`` takes away again. ``loss`` lists ``start`` and ``end`` (code points of
    ``formatted``) of the texts of ``learn`` turns, which alone carry the loss.

    Turns are partitioned by conversation and sorted, and stream through the task: only the piece being written is
    held. A conversation is one piece; beyond ``piece_chars`` bytes it continues in a further piece at a turn's end,
    so no conversation outgrows a row. Turns with equal numbers come in order of role and text, null numbers first.
    Null text and roles count as empty. A null conversation id is a conversation of its own. Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        held: dict | None = None  # the conversation that the next batch may continue

        def row(x: dict) -> pa.RecordBatch:
            loss = pa.array([[{"start": a, "end": b} for a, b in x["loss"]]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([x["id"]], pa.int64()), pa.array([x["piece"]], pa.int64()), pa.array([b"".join(x["bytes"]).decode()]), pa.array([x["turns"]], pa.int64()), loss], names=["conv_id", "piece", "formatted", "n_turns", "loss"])

        for batch in K.parts(batches, "text"):
            n = batch.num_rows
            role, text = escape_role(batch["role"]), escape(batch["text"])
            data, at = assemble([START.encode(), role, MIDDLE.encode(), text, END.encode()], n)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            at = np.append(at[:-1].reshape(n, 5), np.full((1, 5), len(data)), axis=0)
            learnt = pc.fill_null(pc.equal(batch["role"], learn), False).to_numpy(zero_copy_only=False)
            ids = batch["conv_id"].to_pylist()
            size = at[:, 0] // max(1, piece_chars)  # long runs are cut where they could fill a piece
            cuts = [0, *(i for i in range(1, n) if ids[i] != ids[i - 1] or size[i] != size[i - 1]), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held["id"] != ids[a]:
                    yield row(held)
                    held = None
                held = held or {"id": ids[a], "piece": 0, "bytes": [], "size": 0, "chars": 0, "turns": 0, "loss": []}
                if held["size"] >= piece_chars:
                    yield row(held)
                    held = {"id": ids[a], "piece": held["piece"] + 1, "bytes": [], "size": 0, "chars": 0, "turns": 0, "loss": []}
                lo, hi = int(at[a, 0]), int(at[b, 0])
                shift = held["chars"] - int(points[lo])
                held["loss"] += [(int(points[at[i, 3]]) + shift, int(points[at[i, 4]]) + shift) for i in range(a, b) if learnt[i]]
                held["bytes"].append(data[lo:hi].tobytes())
                held["size"] += hi - lo
                held["chars"] += int(points[hi] - points[lo])
                held["turns"] += b - a
        if held:
            yield row(held)

    return rows.mapInArrow(run, "conv_id long, piece long, formatted string, n_turns long, loss array<struct<start:long,end:long>>")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of a formatted piece; no unescaped mark is left inside either."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition(MIDDLE)
        out.append((unescape_role(role), unescape(text[: -len(END)])))
    return out


def read_chat(formatted: DataFrame) -> DataFrame:
    """What ``format_chat`` wrote, read back from its text and loss spans alone, one digest row per conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``; pieces are read in their order.
    """
    rows = formatted.select("conv_id", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None

        def done(x) -> list:
            return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]

        for batch in K.parts(batches, "formatted"):
            out = []
            for conv, text, loss in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss"].to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        out.append(done(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for x in loss:
                    said = unescape(text[x["start"] : x["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(now), _TYPES, strict=True)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
