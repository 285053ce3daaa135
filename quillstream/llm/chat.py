"""Chat formatting, token by token.

A turn becomes [start] role [separator] text [end]; the three marks are reserved ids beyond the
vocabulary, spliced between segments that are encoded separately, so that no text can produce a mark.
In the written form the same marks are control strings; inside texts each `<|` (with any backslashes
between) gets one more backslash, which unescaping takes away again. The loss mask is the prefix sum
of +1 where an assistant's text begins and -1 where it ends.

Defined results: turns go in the order of turn, role, text; repeated rows are turns of their own; null
roles and texts are empty; a null conv_id is one conversation; texts of any length are whole; an empty table
has no rows. Further columns, of whatever name, are ignored. Turns are dealt by range of conversation and turn,
so a very long conversation is encoded by many tasks, in chunks of bounded length; only the digests, which
are chains, read a conversation's chunks one after another.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CHUNK_TURNS = 256
CHUNK_CHARS = 1 << 20

_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


class Template:
    """A byte-level tokenizer with the three reserved ids after its own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.codec = Tokenizer.from_file(path)
        self.codec.encode_special_tokens = True
        n = self.codec.get_vocab_size(with_added_tokens=True)
        self.start, self.separator, self.end = n, n + 1, n + 2

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of some turns (role, text)."""
        flat = [escape(x) for turn in turns for x in turn]
        ids = [x.ids for x in self.codec.encode_batch(flat, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64).reshape(-1, 2)
        at = np.concatenate([[0], np.cumsum(sizes.sum(1) + 3)])
        out = np.empty(at[-1], np.uint32)
        begin = at[:-1]
        text_at = begin + 2 + sizes[:, 0]
        out[begin], out[text_at - 1], out[at[1:] - 1] = self.start, self.separator, self.end
        for i in range(len(turns)):
            out[begin[i] + 1 : text_at[i] - 1] = ids[2 * i]
            out[text_at[i] : at[i + 1] - 1] = ids[2 * i + 1]
        steps = np.zeros(at[-1] + 1, np.int64)
        own = np.array([role == "assistant" for role, _ in turns], bool)
        np.add.at(steps, text_at[own], 1)
        np.add.at(steps, at[1:][own] - 1, -1)
        return out, np.cumsum(steps[:-1]).astype(np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, int, str]]:
        """(role, text, written characters, text under the mask) of each turn of assembled ids."""
        begin, middle, end = (np.flatnonzero(ids == x) for x in (self.start, self.separator, self.end))
        spans = [s for b, m, e in zip(begin, middle, end, strict=True) for s in ((b + 1, m), (m + 1, e))]
        marked = np.flatnonzero(np.diff(mask, prepend=0) == 1), np.flatnonzero(np.diff(mask, append=0) == -1) + 1
        spans += list(zip(*marked, strict=True))
        texts = self.codec.decode_batch([ids[a:b].tolist() for a, b in spans], skip_special_tokens=False)
        n, under = len(begin), {int(a): unescape(t) for (a, _), t in zip(spans[2 * len(begin) :], texts[2 * len(begin) :], strict=True)}
        marks = len(START) + len(SEPARATOR) + len(END)
        return [(unescape(texts[2 * i]), unescape(texts[2 * i + 1]), len(texts[2 * i]) + len(texts[2 * i + 1]) + marks, under.get(int(middle[i]) + 1, "")) for i in range(n)]


_TEMPLATES: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _TEMPLATES:
        _TEMPLATES[path] = Template(path)
    return _TEMPLATES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, chunk, ids and mask (bytes of unsigned 32-bit ids, of 8-bit flags): a conversation's chunks in order are the whole of it."""
    path = path or default_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = template(path)
        # partitions are ranges in order, so that chunks are numbered within them
        conv, chunk, held, chars = None, TaskContext.get().partitionId() << 32, [], 0

        def row() -> tuple:
            ids, mask = form.assemble(held)
            return conv[0], chunk, ids.tobytes(), mask.tobytes()

        for frame in frames:
            rows = []
            for c, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
                key = (None if pd.isna(c) else int(c),)
                if held and (key != conv or len(held) >= CHUNK_TURNS or chars >= CHUNK_CHARS):
                    rows.append(row())
                    chunk, held, chars = chunk + 1, [], 0
                conv = key
                held.append((role or "", text or ""))
                chars += len(text or "")
            if rows:
                yield _frame(rows)
        if held:
            yield _frame([row()])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "chunk", "ids", "mask"])
        return out.astype({"conv_id": "Int64", "chunk": "int64"})

    order = ["conv_id", "turn", "role", "text"]
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInPandas(run, "conv_id long, chunk long, ids binary, mask binary")


def digests(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each conversation of what `format_chats` returns, read back from ids and mask."""
    path = path or default_path()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = template(path)
        conv, state = None, []

        def row() -> tuple:
            return conv[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def _frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            return out.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

        for frame in frames:
            rows = []
            for c, ids, mask in zip(frame["conv_id"], frame["ids"], frame["mask"], strict=True):
                key = (None if pd.isna(c) else int(c),)
                if key != conv:
                    if conv is not None:
                        rows.append(row())
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, chars, loss in form.read(np.frombuffer(ids, np.uint32), np.frombuffer(mask, np.int8)):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += chars
            if rows:
                yield _frame(rows)
        if conv is not None:
            yield _frame([row()])

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInPandas(run, schema)
