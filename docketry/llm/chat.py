"""Chat formatting with loss masks aligned by offsets.

A whole conversation is rendered to one text, encoded once with offsets, and the sorted spans of its
assistant texts are intersected with the sorted token spans by binary search.  Conversations flow through
sorted partitions turn by turn, so a very long one needs no more memory than a part of it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END, BREAK = "<|turn|>", "<|text|>", "<|end|>", "<|break|>"
MARKERS = (TURN, TEXT, END, BREAK)
#: Strings that must not stand in a rendered text as they are: the template's own and those of common templates.
CONTROLS = (*MARKERS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in CONTROLS))
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
#: Characters after which a very long conversation goes on in a further part; parts end between turns.
PART_CHARS = 1_000_000


def escape(text: str) -> str:
    """Double every backslash, and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo ``escape``: pairs of backslashes stand for one, single ones for none."""
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation's text and the spans of its assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace(chr(10), BREAK)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role.replace(BREAK, "\n")), unescape(body)) for role, body in _TURN.findall(text)]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_file(path)
    # markers become tokens of their own, so that no token reaches across the edge of a text
    out.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKERS])
    return out


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token whether it lies under a span; both ascend, so the ends of a span's tokens are found by binary search."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        s = np.array(spans, dtype=np.int64)
        first = np.searchsorted(offsets[:, 1], s[:, 0], side="right")
        last = np.searchsorted(offsets[:, 0], s[:, 1], side="left")
        edge = np.zeros(len(offsets) + 1, dtype=np.int64)
        full = first < last
        np.add.at(edge, first[full], 1)
        np.add.at(edge, last[full], -1)
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def masked_texts(text: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text that the masked tokens cover, each marker ending one."""
    out, at = [], np.flatnonzero(mask)
    if len(at):
        for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
            out.append(text[offsets[run[0], 0] : offsets[run[-1], 1]])
    return out


def _parts(rows: Iterator[tuple], limit: int) -> Iterator[tuple[object, int, bool, list[tuple[str, str]]]]:
    """Conversation, number of the part, whether it is the last, and its turns, from rows sorted by conversation."""
    held, size, part, conv, begun = [], 0, 0, None, False
    for c, role, text in rows:
        if begun and c != conv:
            yield conv, part, True, held
            held, size, part = [], 0, 0
        elif size > limit:
            yield conv, part, False, held
            held, size, part = [], 0, part + 1
        conv, begun = c, True
        held.append((role, text))
        size += len(text) + len(role)
    if begun:
        yield conv, part, True, held


def _encoded(batches: Iterator[pd.DataFrame], path: str) -> Iterator[tuple]:
    """Parts with text, token ids, offsets and mask; parts are encoded some at a time."""
    tokenizer = _tokenizer(path)

    def rows():
        for b in batches:
            for c, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                yield None if pd.isna(c) else int(c), role or "", text or ""

    def flush(held):
        drawn = [render(turns) for _, _, _, turns in held]
        for (conv, part, last, _), (text, spans), e in zip(held, drawn, tokenizer.encode_batch([t for t, _ in drawn], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            yield conv, part, last, text, e.ids, offsets, loss_mask(offsets, spans)

    held, size = [], 0
    for p in _parts(rows(), PART_CHARS):
        held.append(p)
        size += sum(len(t) for _, t in p[3])
        if size > PART_CHARS:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)


def _sorted(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Render and encode conversations: ``conv_id, part, text, ids, loss``, from ``conv_id, turn, role, text``.

    Rows go by turn, ties by role and text; null texts and roles are empty, a null conversation is one of its
    own, and nothing is dropped.  A conversation of more than PART_CHARS goes on in further parts, each of
    whole turns; since markers are tokens of their own, ids of the parts joined are those of the whole.
    Repeated rows are repeated turns; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for conv, part, _, text, ids, _, mask in _encoded(batches, tokenizer):
            yield pd.DataFrame({"conv_id": pd.array([conv], dtype="Int64"), "part": [part], "text": [text], "ids": [ids], "loss": [mask.astype(np.int8)]})

    return _sorted(turns).mapInPandas(run, "conv_id long, part int, text string, ids array<int>, loss array<tinyint>")


def conversation_digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """What can be read back from the formatted conversations: turns, and the text under the loss mask.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens``; see
    ``format_conversations`` for the defined cases.  Digests go on from part to part.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches):
        out, seen, under = [], hashlib.sha256(), hashlib.sha256()
        n = chars = formatted = tokens = masked = 0
        for conv, _, last, text, ids, offsets, mask in _encoded(batches, tokenizer):
            for role, body in read_back(text):
                seen.update(f"{role}\n{body}\n".encode())
                n += 1
            for stretch in masked_texts(text, offsets, mask):
                plain = unescape(stretch)
                under.update(plain.encode())
                chars += len(plain)
            formatted, tokens, masked = formatted + len(text), tokens + len(ids), masked + int(mask.sum())
            if last:
                out.append((conv, n, seen.hexdigest(), chars, under.hexdigest(), formatted, tokens, masked))
                seen, under = hashlib.sha256(), hashlib.sha256()
                n = chars = formatted = tokens = masked = 0
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    return _sorted(turns).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
