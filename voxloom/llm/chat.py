"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, with control strings around each turn.
Control strings inside a text are escaped, so every one in the output is the
template's, and the tokenizer holds them as single special tokens: no token
straddles a turn's edge.  The rendered conversation is encoded once; tokens
are runs of bytes, so their offsets are sums of token lengths.  The sorted
spans of assistant texts meet the sorted offsets by binary search, which gives
the token mask.

Rows arrive sorted by conversation and turn.  A conversation is one text to be
encoded, hence held whole in one task; nothing larger is.

The tokenizer is a file of byte-level ranks.  Its path is a parameter and must
lie where every executor reaches it: on a local path, or sent to executors by
``SparkContext.addFile`` and named without a folder.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

# The template's control strings, and the pattern that the rank file's vocabulary was split by.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (OPEN, BODY, CLOSE)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Formatted characters that a batch of output holds, or one conversation.
BATCH_CHARS = 1 << 20
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """Adds a backslash before the bar of every "<|", "<\\|", ...: no control string is left, and one step undoes it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: str) -> tuple[str, np.ndarray]:
    """The conversation, and where each learned text begins and ends in its UTF-8."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + BODY, escape(text)
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == learned and end > start:
            spans.append((start, end))
        parts += [head, body, CLOSE]
        at = end + len(CLOSE)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


@cache
def tokenizer(path: str):
    """The encoder, and the bytes of every token."""
    import tiktoken

    with open(path if os.path.isabs(path) else SparkFiles.get(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    free = max(ranks.values()) + 1
    special = {c: free + k for k, c in enumerate(CONTROL)}
    size = np.zeros(free + len(CONTROL), np.int64)
    for raw, k in [*ranks.items(), *((c.encode(), k) for c, k in special.items())]:
        size[k] = len(raw)
    return tiktoken.Encoding("conversations", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), size


def encode(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids, and where each token begins in the UTF-8; one more entry than ids."""
    encoder, size = tokenizer(path)
    ids = encoder.encode_to_numpy(text, allowed_special="all").astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum(size[ids])])


def token_mask(starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens begin in one of the sorted, disjoint ``spans``."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (at >= 0) & (starts < spans[np.maximum(at, 0), 1])


_FORMATTED = "conv_id long, text string, tokens array<int>, mask array<boolean>, starts array<int>"
_KINDS = {"conv_id": pa.int64(), "text": pa.string(), "tokens": pa.list_(pa.int32()), "mask": pa.list_(pa.bool_()), "starts": pa.list_(pa.int32())}


def _formatted(path: str, learned: str):
    def made(conv, turns: list[tuple[str, str]]) -> tuple:
        text, spans = render(turns, learned)
        ids, at = encode(text, path)
        return conv, text, ids, token_mask(at[:-1], spans), at[:-1].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out, held = None, [], [], 0
        for batch in batches:
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "role", "text")], strict=True):
                if turns and c != conv:
                    out.append(made(conv, turns))
                    turns = []
                    held += len(out[-1][1])
                    if held > BATCH_CHARS:
                        yield kernels.batch_of(out, _KINDS)
                        out, held = [], 0
                conv = c
                turns.append((role or "", text or ""))
        if turns:
            out.append(made(conv, turns))
        yield kernels.batch_of(out, _KINDS)

    return run


def format_conversations(turns: DataFrame, path: str = TOKENIZER, learned: str = "assistant") -> DataFrame:
    """conv_id, text, tokens, mask, starts: one row per conversation of ``turns`` (conv_id, turn, role, text).

    ``starts`` are the tokens' offsets in the UTF-8 of ``text``; a token ends
    where the next begins.  Turns are ordered by turn, then role and text; null
    roles and texts are empty; rows with a null conv_id form one conversation;
    repeated rows are turns like others.  Other columns are ignored; an empty
    table gives an empty result.
    """
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    rows = turns.select(*[F.col(k).cast(t).alias(k) for k, t in kinds.items()])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_formatted(path, learned), _FORMATTED)


def masked_texts(raw: bytes, mask: np.ndarray, starts: np.ndarray) -> list[str]:
    """Texts under the mask, unescaped: one for each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    at = np.append(starts, len(raw))
    return [unescape(raw[at[a] : at[b]].decode()) for a, b in edge.reshape(-1, 2)]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_tokens": pa.int64(), "n_loss_tokens": pa.int64()}
    for batch in batches:
        out = []
        for i, (conv, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            mask, starts = (np.array(batch.column(k)[i].values) for k in ("mask", "starts"))
            turns = _TURN.findall(text)
            whole = "".join(f"{unescape(role)}\n{unescape(body)}\n" for role, body in turns)
            loss = "".join(masked_texts(text.encode(), mask.astype(bool), starts))
            out.append((conv, len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
        yield kernels.batch_of(out, kinds)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens, from the output alone.

    Each row stands for itself, so stored output may be read in any split.
    """
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return formatted.mapInArrow(_read_back, shape)
