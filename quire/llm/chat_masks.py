"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the loss mask
comes from intersecting two sorted lists, the spans of assistant texts and the
character spans of tokens, by binary search.

Template (control strings are single tokens and mark the turns):

    system     [SYS]text[/SYS]
    user       [INST]text[/INST]
    assistant  <s>text</s>
    other      [ROLE]role[/ROLE]text</s>

A control string inside a text or role is escaped by one backslash after its
first character, ``</s>`` becomes ``<\\/s>``; a text that already has
backslashes there gets one more, so unescaping (one backslash less) restores
every text exactly.

Defined cases: null texts and roles are empty; turns are ordered by turn, then
role, then text (null turns first), repeated rows are repeated turns; a null
conv_id is a conversation of its own; an empty table gives an empty result;
extra columns are not read.  A conversation is one training sample and one
output row, so it is the unit of work.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CONTROLS = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")
OPEN = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}

_TAIL = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([\[<])(\\*)({_TAIL})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)({_TAIL})")
_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
                   r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, spans of the assistant texts) of (role, text) turns."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role in OPEN:
            head, tail = OPEN[role]
        else:
            head, tail = f"[ROLE]{escape(role)}[/ROLE]", "</s>"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + tail)
        at += len(out[-1])
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for m in _TURN.finditer(text):
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[int]]]:
    """(1 for each token that lies in a span at least in part, character ranges
    under the mask).

    Both lists are sorted: the tokens of a span are found by two binary
    searches.  Tokens that share a character (parts of one) count it once, and
    a range never passes the span.
    """
    mask = np.zeros(len(offsets), dtype=np.int8)
    ranges: list[list[int]] = []
    if not len(offsets):
        return mask, ranges
    start, end = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    for lo, hi in spans:
        a = int(np.searchsorted(end, lo, side="right"))    # first token that ends after the span begins
        b = int(np.searchsorted(start, hi, side="left"))   # first token that begins at or after its end
        mask[a:b] = 1
        here: list[list[int]] = []
        if a < b:
            s, e = np.maximum(start[a:b], lo), np.minimum(end[a:b], hi)
            cut = np.flatnonzero(s[1:] > e[:-1]) + 1       # where tokens leave a gap
            here = [[int(s[i]), int(e[j - 1])] for i, j in zip([0, *cut], [*cut, b - a])]
        ranges += [r for r in here if r[0] < r[1]]
    return mask, ranges


def _tokenizer(spec: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(spec)
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # a token keeps the space before its word
    t.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    return t


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, text, token_ids, token_mask, loss_ranges) of every conversation.

    ``token_mask`` is 1 where a token carries loss; ``loss_ranges`` are the
    characters of ``text`` under the mask.  ``tokenizer``: path of a byte-level
    BPE file, read by the driver and handed to the tasks (fixed size).
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = conversations.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _tokenizer(spec.value)
        for pdf in batches:
            rows = []
            for conv, turns in zip(pdf["conv_id"], pdf["turns"]):
                text, spans = render([(x["role"], x["text"]) for x in turns])
                code = t.encode(text, add_special_tokens=False)
                mask, ranges = token_mask(np.array(code.offsets, dtype=np.int64).reshape(-1, 2), spans)
                rows.append((conv, text, code.ids, mask.tolist(), ranges))
            out = pd.DataFrame(rows, columns=["conv_id", "text", "token_ids", "token_mask", "loss_ranges"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    blank = F.lit("")
    src = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), blank).alias("role"),
        F.coalesce(F.col("text"), blank).alias("text")).alias("x"))
    whole = src.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    return whole.mapInPandas(run, "conv_id long, text string, token_ids array<int>, token_mask array<tinyint>, "
                                  "loss_ranges array<array<int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted text and its loss ranges."""

    def run(batches):
        from hashlib import sha256

        for pdf in batches:
            rows = []
            for conv, text, ranges in zip(pdf["conv_id"], pdf["text"], pdf["loss_ranges"]):
                turns = parse(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(text[a:b]) for a, b in ranges)
                rows.append((conv, len(turns), sha256(whole.encode()).hexdigest(), len(loss),
                             sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                              "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return formatted.select("conv_id", "text", "loss_ranges").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
