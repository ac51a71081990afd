"""License scans: exact phrases and fuzzy short notices.

Texts are normalised to lower-cased words (letters, digits and non-ASCII
characters) joined by single spaces.

* *Base phrases* are found exactly, at every place.
* *Notices* are found with up to k errors (insertions, deletions,
  substitutions of characters), k = one in ``ERROR_SHARE`` characters.  A
  notice is cut into k + 1 pieces; with at most k errors one piece stays
  unchanged (pigeonhole), so exact search for the pieces finds every candidate
  place.  Around each, the ``regex`` library's bounded-error matching verifies
  the edits and gives the span.

Defined cases: null is empty text, with no words, no labels and score 0.
Overlapping and repeated places all count.  Texts of any length are scanned
whole.  Repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices of public licenses, normalised, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc"),
    ("dedicated to the public domain", "public-domain"),
)
ERROR_SHARE = 10

_CLASS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
               for c in range(256))


def normalise(text: str | None) -> tuple[bytes, int]:
    """(words joined by spaces with one at both ends, number of words)."""
    words = (text or "").encode("utf-8", "replace").translate(_CLASS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def places(norm: bytes, part: bytes) -> list[int]:
    """Every place of ``part``, overlapping ones included."""
    out, at = [], norm.find(part)
    while at >= 0:
        out.append(at)
        at = norm.find(part, at + 1)
    return out


class Notice:
    """One notice with its pieces and its bounded-error pattern."""

    def __init__(self, text: str, label: str, share: int = ERROR_SHARE):
        import regex

        self.text, self.label, self.size = text.encode(), label, len(text)
        self.errors = max(1, len(text) // share)
        cuts = [i * self.size // (self.errors + 1) for i in range(self.errors + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rb"(?b)(?:%b){e<=%d}" % (regex.escape(self.text), self.errors))

    def find(self, norm: bytes) -> list[tuple[int, int, int]]:
        """(start byte, end byte, errors) of the matches, left to right.

        Every place that a piece points to is verified in a window that holds
        one match at most, from the end of the match before; a notice that
        stands close to a better one is so found too, and the work is in
        proportion to the places."""
        spots = sorted({at - off for off, piece in self.pieces for at in places(norm, piece)})
        found, done = [], 0
        for s in spots:
            lo, hi = max(done, s - self.errors), min(len(norm), s + self.size + 2 * self.errors)
            if hi - lo < self.size - self.errors:
                continue
            m = self.pattern.search(norm, lo, hi)
            if m:
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                done = m.end()
        return found


def scan_text(text: str | None, notices: list[Notice]) -> dict:
    """Places, labels and notice spans of one text (places count words)."""
    norm, n = normalise(text)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    word = lambda at: np.searchsorted(gaps, at, side="right") - 1  # noqa: E731 - number of the word at a byte
    base, labels = np.empty(0, np.int64), set()
    for phrase, label in PHRASES.items():
        at = places(norm, b" " + phrase.encode() + b" ")
        if at:
            base = np.concatenate((base, word(np.array(at, np.int64))))
            labels.add(label)
    spans, more, score = [], set(labels), 1.0 if len(base) else 0.0
    for notice in notices:
        got = notice.find(norm)
        if not got:
            continue
        first = np.maximum(word(np.array([g[0] for g in got])), 0)
        last = np.maximum(word(np.array([g[1] for g in got]) - 1), 0)
        for f, l, (_, _, errors) in zip(first.tolist(), last.tolist(), got):
            likeness = 1 - errors / notice.size
            spans.append({"label": notice.label, "first_word": f, "last_word": l, "errors": errors, "score": likeness})
            score = max(score, likeness)
    # of notices that claim the same words the one with the fewest errors counts
    claim = np.zeros(n + 1)
    for s in sorted(spans, key=lambda s: s["score"]):
        claim[s["first_word"]:s["last_word"] + 1] = s["score"]
    spans = [s for s in spans if claim[s["first_word"]:s["last_word"] + 1].max(initial=0.0) <= s["score"]]
    more |= {s["label"] for s in spans}
    return {"n_words": n, "n_base": len(base), "first_word": int(base.min()) if len(base) else None,
            "last_word": int(base.max()) if len(base) else None,
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(more)), "score": score, "spans": spans}


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """(doc_id, counts, labels, score, spans) of every row of ``docs``."""

    def run(batches):
        patterns = [Notice(t, label) for t, label in notices]
        for pdf in batches:
            rows = [scan_text(t, patterns) for t in pdf["t"]]
            out = pd.DataFrame(rows, index=pdf.index)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return src.mapInPandas(run, f"doc_id long, {COLUMNS}, spans array<struct<label:string,first_word:int,"
                                "last_word:int,errors:int,score:double>>")
