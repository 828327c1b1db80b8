"""Line-first quality rules: lines that fail go, then documents that lose too much text go.

A line of a text (split at each line feed) that holds a word fails when

* it neither ends with closing punctuation nor holds two words that do,
* separators make up a tenth of its words (navigation bars and breadcrumbs),
* it has a markup symbol for every fourth word or more, or
* it holds one of the boilerplate phrases.

A document is rejected by the base rules (under 50 words; over half of its words in repeated three-word
windows) or when the lines that stay hold less than ``keep_share`` of its words.  Counts come from array
operations over a block of texts; equal lines and windows are told by 64-bit hashes within one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

SYMBOLS = "#*$%&|<>"
#: Characters that close a sentence or a quotation; beyond ASCII as UTF-8 ends.
CLOSING = K.table(".!?:;\"')]")
CLOSING_MORE = tuple(c.encode() for c in "。！？…”’»」』।؟۔：；）")
SEPARATORS = K.table("|>/-*~")
SEPARATORS_MORE = tuple(c.encode() for c in "»›•·→")
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "javascript is disabled", "click here to", "sign up for our", "subscribe to our newsletter",
    "lorem ipsum", "share this article", "skip to content", "log in to comment",
)
LEAST_WORDS = 50
KEEP_SHARE = 0.5

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_failed_lines long, kept_words long, kept boolean"
_U = np.uint64
_SYMBOL = K.table(SYMBOLS)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _again(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry whether an equal one of the same owner stands before it, and how many equal ones there are."""
    if not len(hashes):
        return np.zeros(0, np.bool_), np.zeros(0, np.int64)
    own = hashes ^ K.mix((owner + 1).astype(_U))
    _, first, which, many = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return first[which] != np.arange(len(own)), many[which]


def judge(texts: K.Texts, keep_share: float = KEEP_SHARE) -> tuple[dict[str, np.ndarray], np.ndarray, tuple]:
    """The counts and verdicts of each text, which of its lines fail, and the spans of the lines."""
    data = texts.data
    ws, we, wfirst = K.word_spans(texts, K.NOT_BLANK)
    n_words = np.diff(wfirst)
    symbol = _SYMBOL[data]
    starts = ((data & 0xC0) != 0x80) & K.NOT_BLANK[data]

    ls, le, lfirst = K.line_spans(texts)
    line_of = K.owners(lfirst)
    lw0, lw1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    words_in = lw1 - lw0
    worded = words_in > 0
    again, _ = _again(K.span_hashes(data, ls, le)[worded], line_of[worded])
    dup = np.zeros(len(ls), np.bool_)
    dup[worded] = again

    word_hash = K.span_hashes(data, ws, we)
    grams, at = K.windows(word_hash, wfirst, 3)
    _, many = _again(grams, K.owners(wfirst)[at])
    cover = np.zeros(len(ws) + 1, np.int64)
    hit = at[many >= 2]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)
    repeated = np.cumsum(cover)[:-1] > 0

    out = {
        "n_words": n_words,
        "word_chars": _sums(starts, texts.starts, texts.ends),
        "n_symbols": _sums(symbol, texts.starts, texts.ends),
        "n_dup_lines": _sums(dup, lfirst[:-1], lfirst[1:]),
        "n_repeat_words": _sums(repeated, wfirst[:-1], wfirst[1:]),
    }
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > 50 * n_words)

    fails = np.zeros(len(ls), np.bool_)
    full = np.flatnonzero(worded)
    last = we[lw1[full] - 1]
    closed = CLOSING[data[last - 1]]
    for i in np.flatnonzero(~closed & (data[last - 1] >= 128)).tolist():
        closed[i] = data[max(0, last[i] - 4) : last[i]].tobytes().endswith(CLOSING_MORE)
    ended = _sums(CLOSING[data[we - 1]], lw0, lw1)[full] >= 2
    fails[full] = ~(closed | ended)
    bars = (we - ws == 1) & SEPARATORS[data[ws]] if len(ws) else np.zeros(0, np.bool_)
    for i in np.flatnonzero((we - ws <= 3) & (data[ws] >= 0xC2) & (we - ws >= 2)).tolist() if len(ws) else ():
        bars[i] = data[ws[i] : we[i]].tobytes() in SEPARATORS_MORE
    fails |= worded & (10 * _sums(bars, lw0, lw1) >= words_in)  & (_sums(bars, lw0, lw1) > 0)
    fails |= worded & (4 * _sums(symbol, ls, le) >= words_in) & (_sums(symbol, ls, le) > 0)
    small = K.LOWER[data].tobytes()
    for phrase in BOILERPLATE:
        key, found = phrase.encode(), -1
        while (found := small.find(key, found + 1)) >= 0:
            line = int(np.searchsorted(ls, found, "right")) - 1
            if found + len(key) <= le[line]:
                fails[line] = True
    out["n_failed_lines"] = _sums(fails, lfirst[:-1], lfirst[1:])
    out["kept_words"] = _sums(words_in * ~fails, lfirst[:-1], lfirst[1:])
    out["kept"] = ~out["base_failed"] & (out["kept_words"] >= keep_share * n_words)
    return out, fails, (ls, le, lfirst)


def cleaned(texts: K.Texts, fails: np.ndarray, spans: tuple) -> list[bytes]:
    """Each text without its failed lines."""
    ls, le, lfirst = spans
    out = []
    for i, (a, b) in enumerate(zip(lfirst[:-1].tolist(), lfirst[1:].tolist())):
        if fails[a:b].any():
            out.append(b"\n".join(texts.data[ls[j] : le[j]].tobytes() for j in range(a, b) if not fails[j]))
        else:
            out.append(texts.raw(i))
    return out


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_share: float = KEEP_SHARE, with_text: bool = True) -> DataFrame:
    """``key``, counts, verdicts and (``with_text``) the cleaned text of every row.

    A null or empty text has no words: all counts are 0 and it is rejected.  Null keys, repeated rows and
    ties are rows like any other; an empty table gives none; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def block(rows, texts):
        out, fails, spans = judge(texts, keep_share)
        columns = [rows.column(0), *(pa.array(v) for v in out.values())]
        if with_text:
            columns.append(pa.array([x.decode() for x in cleaned(texts, fails, spans)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["k", *out, "clean_text"][: len(columns)])

    schema = f"k {kind}, {STATS}" + ", clean_text string" * with_text
    return K.arrow_map(base, block, schema, "t").withColumnRenamed("k", key)


def keep_good(docs: DataFrame, text: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, with the cleaned text in place of the text."""

    def block(rows, texts):
        out, fails, spans = judge(texts, keep_share)
        new = pa.array([x.decode() for x in cleaned(texts, fails, spans)], pa.string())
        rows = rows.set_column(rows.schema.get_field_index(text), text, new)
        return rows.filter(pa.array(out["kept"]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return K.arrow_map(docs, block, schema, text)
