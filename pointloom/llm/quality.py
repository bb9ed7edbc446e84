"""Quality rules on repetition: how many characters of a text lie inside n-grams and lines that it has had before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE_BYTES, WordIds, as_bytes, batches, kept, mix64

#: Symbols that the base counts, and the largest shares of characters in repeated n-grams of a good text, by n.
#: The shares are twice the published ones for web text, so that a short text may say one line of its own again.
SYMBOLS = b"#*$%&|<>"
MAX_SHARE = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: The largest share of characters in repeated lines, and of symbols to words.
MAX_LINE_SHARE = 0.30
MAX_SYMBOLS_A_WORD = 0.25

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ngram_share double, line_share double"
)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    near = np.zeros(1 << 16, bool)
    near[twice >> np.uint64(48)] = True
    found = np.flatnonzero(near[keys >> np.uint64(48)])
    out = np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys[found]), len(twice) - 1)
    out[found] = twice[at] == keys[found]
    return out


def again(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred earlier in the array."""
    twice = np.flatnonzero(repeated(keys))
    out = np.zeros(len(keys), bool)
    _, first = np.unique(keys[twice], return_index=True)
    out[twice] = True
    out[twice[first]] = False
    return out


def covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of the given width that starts at a hit."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.subtract.at(step, np.minimum(at + width, n), 1)
    return np.cumsum(step)[:n] > 0


def lines_again(data: bytes) -> tuple[int, int]:
    """Lines that have a word and equal an earlier line of the text: how many, and their characters."""
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0, 0
    seen: set[bytes] = set()
    count = chars = 0
    for line in lines:
        if line in seen:
            if line.split(None, 1):
                count += 1
                chars += len(line.decode("utf-8", "replace"))
        else:
            seen.add(line)
    return count, chars


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text, for a whole batch at once."""
    n = len(texts)
    blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    starts = np.cumsum(sizes) - sizes
    space = _SPACE[blob]
    letter = ~space & ((blob & 0xC0) != 0x80)
    total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    cells = np.cumsum(letter)
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1]))) - 1
    length = (cells[end] - cells[begin] + letter[begin]).astype(np.int64)
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(doc, minlength=n)
    word_ids = kept("words", WordIds)
    ids = np.concatenate([word_ids.array(t.split()) for t in texts]) if n else np.empty(0, np.uint64)
    m = len(ids)
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    chars = np.maximum(by_doc(length), 1)
    out = {"n_words": words, "word_chars": total(letter), "n_symbols": total(_SYMBOL[blob]), "n_repeat_words": np.zeros(n, np.int64)}
    worst = np.zeros(n)
    keys = mix64(doc.astype(np.uint64) + np.uint64(1))
    for width in range(1, max(MAX_SHARE) + 1):
        if m < width:
            break
        # a window's hash from the shorter one's; a doc's number is in it, so windows of other texts never match
        keys = mix64(keys[: m - width + 1] * np.uint64(0x9E3779B97F4A7C15) + ids[width - 1 :])
        if width != 3 and width not in MAX_SHARE:
            continue
        inside = np.flatnonzero(doc[: m - width + 1] == doc[width - 1 :])
        hit = np.zeros(m, bool)
        if width == 3:
            hit[inside] = repeated(keys[inside])
            out["n_repeat_words"] = by_doc(covered(hit, width, m)).astype(np.int64)
        else:
            hit[inside] = again(keys[inside])
            worst = np.maximum(worst, by_doc(covered(hit, width, m) * length) / chars / MAX_SHARE[width])
    lines = np.array([lines_again(t) for t in texts], np.int64).reshape(n, 2)
    out |= {"n_dup_lines": lines[:, 0], "ngram_share": worst, "line_share": lines[:, 1] / chars}
    out["base_failed"] = (words < 50) | (100 * out["n_repeat_words"] > 50 * words)
    good = (worst <= 1) & (out["line_share"] <= MAX_LINE_SHARE) & (out["n_symbols"] <= MAX_SYMBOLS_A_WORD * np.maximum(words, 1))
    return out | {"kept": ~out["base_failed"] & good}


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures and verdict of every text, one row per input row.

    ngram_share is the worst ratio, over n of MAX_SHARE, of the share of a text's word characters inside n-grams that it had
    earlier to the largest share allowed; line_share the characters of repeated lines to word characters. A null or empty text
    has zeros and fails by its length; a null doc_id stays null; repeated rows are measured each; an empty table gives none.
    Long texts are measured whole: a batch holds at least one text, and is cut by bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
        fields = [x.split() for x in RESULT.split(", ")][1:]
        for batch in batches(it, rows=2048, megabytes=8):
            got = measure(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k], types[t]) for k, t in fields)], ["doc_id", *(k for k, _ in fields)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("text")).mapInArrow(run, RESULT)
