"""The words of a subtitle text.

Carriage returns are deleted; of the lines (split at line feeds) those with `-->` and those of digits only, with blanks or tabs around
them, are left out; what stands within <>, {}, [] or () in a line becomes a blank, brackets included, innermost pairs only; apostrophes are
deleted, the case is lowered, and words are the longest runs of Unicode letters and digits; all characters with a numeric value count as digits, also
superscripts and fractions, which wrongly decoded texts are full of.  Null and empty texts have no words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BRACKETS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|\[[^\[\]\n]*\]|\([^()\n]*\)")
_WORD = re.compile(r"[^\W_]+")


def kept_lines(text: str) -> list[str]:
    """The lines that hold spoken text, carriage returns deleted."""
    if "\r" in text:
        text = text.replace("\r", "")
    return [x for x in text.split("\n") if "-->" not in x and not _is_number(x)]


def _is_number(line: str) -> bool:
    core = line.strip(" \t")
    return core.isdigit() and core.isascii()


def plain(lines: list[str]) -> str:
    """Lines without brackets and apostrophes, in lower case."""
    text = "\n".join(lines)
    if any(c in text for c in "<{[("):
        text = _BRACKETS.sub(" ", text)
    if "'" in text or "’" in text:
        text = text.replace("'", "").replace("’", "")
    return text.lower()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(plain(kept_lines(text))) if text else []


def slabs(batch: pa.RecordBatch, text: str, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of at most so many rows, and of at most so many bytes of text unless a single text is longer."""
    wide = batch.column(text).cast(pa.large_string())
    ends = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
