"""Evaluation passages leaking into a training corpus: q-gram lemma filtering.

Documents and passages are reduced to their words, joined by single blanks.  A stretch of L characters with at most e edits
shares at least L - q + 1 - q*e character q-grams with its source, all of them on diagonals (place in the document minus place in the passage)
at most e apart.  So:

1. all q-grams of a document are looked up in the q-grams of all passages, and only stretches dense enough in hits for any passage go on;
2. their hits are counted per passage in overlapping diagonal bands, and bands that meet the passage's bound are kept;
3. kept bands are verified by banded local alignment (match 1, edit -2), whose score must reach that of the shortest stretch with e edits.

The shortest stretch of a passage is the shortest run of `min_words` of its words, so every copy of such a run with up to e edits is found.

Null and empty texts hold nothing, passages of fewer than `min_words` words can't leak.  Repeated documents are each reported, repeated
items too.  Passages go to the tasks in blocks of bounded size, one at a time, however many there are; documents are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrella.llm.words import slabs, words_of
from matrella.session import written

Q = 12
FOUND = "doc_id bigint, item_id bigint, shared int, score int, exact_words int"
#: Passages of one block: at most so many characters (each is about 40 bytes of index in a task).
BLOCK_CHARS = 2_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
COARSE = 6  # bits of a coarse band of diagonals
_BLANK = 32


def normal(text: str | None) -> str:
    """The words with one blank between them and one on either side; an empty string without words."""
    w = words_of(text)
    return f" {' '.join(w)} " if w else ""


def gram_codes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit codes of all q-grams of a row of characters, by doubling."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    have, code, factor = 1, chars.astype(np.uint64) + np.uint64(1), _B
    done, out = 0, None
    with np.errstate(over="ignore"):
        while True:
            if q & have:
                out = code if out is None else out[: len(code) - done] * factor + code[done:] if done else code
                done += have
            if done == q:
                break
            code = code[:-have] * factor + code[have:]
            factor = factor * factor
            have *= 2
        out = out[: len(chars) - q + 1]
        out = out ^ (out >> np.uint64(31))
        return out * _B


@dataclass
class Index:
    """The q-grams of one block of passages: sorted codes, where each occurs, and what each passage asks for."""

    items: np.ndarray
    bound: np.ndarray  # shared q-grams that a band must hold
    score: np.ndarray  # score that an alignment must reach
    text: np.ndarray  # all passages' characters
    start: np.ndarray
    length: np.ndarray
    codes: np.ndarray  # distinct codes, ascending
    first: np.ndarray  # for each code its first posting; one more at the end
    item_of: np.ndarray
    place: np.ndarray
    known: np.ndarray  # bit filter of the codes
    window: int  # shortest stretch of any passage, in q-grams
    least: int  # hits that it must hold


def build_index(passages: list[tuple[int, str]], min_words: int, edits: int, q: int = Q) -> Index | None:
    items, texts, bounds, scores, shortest = [], [], [], [], []
    for item, text in passages:
        ends = [k for k, c in enumerate(text) if c == " "]
        if len(ends) <= min_words:
            continue
        low = min(b - a + 1 for a, b in zip(ends, ends[min_words:]))
        items.append(item)
        texts.append(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        shortest.append(low - q + 1)
        bounds.append(max(1, low - q + 1 - q * edits))
        scores.append(max(1, low - 3 * edits))
    if not items:
        return None
    codes, owner, place = [], [], []
    for k, t in enumerate(texts):
        g = gram_codes(t, q)
        codes.append(g)
        owner.append(np.full(len(g), k))
        place.append(np.arange(len(g)))
    code, owner, place = np.concatenate(codes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(code, kind="stable")
    distinct, first = np.unique(code[order], return_index=True)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[distinct >> np.uint64(64 - _FILTER_BITS)] = True
    length = np.array([len(t) for t in texts])
    window = max(1, min(shortest))
    return Index(np.array(items, np.int64), np.array(bounds), np.array(scores), np.concatenate(texts), np.cumsum(length) - length, length, distinct, np.append(first, len(code)), owner[order], place[order], known, window, max(1, window - q * edits))


def _dense(hits: np.ndarray, window: int, least: int) -> np.ndarray:
    """Which of the ascending places lie in some stretch of `window` places with at least `least` hits."""
    ahead = np.searchsorted(hits, hits + window) - np.arange(len(hits))
    edge = np.zeros(len(hits) + 1, np.int64)
    at = np.flatnonzero(ahead >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + ahead[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _expand(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + size: the number of the range, and each element."""
    owner = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return owner, np.repeat(first, size) + within


def align(chars: np.ndarray, doc_at: np.ndarray, ix: Index, item: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best local alignment score of each passage `item` in the band of diagonals doc_at .. doc_at + width - 1 of the characters begin .. end - 1."""
    steps = np.arange(width)
    best = np.zeros(len(item), np.int32)
    score = np.zeros((len(item), width), np.int32)
    longest = int(ix.length[item].max(initial=0))
    padded = np.concatenate([chars, np.zeros(1, chars.dtype)])
    rise = 2 * steps.astype(np.int32)
    for i in range(longest):
        live = i < ix.length[item]
        c = ix.text[np.minimum(ix.start[item] + i, len(ix.text) - 1)]
        at = doc_at[:, None] + i + steps
        d = padded[np.where((at >= begin[:, None]) & (at < end[:, None]), at, len(chars))]
        hit = (d == c[:, None]) & live[:, None]
        # the band moves one character along with the passage: straight on is the same column, a passage character without
        # partner comes from one column further, a document character without partner from one column before
        score = score + np.where(hit, 1, -2)
        score[:, :-1] = np.maximum(score[:, :-1], before[:, 1:] - 2) if i else score[:, :-1]
        score = np.maximum(np.maximum.accumulate(score + rise, axis=1) - rise, 0)
        best = np.maximum(best, np.where(live, score.max(axis=1), 0))
        before = score
    return best


def leaks_of(chars: np.ndarray, ends: np.ndarray, ix: Index, edits: int, q: int = Q) -> tuple[np.ndarray, ...]:
    """(document number, item number, shared q-grams, score, exact words) of each verified band.

    chars: documents' characters one after the other, with a character that no passage has after each of them; ends: where the next one begins.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    codes = gram_codes(chars, q)
    maybe = np.flatnonzero(ix.known[codes >> np.uint64(64 - _FILTER_BITS)])
    at = np.minimum(np.searchsorted(ix.codes, codes[maybe]), len(ix.codes) - 1)
    ok = ix.codes[at] == codes[maybe]
    hits, gram = maybe[ok], at[ok]
    keep = _dense(hits, ix.window, ix.least)
    hits, gram = hits[keep], gram[keep]
    if not len(hits):
        return none
    owner, posting = _expand(ix.first[gram], ix.first[gram + 1] - ix.first[gram])
    item = ix.item_of[posting]
    # a document that shares too few q-grams with a passage in all has no band that shares enough
    pair = np.searchsorted(ends, hits, side="right")[owner] * len(ix.items) + item
    enough = np.bincount(pair, minlength=len(ends) * len(ix.items)) >= np.tile(ix.bound, len(ends))
    keep = np.flatnonzero(enough[pair])
    if not len(keep):
        return none
    place, item, posting, pair = hits[owner[keep]], item[keep], posting[keep], pair[keep]
    diagonal = place - ix.place[posting] + (1 << 20)
    # bands of 2e+1 diagonals at least, each overlapping the next by half, so e edits never leave all bands
    half = max(4, 2 * edits)
    # nor has a band in two adjoining coarse bands that hold too few together; cells that share a counter only count too much
    cell = (pair * 40503 + (diagonal >> max(COARSE, (2 * half).bit_length()))) & ((1 << 21) - 1)
    count = np.bincount(cell, minlength=1 << 21)
    held = np.concatenate([count[-1:], count, count[:1]])
    keep = np.flatnonzero(held[cell + 1] + np.maximum(held[cell], held[cell + 2]) >= ix.bound[item])
    if not len(keep):
        return none
    place, pair, diagonal = place[keep], pair[keep], diagonal[keep]
    band = np.concatenate([2 * (diagonal // (2 * half)), 2 * ((diagonal + half) // (2 * half)) + 1])
    key = np.tile(pair, 2) * (1 << 32) + band  # a band never goes beyond its document
    kinds, inverse, shared = np.unique(key, return_inverse=True, return_counts=True)
    doc, which = np.divmod(kinds >> 32, len(ix.items))
    good = shared >= ix.bound[which]
    if not good.any():
        return none
    # the longest exact stretch on one diagonal in each kept band, in whole words
    row = np.flatnonzero(good[inverse])
    src = row % len(place)
    b, p, g = inverse[row], place[src], diagonal[src]
    order = np.lexsort((p, g, b))
    b, p, g = b[order], p[order], g[order]
    start = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)])
    end = np.r_[start[1:], len(p)] - 1
    blanks = np.concatenate([[0], np.cumsum(chars == _BLANK)])
    whole = blanks[p[end] + q] - blanks[p[start]] - 1
    words = np.zeros(len(kinds), np.int64)
    np.maximum.at(words, b[start], whole)
    chosen = np.flatnonzero(good)
    number = kinds[chosen] & ((1 << 32) - 1)
    low = (number // 2) * 2 * half - (number % 2) * half - (1 << 20)
    begin = np.concatenate([[0], ends[:-1]])
    score = np.zeros(len(chosen), np.int64)
    for k in range(0, len(chosen), 512):
        s = slice(k, k + 512)
        score[s] = align(chars, low[s] - edits, ix, which[chosen[s]], 2 * half + 2 * edits, begin[doc[chosen[s]]], ends[doc[chosen[s]]])
    fine = score >= ix.score[which[chosen]]
    chosen, score = chosen[fine], score[fine]
    return doc[chosen], which[chosen], shared[chosen], score, words[chosen]


def _pieces(texts: list[str], overlap: int, longest: int = 1 << 20) -> tuple[list[str], np.ndarray]:
    """Texts beyond `longest` characters in pieces that overlap by more than any passage is long; and the text that each piece is of."""
    out, owner = [], []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - overlap), longest):
            out.append(t[at : at + longest + overlap])
            owner.append(k)
    return out, np.array(owner, np.int64)


def _blocks(items: DataFrame, item_id: str, passage: str) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks of at most BLOCK_CHARS characters (or one passage), one empty block if there are none."""
    block: list[tuple[int, str]] = []
    room = BLOCK_CHARS
    for r in items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null").toLocalIterator():
        p = normal(r.p)
        if len(p) > room and block:
            yield block
            block, room = [], BLOCK_CHARS
        block.append((r.i, p))
        room -= len(p)
    yield block


def _pass(src: DataFrame, index: Index | None, edits: int) -> tuple[DataFrame, Broadcast]:
    """The leaks of one block's passages in all documents, and the broadcast that holds its index."""
    shipped = src.sparkSession.sparkContext.broadcast(index and vars(index))  # plain arrays: tasks need no copy of the package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = SimpleNamespace(**shipped.value) if shipped.value else None
        for batch in batches:
            for b in slabs(batch, "text") if ix else ():
                texts, owner = _pieces([normal(t) for t in b.column("text").to_pylist()], int(ix.length.max()) + 64)
                chars = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
                ends = np.cumsum([len(t) + 1 for t in texts])
                doc, item, *rest = leaks_of(chars, ends, ix, edits)
                ids = b.column("doc_id").take(pa.array(owner[doc]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ix.items[item]), *[pa.array(x.astype(np.int32)) for x in rest]], ["doc_id", "item_id", "shared", "score", "exact_words"])

    return src.mapInArrow(run, FOUND), shipped


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 10, edits: int = 1, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, shared, score, exact_words): each document with the items of which it holds a stretch.

    shared: most q-grams shared in one band; score: best alignment; exact_words: longest run of whole words found unchanged on one diagonal.
    items go out in blocks of BLOCK_CHARS characters, one pass over the documents for each block.  A benchmark's few thousand passages are one block.  Where
    there are more, the driver holds one block at a time: its index is shipped, its pass is written to the shared folder, and the index is dropped.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    out, waiting = None, None
    for block in _blocks(items, item_id, passage):
        if waiting is not None:
            part, shipped = waiting
            part = written(part)
            shipped.destroy()
            out = part if out is None else out.unionAll(part)
        waiting = _pass(src, build_index(block, min_words, edits), edits)
    part = waiting[0]
    out = part if out is None else out.unionAll(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("score").alias("score"), F.max("exact_words").alias("exact_words"))
