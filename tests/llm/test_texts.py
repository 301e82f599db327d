from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matrella.llm import leaks, packing, queries, repetition
from matrella.llm.words import slabs, words_of

DOC = "doc_id bigint, text string, source string, host string, tokens string"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "h", "clash", "clash") for k, t in enumerate(texts)], DOC)


# --- words -----------------------------------------------------------------------------------------------------------------------------


def plain_words(text):
    out = []
    for line in (text or "").replace("\r", "").split("\n"):
        if "-->" in line or re.fullmatch(r"[ \t]*[0-9]+[ \t]*", line):
            continue
        line = re.sub(r"<[^<>]*>|\{[^{}]*\}|\[[^\[\]]*\]|\([^()]*\)", " ", line)
        out += re.findall(r"[^\W_]+", re.sub("['’]", "", line).lower())
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1\r\n00:01 --> 00:02\r\n<i>Don’t</i> go_there, [door] ÉTÉ 42!\n\n 7 \t\nthe (end) {x}", ["dont", "go", "there", "été", "42", "the"]),
        ("a <b\nc> d", ["a", "b", "c", "d"]),
        ("((x) y) z", ["y", "z"]),
        ("٣٤\n12a", ["٣٤", "12a"]),
        ("", []),
        (None, []),
    ],
)
def test_words(text, want):
    assert words_of(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab1 \t\r\n<>()[]{}'’_-é-->", max_size=60))
def test_words_against_plain_rules(text):
    assert words_of(text) == plain_words(text)


def test_slabs():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10, "", None, "y" * 50, "z"])], ["text"])
    assert [s.num_rows for s in slabs(b, "text", 10, 12)] == [3, 1, 1] and [s.num_rows for s in slabs(b, "text", 2)] == [2, 2, 1]
    assert list(slabs(b.slice(0, 0), "text")) == [] and [s.num_rows for s in slabs(b.slice(3, 2), "text", 9, 12)] == [1, 1]


# --- repetition ------------------------------------------------------------------------------------------------------------------------


def covered(words, n):
    at = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    hit = [False] * len(words)
    for k in range(len(words) - n + 1):
        if at[tuple(words[k : k + n])] > 1:
            hit[k : k + n] = [True] * n
    return hit


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=4))
def test_runs_against_brute_force(texts):
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.array([w for t in texts for w in t], np.int64).view(np.uint64)
    assert repetition.repeated_runs(codes, doc, 3).tolist() == [x for t in texts for x in covered(t, 3)]


def test_shares_of_edge_cases(spark):
    long = "one two three four five six seven. " * 20_000
    got = {r.doc_id: r for r in repetition.judged(docs(spark, None, "", "a b c", long, "line here\nline here", "x y z\n\nx y z\n\nw")).collect()}
    assert len(got) == 6 and got[0].n_words == 0 and got[1].run_share == 0 and not got[2].runs_fails
    assert got[3].run_share == 1 and got[3].runs_fails and got[4].line_share == 0.5 and got[5].block_share > 0.4
    assert repetition.judged(docs(spark, "x").limit(0)).count() == 0


def test_small_hosts_are_shrunk_towards_all(spark):
    m = [("big", k, 0.0) for k in range(200)] + [("bad", k, 0.9) for k in range(50)] + [("tiny", 0, 0.9)] + [(None, k, 0.0) for k in range(5)] + [(f"h{k}", j, 0.0) for k in range(20) for j in range(30)]
    df = spark.createDataFrame([(k, h, 100, s, 0.0, 0.0) for h, k, s in m], repetition.SHARES)
    v = {r.host: r for r in repetition.host_verdicts(df).collect()}
    assert v["bad"].host_bad and not v["big"].host_bad and 0.05 < v["tiny"].runs_rate < v["bad"].runs_rate and v[None].n_docs == 5


def test_found_repetition(spark, sf):
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = plain_words(r.text)
        if w and sum(covered(w, 6)) >= 0.3 * len(w):
            want.add(r.doc_id)
    assert want and {r.doc_id for r in queries.p9_found(spark, sf).collect()} == want
    assert queries.p9_hosts(spark, sf).count() > 1


# --- leaks -----------------------------------------------------------------------------------------------------------------------------


def test_found_leaks(spark, sf):
    at = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect():
        w = plain_words(r.passage)
        for k in range(len(w) - 9):
            at[tuple(w[k : k + 10])].add(r.item_id)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = plain_words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 9) for i in at.get(tuple(w[k : k + 10]), ())}
    assert want and {tuple(r) for r in queries.p8_found(spark, sf).collect()} == want


PASSAGE = "the quick brown fox jumps over the lazy dog while seven silver herons watch from the far bank of the river"


def leaked(spark, texts, passages, **args):
    items = spark.createDataFrame([(k, p, "clash") for k, p in enumerate(passages)], "item_id bigint, passage string, doc_id string")
    return {(r.doc_id, r.item_id): r for r in leaks.leaks(docs(spark, *texts), items, **args).collect()}


def test_leaks_with_edits_and_edges(spark):
    words = PASSAGE.split()
    cut = "1\n00:01 --> 00:02\nThe QUICK brown\n\n2\n00:03 --> 00:04\n<i>fox jumps</i> over the lazy dog while"
    texts = [PASSAGE, " ".join(words[3:13]), " ".join(words[3:12]), " ".join(words[2:12]).replace("jumps", "jumpz"), cut, None, "", "filler " * 50_000 + " ".join(words[5:16]) + " filler" * 1000, "nothing here"]
    got = leaked(spark, texts, [PASSAGE, "too short", None, PASSAGE])
    assert {d for d, i in got if i == 0} >= {0, 1, 3, 4, 7} and {(d, i) for d, i in got if i in (1, 2)} == set()
    assert {d for d, i in got if i == 0} == {d for d, i in got if i == 3}
    exact = {d for (d, i), r in got.items() if i == 0 and r.exact_words >= 10}
    assert exact == {0, 1, 4, 7} and got[0, 0].exact_words == len(words)
    assert leaked(spark, [PASSAGE], []) == {} and leaked(spark, [], [PASSAGE]) == {}


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    cut = leaks._pieces
    monkeypatch.setattr(leaks, "_pieces", lambda texts, overlap: cut(texts, overlap, 40))
    text = "filler word " * 30 + PASSAGE + " filler word" * 30
    got = leaked(spark, [text, "short"], [PASSAGE])
    assert got[0, 0].exact_words == len(PASSAGE.split()) and len(got) == 1


def test_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 50)
    assert set(leaked(spark, [PASSAGE], [PASSAGE, PASSAGE.replace("fox", "owl"), "a b c d e f g h i j k l"])) == {(0, 0), (0, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=30, max_size=60), st.integers(0, 15), st.booleans())
def test_no_run_of_ten_words_is_missed(words, start, edit):
    passage = " ".join(f"{w}{k % 3}" for k, w in enumerate(words))
    run = passage.split()[start : start + 10]
    text = leaks.normal("zz yy " + " ".join(run) + " xx ww")
    ix = leaks.build_index([(1, leaks.normal(passage))], 10, 1 if edit else 0)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    doc, item, shared, score, exact = leaks.leaks_of(chars, np.array([len(text) + 1]), ix, 1 if edit else 0)
    assert exact.max(initial=0) >= 10


def test_neighbouring_texts_are_kept_apart():
    """The next text goes on with the same passage, on the same diagonals."""

    def found(passage, *texts):
        ix = leaks.build_index([(1, leaks.normal(passage))], 10, 1)
        texts = [leaks.normal(t) for t in texts]
        chars = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        doc, _, _, _, exact = leaks.leaks_of(chars, np.cumsum([len(t) + 1 for t in texts]), ix, 1)
        return {int(d): int(exact[doc == d].max()) for d in doc}

    words = [f"word{k}" for k in range(30)]
    assert found(" ".join(words), " ".join(words[:14]), " ".join(words[14:]), "other") == {0: 14, 1: 16}
    assert found(" ".join(words), "other", " ".join(words[:14]), " ".join(words[14:19])) == {1: 14}
    short = [a + b for a in "abcd" for b in "wxyz"]
    assert found(" ".join(short), " ".join(short[:6]), " ".join(short[6:12])) == {}  # no text holds ten words
    assert found(" ".join(short), " ".join(short[:12])) == {0: 12}


def test_gram_codes_by_doubling():
    chars = np.array([5, 6, 7, 5, 6, 7, 8], np.uint32)
    for q in (1, 2, 3, 5, 7):
        codes, grams = leaks.gram_codes(chars, q), [tuple(chars[k : k + q]) for k in range(len(chars) - q + 1)]
        assert len(codes) == len(grams)
        assert all((codes[a] == codes[b]) == (grams[a] == grams[b]) for a in range(len(grams)) for b in range(len(grams)))
    assert len(leaks.gram_codes(chars, 9)) == 0


# --- packing ---------------------------------------------------------------------------------------------------------------------------


def test_hilbert_curve_is_a_walk_through_all_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert np.all(np.abs(np.diff(walk, axis=0)).sum(1) == 1)


def test_sizes():
    texts = pa.array(["", "abc", "é", "x" * 100])
    assert packing.byte_tokens(texts).tolist() == [1, 4, 3, 101] and packing.byte_tokens(texts.slice(1, 2)).tolist() == [4, 3]
    v = packing.hashed_vectors(pa.array(["", "ab", "abcdefgh", "abcdefgh", "hello there", "hello there"]))
    assert np.array_equal(v[2], v[3]) and np.array_equal(v[4], v[5]) and not v[0].any() and not v[1].any() and np.isclose(np.linalg.norm(v[4]), 1)


def test_other_tokenizer():
    import public_tokenizers

    count = packing.bpe_tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert count(pa.array(["", "hello world"])).tolist()[0] == 0 and 0 < count(pa.array(["hello world"]))[0] < 11


def check_packed(items, placed, capacity):
    room, pieces = collections.Counter(), collections.defaultdict(list)
    for r in placed:
        room[r.container] += r.tokens
        pieces[r.doc_id].append((r.piece, r.n_pieces, r.tokens))
    assert max(room.values(), default=0) <= capacity
    assert {d: sum(t for *_, t in p) for d, p in pieces.items()} == items
    for d, p in pieces.items():
        n = -(-items[d] // capacity)
        assert sorted(k for k, *_ in p) == list(range(n)) and all(x[1] == n for x in p)
    return sum(room.values()) / (capacity * len(room)) if room else 1


@pytest.mark.parametrize("parts", [1, 7])
def test_every_token_is_packed_once(spark, parts, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 64)
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 900, 1500), [1000, 1001, 2500, 1], np.full(50, 501)])
    items = {k: int(n) for k, n in enumerate(sizes)}
    df = spark.createDataFrame([(k, n, int(rng.integers(0, 50))) for k, n in items.items()], "doc_id bigint, tokens bigint, place bigint").repartition(parts)
    placed = packing.packed(df, 1000).collect()
    assert check_packed(items, placed, 1000) > 0.93


def test_packing_edges(spark):
    df = packing.sized_items(docs(spark, None, "", "x" * 8191, "y" * 8192, "z" * 20_000, "x" * 8191))
    placed = packing.packed(df).collect()
    check_packed({1: 1, 2: 8192, 3: 8193, 4: 20_001, 5: 8192}, placed, 8192)
    assert packing.packed(df.limit(0)).count() == 0


def test_found_packing(spark, sf):
    text = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    sizes = {r.doc_id: len(r.text.encode()) + 1 for r in text}
    assert {r.doc_id for r in queries.p7_found(spark, sf).collect()} == {d for d, n in sizes.items() if n > 8192}
    assert check_packed(sizes, queries._placed(spark, sf).collect(), 8192) > 0.9
    c = queries.p7_containers(spark, sf).collect()
    assert all(r.tokens + r.unused == 8192 for r in c)


def test_documents_of_bad_hosts_are_suspect_earlier(spark):
    """The host's verdict is joined to each document: at a quarter repeated, one of a bad host is suspect, one of another is not; neither fails."""
    again = "one two three four five six seven"
    bad = " ".join([again] * 9)
    fresh = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    quarter = lambda k: f"{again} {fresh(k, 21)} {again} {fresh(k + 500, 21)}"
    rows = [(k, bad, "spam") for k in range(30)] + [(100, quarter(100), "spam")] + [(200 + k, fresh(200 + k, 40), "fine") for k in range(30)] + [(300, quarter(300), "fine"), (301, bad, "fine"), (302, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in repetition.judged(df).collect()}
    assert len(got) == len(rows) and got[100].host_bad and not got[300].host_bad
    assert got[100].runs_suspect and not got[100].runs_fails and not got[300].runs_suspect and 0.2 <= got[300].run_share < 0.3
    assert all(r.runs_suspect for r in got.values() if r.runs_fails) and got[301].runs_fails and not got[302].runs_suspect
