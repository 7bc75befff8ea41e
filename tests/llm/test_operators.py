"""Corpus operators against brute force, libraries and round trips; edge cases of every one."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from pairloom.llm import bpe, components, jaccard_join, license_scan, ngram_lm, packing, quality, sstable, suffix_array, suffix_dedup, token_counts, tokens, winnow

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, number int, rep string, block string"

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(150)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(70, 99)
BASE = [prose(n, k) for k, n in enumerate([300, 40, 120, 8, 2, 1, 500, 60])]
TEXTS = [
    *BASE,
    None,
    "",
    " \t\n ",
    BASE[0],  # copy
    BASE[0].replace(VOCABULARY[3], "zzz", 1),  # near copy
    BASE[0] + " tail",
    prose(20, 50) + " " + PASSAGE + " " + prose(20, 51),
    prose(30, 52) + "\n" + PASSAGE,
    PASSAGE.upper(),
    "x" * 3000,
    "ab" * 400,
    prose(6000, 53),  # long
    "# $ % & | < > * " * 20,
    "same line here\n" * 9,
    "naïve Ünïcode 中文 \U0001f600 é <|endoftext|>  double  spaces \x1c\x85",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else "s", None, 1, 2, "r", "b") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids and a null id."""
    rows = [(1, BASE[0]), (1, BASE[0]), (1, BASE[1]), (None, BASE[0]), (2, BASE[0]), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "r", "b") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def text_of(k):
    return TEXTS[k // 3] or ""


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_op1_is_the_library(docs, odd, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))
    assert len(found) == len(TEXTS)
    for k, r in found.items():
        ids = library.encode_ordinary(text_of(k))
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text_of(k).encode()).hexdigest()
    back = rows(bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN))
    assert all(bytes(r.bytes).decode() == text_of(k) for k, r in back.items())
    assert bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).count() == 6 and bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    coder = bpe.ByteBpe.from_file(RANKS, public_tokenizers.PATTERN)
    assert [coder.whole.get(t) for t in coder.vocabulary] == list(range(len(coder.vocabulary))) and coder.whole.get(b"\xff\xfe\xfd") == -1
    assert sorted(x for x in coder.whole.values) == list(range(len(coder.vocabulary)))  # minimal: every slot is taken


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_coder(name):
    coder = tokens.LibraryCoder(public_tokenizers.path(name))
    r = random.Random(1)
    alphabet = list("abc'sStTdDlL  \n\t\xa0\x85éÀß12²½.,!?<|>()×÷ª") + ["ſ", "Σ", "中", "’", " ", "\x1c", "́", "İ", "don't", "  ", "<|endoftext|>", " \n", "'s", "'ll"]
    some = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(30_000)]
    assert coder.encode(some) == coder.by_library(some)
    small = tokens.ChunkCoder(coder.coder.wide.pattern, coder.merged, coder.words, coder.by_library, entries=50)
    assert [small.encode([t])[0] for t in some[:300]] == coder.by_library(some[:300])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_merge_engine_is_the_library(name):
    """Every token of the vocabulary as a text, random letters of all lengths, and words beyond ``LONG`` symbols."""
    coder = tokens.LibraryCoder(public_tokenizers.path(name))
    r = random.Random(2)
    byte = {c: k for k, c in enumerate(tokens.byte_symbols())}
    words = [bytes(byte[c] for c in t.removesuffix(coder.end or "\0") if c in byte).decode("utf-8", "ignore") for t in coder.library.get_vocab()]
    letters = "etaoinshrdlu" * 6 + "abcdefghijklmnopqrstuvwxyz" + "éèüößñç"
    words += ["".join(r.choice(letters) for _ in range(r.randint(1, 24))) for _ in range(60_000)]
    words += ["".join(r.choice(letters) for _ in range(r.choice([95, 96, 97, 400, 3000]))) for _ in range(40)] + ["x" * 5000, "ab" * 3000]
    assert coder.encode(words) == coder.by_library(words)
    spaced = [" " + w for w in words]
    assert coder.encode(spaced) == coder.by_library(spaced)


def test_chunks_are_cut_where_matches_begin():
    """Every cut is a match's beginning, and ids of a part are those of the whole."""
    import regex

    r = random.Random(3)
    alphabet = list("aB'sé 1\n\t.,-\xa0\x85") + ["’", "中", "'re", "\r\n", "  ", " \n ", "×"]
    for _ in range(4000):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 14))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        starts = np.cumsum([0, *map(len, raw)])
        cuts = tokens.cut_places(tokens.kinds_of(np.frombuffer(b"".join(raw), np.uint8)), starts[:-1]).tolist()
        for k, t in enumerate(texts):
            own = [c - int(starts[k]) for c in cuts if starts[k] <= c < starts[k + 1]]
            begins = {len(t[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, t)}
            assert set(own) <= begins and 0 in own
            parts = [raw[k][a:b].decode() for a, b in zip(own, [*own[1:], len(raw[k])], strict=True)]
            assert [m for p in parts for m in regex.findall(public_tokenizers.PATTERN, p)] == regex.findall(public_tokenizers.PATTERN, t)


def test_one_very_long_word_is_quick():
    import time

    r = random.Random(4)
    word = "".join(r.choice("acgt") for _ in range(1 << 20))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = tokens.LibraryCoder(public_tokenizers.path(name))
        t = time.process_time()
        got = coder.encode([word])
        took, t = time.process_time() - t, time.process_time()
        assert got == coder.by_library([word])
        assert took < 20 * (time.process_time() - t) + 5


def windows(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return words


def test_op2_edits_and_guarantee(spark, docs, odd, empty):
    found = rows(winnow.compare_neighbours(docs))
    order = sorted(found, reverse=True)
    assert len(order) == len(TEXTS)
    for at, k in enumerate(order):
        t, n = text_of(k), text_of(order[(at + 1) % len(order)])
        third = len(t) // 3
        assert found[k].edited_sha256 == hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()
        assert found[k].n_chars == len(t) and 0 <= found[k].near_edited <= 1 and 0 <= found[k].near_next <= 1
    assert found[0].fingerprint == found[33].fingerprint  # a copy
    assert found[57].near_edited > 0.3 > found[57].near_next
    assert winnow.compare_neighbours(odd).count() == 6 and winnow.compare_neighbours(empty).count() == 0
    one = spark.createDataFrame([(5, BASE[2])], "doc_id long, text string")
    assert rows(winnow.compare_neighbours(one))[5].near_next == 1.0  # follows itself
    # every run of GRAM + SPAN - 1 shared words leaves a shared hash; minima are rightmost
    run = winnow.GRAM + winnow.SPAN - 1
    pair = spark.createDataFrame([(0, prose(90, 1) + " " + prose(run, 2) + " " + prose(70, 3)), (1, prose(run, 2)), (2, "a a a a a a a a a a a a a a a a a")], "doc_id long, text string")
    f = rows(winnow.fingerprints(pair))
    assert set(f[0].hashes) & set(f[1].hashes)
    assert f[2].places == list(range(winnow.SPAN - 1, 17 - winnow.GRAM + 1))


def brute_fingerprint(hash_of, text):
    """(hash, place) by rolling the cyclic polynomial over the words, then the minimum of every window."""
    words = windows(text)
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & (2**64 - 1) if k else x
    h = [hash_of[w] % 2**64 for w in words]
    if len(words) < winnow.GRAM:
        return None
    now = 0
    grams = []
    for k, x in enumerate(h):
        now = turn(now, 1) ^ x
        if k >= winnow.GRAM:
            now ^= turn(h[k - winnow.GRAM], winnow.GRAM)
        if k >= winnow.GRAM - 1:
            grams.append(now - 2**64 if now >= 2**63 else now)
    out = {}
    for at in range(max(1, len(grams) - winnow.SPAN + 1)):
        some = range(at, min(at + winnow.SPAN, len(grams)))
        place = max(some, key=lambda i: (-grams[i], i))
        out[place] = grams[place]
    return [(out[p], p) for p in sorted(out)]


def test_op2_by_brute_force(spark, docs):
    """Fingerprints, and both likenesses, of every document and edited text."""
    order = sorted((k * 3 for k in range(len(TEXTS))), reverse=True)
    texts = {k: text_of(k) for k in order}
    texts[10**6] = " ".join("ab"[k % 2] for k in range(60))  # ties everywhere
    texts[10**6 + 1] = prose(9000, 12) + " " + "z " * 40
    order = sorted(texts, reverse=True)
    edited = {}
    for at, k in enumerate(order):
        t, n = texts[k], texts[order[(at + 1) % len(order)]]
        edited[k] = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
    words = sorted({w for t in [*texts.values(), *edited.values()] for w in windows(t)})
    hash_of = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    found = rows(winnow.compare_neighbours(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)))
    shown = lambda f: " ".join(f"{h % 2**64:x}@{p}" for h, p in f)

    def likeness(a, b):
        a, b = ({x.split("@")[0] for x in f.split()} for f in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for at, k in enumerate(order):
        r, following = found[k], found[order[(at + 1) % len(order)]]
        for text, got in ((texts[k], r.fingerprint), (edited[k], r.edited_fingerprint)):
            want = brute_fingerprint(hash_of, text)
            assert (got == shown(want)) if want else got.count("@") == (1 if text else 0)
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - likeness(r.fingerprint, following.fingerprint)) < 1e-12


def test_op3_counts_are_greedy(docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = set(token_counts.pieces_of(path))
    longest = max(map(len, pieces))

    def greedy(word):
        x, i, n = (*word, token_counts.END), 0, 0
        while i < len(x):
            j = next(j for j in range(min(len(x), i + longest), i, -1) if x[i:j] in pieces)
            n += x[i:j] != (token_counts.END,)
            i = j
        return n

    found = rows(token_counts.count_tokens(docs, path))
    for k, r in found.items():
        words = text_of(k).encode().lower().split()
        assert r.n_words == len(words)
        assert r.n_tokens == sum(greedy(w) * n for w, n in collections.Counter(words).items())
    assert token_counts.count_tokens(odd, path).count() == 6 and token_counts.count_tokens(empty, path).count() == 0


def test_op3_small_automaton():
    auto = token_counts.LongestMatch([(1,), (2,), (1, 2), (2, 1, 1), (1, 2, 1), (token_counts.END,), (2, token_counts.END)])
    assert auto.count([bytes([1, 2, 1, 1, 2]), b"", bytes([2, 1]), bytes([3])]).tolist() == [2, 0, 2, 1]


def brute_repeats(pairs):
    """(n_removed, n_spans, kept) by definition."""
    seen, out = {}, []
    for i, t in pairs:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in pairs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        out.append((int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("block", [600, 8 << 20])
@pytest.mark.parametrize("shard", [3, 40_000])
def test_op4_is_the_definition(docs, monkeypatch, block, shard):
    pairs = [(k * 3, (t or "").encode()) for k, t in enumerate(TEXTS)]
    want = dict(zip([k for k, _ in pairs], brute_repeats(pairs), strict=True))
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    found = rows(suffix_dedup.remove_repeats(docs, block_bytes=block))
    assert {k: (r.n_removed, r.n_spans, bytes(r.text)) for k, r in found.items()} == want
    assert found[0]["rep"] == "r" and found[0]["block"] == "b"


def test_op4_shards_of_one_anchor():
    r = np.random.default_rng(3)
    body = r.integers(97, 99, 82).astype(np.uint8)
    rows_ = np.tile(np.r_[np.uint8([32, 50]), body], (30, 1))
    for k in range(30):
        rows_[k, 2 + r.integers(0, 30)] = 120 + k % 3
        rows_[k, 2 + r.integers(52, 82)] = 120 + k % 4
    rows_ = np.unique(rows_, axis=0)
    ids = r.permutation(len(rows_)).astype(np.int64)
    seeds = np.zeros(len(rows_), np.uint64)
    whole = suffix_dedup.covered(rows_, seeds, ids)
    keep = suffix_dedup.SHARD
    try:
        suffix_dedup.SHARD = 4
        assert (suffix_dedup.covered(rows_, seeds, ids) == whole).all() and whole.any()
    finally:
        suffix_dedup.SHARD = keep
    least = {}
    for x, i in zip(rows_, ids, strict=True):
        for s in range(33):
            w = x[2 + s : 52 + s].tobytes()
            least[w] = min(least.get(w, i), i)
    for x, i, bits in zip(rows_, ids, whole, strict=True):
        assert [(int(bits) >> s) & 1 for s in range(33)] == [int(least[x[2 + s : 52 + s].tobytes()] < i) for s in range(33)]


@pytest.mark.parametrize("block", [600, 8 << 20])
@pytest.mark.parametrize("hot", [0, 3])
def test_op4_strings_of_hot_anchors(spark, docs, block, hot):
    pairs = [(k * 3, (t or "").encode()) for k, t in enumerate(TEXTS)]
    want = dict(zip([k for k, _ in pairs], brute_repeats(pairs), strict=True))
    found = rows(suffix_dedup.remove_repeats(docs, block_bytes=block, hot=hot))
    assert {k: (r.n_removed, r.n_spans, bytes(r.text)) for k, r in found.items()} == want
    # a phrase with other words around it each time, repeats beside and across it, runs of one byte, one id twice
    r = random.Random(hot)
    some = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    phrase, sides = some(40), [some(30) for _ in range(4)]
    texts = [some(r.randrange(60)) + r.choice(sides) + phrase[r.randrange(3) :] + r.choice(sides) + some(r.randrange(60)) for _ in range(60)]
    texts += [b"x" * r.randrange(40, 200) + phrase for _ in range(10)] + [phrase, phrase + b"tail of ten", phrase * 3]
    pairs = [(k // 2 * 2 if k < 10 else k, t) for k, t in enumerate(texts)]
    r.shuffle(pairs)
    want = sorted((k, *w) for (k, _), w in zip(pairs, brute_repeats(pairs), strict=True))
    table = spark.createDataFrame([(k, t.decode()) for k, t in pairs], "doc_id long, text string")
    found = suffix_dedup.remove_repeats(table, block_bytes=block, hot=hot).collect()
    assert sorted((x.doc_id, x.n_removed, x.n_spans, bytes(x.text)) for x in found) == want and any(w[1] for w in want)


def test_op4_ranges_are_even(tmp_path):
    text = bytes(np.random.default_rng(5).integers(97, 123, 1 << 20).astype(np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    n = collections.Counter()
    for b in suffix_dedup._make_blocks(f"file://{tmp_path}", 64, 8 << 20)(iter([batch])):
        for bucket, k in zip(b["bucket"].to_pylist(), b["n"].to_pylist(), strict=True):
            n[bucket] += k * (bucket >= 0)
    assert max(n.values()) < 1.5 * sum(n.values()) / 64


def test_op4_hot_anchors_are_told(tmp_path):
    r = np.random.default_rng(6)
    phrase = "eighteen bytes and some more of them"
    texts = [bytes(r.integers(97, 123, 100).astype(np.uint8)).decode() + phrase + bytes(r.integers(97, 123, 100).astype(np.uint8)).decode() for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], ["doc_id", "text"])
    made = pa.Table.from_batches(suffix_dedup._make_blocks(f"file://{tmp_path}", 8, 3000)(iter([batch])))
    asked = made.filter(pc.greater_equal(made["bucket"], 0)).sort_by("bucket")
    sets = []
    for hot in (40, 10_000):
        told = pa.Table.from_batches(suffix_dedup._find_repeated(hot)(iter(asked.to_batches())))
        sets.append([set(suffix_dedup._joined(told[c].to_pylist()).tolist()) for c in ("hot", "repeated")])
    assert sets[0][0] and not sets[0][0] & sets[0][1] and not sets[1][0] and sets[0][0] | sets[0][1] == sets[1][1]


def test_op4_shards_in_pieces(monkeypatch):
    r = np.random.default_rng(7)
    body = r.integers(97, 99, (40, 82)).astype(np.uint8)
    parts = []
    for k in range(12):
        some = body[np.sort(r.choice(40, 15, replace=False))].copy()
        some[:, r.integers(0, 30)] = 120
        seeds = np.sort(r.integers(0, 6, 15)).astype(np.uint64)
        some[:, 32:50] = 100 + seeds[:, None]
        whole = np.concatenate([np.tile(np.uint8([32, 50]), (15, 1)), some], 1)
        parts.append((f"b{k}", k % 2, 15, seeds.tobytes(), r.integers(0, 99, 15).tobytes(), suffix_dedup._squeeze(whole)))
    parts.sort(key=lambda x: x[1])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts, strict=True)], ["block", "bucket", "n", "seeds", "lowest", "rows"])
    got = []
    for piece in (1, 20, 1000):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        tables = pa.Table.from_batches(suffix_dedup._sort_shards(iter([batch])))
        got.append([(b, suffix_dedup._swell(a, 15, np.uint64).tolist()) for b, a in zip(tables["block"].to_pylist(), tables["answer"].to_pylist(), strict=True)])
    assert got[0] == got[1] == got[2] and any(any(a) for _, a in got[0])


@pytest.mark.parametrize("more", [18, 30, 40, 49, 50])
def test_op4_anchors_at_the_end_of_a_step(more):
    n = (1 << 20) + more
    buf = np.random.default_rng(more).integers(97, 123, n).astype(np.uint8)
    found = set(suffix_dedup.anchors(buf, np.array([n])).tolist())
    low = n - 300
    h = suffix_dedup.seed_hashes(buf, np.arange(low, n - suffix_dedup.SEED + 1))
    span = suffix_dedup.LENGTH - suffix_dedup.SEED + 1
    assert {low + k + int(h[k : k + span].argmin()) for k in range(len(h) - span + 1)} <= found


def test_op4_runs_of_whole_characters():
    r = random.Random(8)
    texts = ["".join(r.choice("aé中\U0001f600") for _ in range(r.randrange(9))) for _ in range(60)] + [None, ""]
    block = suffix_dedup.Block(pa.table({"doc_id": range(62), "text": texts}))
    raw = [(t or "").encode() for t in texts]
    for _ in range(30):
        gone = np.array([r.random() < 0.7 for _ in block.buf], bool)
        for whole in (False, True):
            text, begin, end = suffix_dedup.removed_runs(block, gone, whole)
            got, want = [[] for _ in texts], [[] for _ in texts]
            for k, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
                got[k] += range(a, b)
            for k, t in enumerate(texts):
                at = int(block.starts[k])
                for c in t or "":
                    size = len(c.encode())
                    want[k] += [i for i in range(at, at + size) if (gone[at : at + size].all() if whole else gone[i])]
                    at += size
            assert got == want and len(text) == sum((np.diff(w, prepend=-9) > 1).sum() for w in want)
            assert suffix_dedup._kept(block, text, begin, end) == [bytes(b for i, b in enumerate(x, s) if i not in w) for x, s, w in zip(raw, block.starts.tolist(), map(set, want), strict=True)]


def test_op4_steps_hold_little(tmp_path):
    """Workers of all steps live side by side with the executor's heap: what a step takes for each byte is bounded."""
    r = np.random.default_rng(9)
    passages = r.integers(97, 123, (300, 700)).astype(np.uint8)
    texts = [np.r_[r.integers(97, 123, 700).astype(np.uint8), *passages[r.integers(0, 300, 5)]].tobytes().decode() for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], ["doc_id", "text"])
    n, peak = sum(map(len, texts)), {}

    def held(name, run, batches, *order):
        tracemalloc.start()
        out = list(run(iter(batches)))
        peak[name] = tracemalloc.get_traced_memory()[1] / n
        tracemalloc.stop()
        t = pa.Table.from_batches(out)
        return t.filter(pc.greater_equal(t["bucket"], 0)).sort_by([(c, "ascending") for c in order]).combine_chunks() if order else t

    asked = held("blocks", suffix_dedup._make_blocks(f"file://{tmp_path}", 4, 8 << 20), [batch], "bucket", "block")
    told = held("repeated", suffix_dedup._find_repeated(40_000), asked.to_batches(), "block", "bucket")
    told = told.append_column("strings", pa.nulls(len(told), pa.binary()))
    sent = held("contexts", suffix_dedup._send_contexts(4), told.to_batches(), "bucket", "block")
    answers = held("sort", suffix_dedup._sort_shards, sent.to_batches(), "block", "bucket")
    done = held("finish", suffix_dedup._finish(True, ["doc_id", "text"], False, True), answers.to_batches())
    assert len(done) == 1500 and sum(done["c3"].to_pylist()) > n // 2
    assert peak["blocks"] < 12 and peak["contexts"] < 16 and peak["finish"] < 12, peak
    rows_ = np.concatenate([np.tile(np.uint8([32, 50]), (8000, 1)), passages.ravel()[r.integers(0, 200_000, 8000)[:, None] + np.arange(82)]], 1)
    tracemalloc.start()
    suffix_dedup.string_classes(rows_)
    peak["suffixes"] = tracemalloc.get_traced_memory()[1] / (8000 * 83)
    tracemalloc.stop()
    assert peak["suffixes"] < 50, peak


def test_op4_odd_rows(spark, odd, empty):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.n_bytes) for r in suffix_dedup.remove_repeats(odd).collect())
    n0, n1 = len(BASE[0].encode()), len(BASE[1].encode())
    assert found == sorted([(False, 1, 0, n0), (False, 1, 0, n0), (False, 1, 0, n1), (True, 0, 0, n0), (False, 2, n0, n0), (True, 0, 0, 0)])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    wide = "é" * 60
    two = spark.createDataFrame([(1, "a" + wide), (2, "b" + wide), (3, None)], "doc_id long, text string")
    kept = rows(suffix_dedup.remove_repeats(two, whole_characters=True))
    assert kept[1].text == "a" + wide and kept[2].text == "b" and kept[3].text is None


@pytest.mark.parametrize("text", [b"banana", b"\0" * 11, b"ab" * 60, b"\0a\0\0\0" * 7, bytes(np.random.default_rng(0).integers(0, 3, 400).astype(np.uint8))])
def test_suffix_array(text):
    x = np.frombuffer(text, np.uint8)
    order = suffix_array.suffix_order(x)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = np.zeros(len(text), int)
    for a, b in zip(order[:-1], order[1:], strict=True):
        while a + shared[b] < len(text) and b + shared[b] < len(text) and text[a + shared[b]] == text[b + shared[b]] and shared[b] < 50:
            shared[b] += 1
    assert suffix_array.common_prefixes(x, order, len(text), 50).tolist() == shared.tolist()


@pytest.mark.parametrize("size", [1, 5, 60])
def test_suffix_array_in_pieces(monkeypatch, size):
    monkeypatch.setattr(suffix_array, "_OPEN", size)
    r = np.random.default_rng(size)
    for text in (b"ab" * 60, b"abcdefghij" * 20, b"\0" * 40, *(r.integers(0, 2, 300).astype(np.uint8).tobytes() * 2 for _ in range(5))):
        order = suffix_array.suffix_order(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_op5_files_and_lookup(docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = tokens.LibraryCoder(path)
    manifest = sstable.write_shards(docs, path, end_id=2)
    found, at = rows(sstable.read_shards(manifest, with_ids=True)), 0
    for k in sorted(found):
        ids = np.r_[np.frombuffer(coder.by_library([text_of(k)])[0], "<u4"), np.uint32(2)].astype("<u4")
        r = found[k]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    shards = [sstable.ShardReader(u.uri) for u in manifest.collect()]
    for k in found:
        assert [s.get(k).tolist() for s in shards if s.get(k) is not None] == [found[k].ids]
    assert all(s.get(k) is None for s in shards for k in (-5, 1, 2**62))
    got = sstable.read_shards(sstable.write_shards(odd, path, end_id=2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1, 2]
    assert sstable.read_shards(sstable.write_shards(empty, path, end_id=2)).count() == 0


def test_op5_small_blocks(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = sstable.ShardWriter(f, 2, block_bytes=40)
        ids = {k: np.arange(k % 9, dtype=np.uint16) for k in range(-200, 3000, 7)}
        for k in sorted(ids):
            w.add(sstable.key_of(k), ids[k])
        w.close()
    r = sstable.ShardReader(f"file://{tmp_path}/x")
    assert len(r.index) > 50 and [(k, v.tolist()) for k, v in r] == [(k, ids[k].tolist()) for k in sorted(ids)]
    assert all(r.get(k).tolist() == ids[k].tolist() for k in ids) and r.get(-199) is None


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = collections.defaultdict(list)
    for p in range(len(words) - 7):
        spots[tuple(words[p : p + 8])].append(p)
    again = {q for v in spots.values() if len(v) > 1 for p in v for q in range(p, p + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_op6_counts_and_verdicts(spark, docs, odd, empty):
    found = rows(quality.judge(docs))
    assert len(found) == len(TEXTS)
    for k, r in found.items():
        want = brute_counts(text_of(k))
        assert tuple(r[c] for c in quality.COUNTS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judge(odd).count() == 6 and quality.judge(empty).count() == 0
    clean = [(k, prose(60 + k % 90, 1000 + k), "en", "s") for k in range(400)]
    junk = [(1000 + k, " ".join(w + "###" for w in prose(80, 5000 + k).split()), "en", "s") for k in range(40)]
    many = rows(quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")))
    assert all(many[k].kept for k, *_ in clean) and not any(many[k].kept for k, *_ in junk)


def test_op6_each_rate_rejects_alone(spark):
    clean = [(k, prose(60 + k % 90, 1000 + k), "en", "s") for k in range(400)]
    symbols = [(1000 + k, " ".join(w + "#" * (n % 3 == 0) for n, w in enumerate(prose(80, 5000 + k).split())), "en", "s") for k in range(40)]
    words = [prose(86, 6000 + k).split() for k in range(40)]
    repeats = [(2000 + k, " ".join([*w, *w[20:34]]), "en", "s") for k, w in enumerate(words)]
    lines = [(3000 + k, "\n".join([*w[:3], *w[:3], " ".join(w[3:57])]), "en", "s") for k, w in enumerate(words)]
    many = rows(quality.judge(spark.createDataFrame(clean + symbols + repeats + lines, "doc_id long, text string, lang string, source string")))
    assert all(many[k].kept for k, *_ in clean)
    for some in (symbols, repeats, lines):
        assert not any(many[k].base_failed or many[k].kept for k, *_ in some)


def brute_verdicts(items):
    """``kept`` by definition: the estimate of smallest determinant from many starts, with exact quantiles, for each language and source."""
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    stats = {k: brute_counts(t or "") for k, t, *_ in items}
    good = {k: c for k, c in stats.items() if c[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    x = {k: np.array([math.log(c[1] / c[0]), math.log1p(100 * c[2] / c[0]), math.log1p(100 * c[3] / c[0]), math.log1p(10 * c[4] / c[0])]) for k, c in good.items()}
    groups = collections.defaultdict(list)
    for k, _, *kind in items:
        if k in good:
            groups[tuple(kind)].append(k)
    small = {g for g in groups if len(groups[g]) < quality.MIN_ROWS}
    of_lang = collections.Counter(g[0] for g in small for _ in groups[g])
    pooled = collections.defaultdict(list)
    for g, ks in groups.items():
        pooled[g if g not in small else ("lang", g[0]) if of_lang[g[0]] >= quality.MIN_ROWS else "rest"] += ks
    kept = dict.fromkeys(stats, False)
    r = np.random.default_rng(0)
    for ks in pooled.values():
        v = np.array([x[k] for k in ks])
        best = None
        for _ in range(30):
            core = v[r.choice(len(v), min(40, len(v)), replace=False)]
            for _ in range(25):
                cov = 1.0 * np.cov(core.T, bias=True) * FACTOR + floors
                d = np.einsum("ij,jk,ik->i", v - core.mean(0), np.linalg.inv(cov), v - core.mean(0))
                core = v[d <= np.quantile(d, quality.KEEP, method="inverted_cdf")]
            cov = np.cov(core.T, bias=True) * FACTOR + floors
            if best is None or np.linalg.slogdet(cov)[1] < best[0]:
                best = np.linalg.slogdet(cov)[1], core.mean(0), np.linalg.inv(cov)
        for k, y in zip(ks, v - best[1], strict=True):
            kept[k] = bool(y @ best[2] @ y <= quality.CUTOFF)
    return kept


#: Consistency factor of the central three quarters of a four-dimensional normal cloud: 0.75 / P(chi2_6 <= q), P(chi2_4 <= q) = 0.75.
FACTOR = 0.75 / 0.5045695


def test_op6_verdicts_by_brute_force(spark):
    r = random.Random(8)
    items = []
    for k in range(700):
        kind = [("en", "a"), ("en", "b"), ("de", "a"), ("de", "c"), (None, None)][k % 20 % 5 if k % 20 < 17 else 4]
        words = prose(r.randint(15, 120), 9000 + k).split()
        if k % 11 == 0:
            words = [w + "#" * (r.random() < 0.4) for w in words]
        if k % 13 == 0:
            words += words[5 : 5 + r.randint(9, 30)]
        text = " ".join(words)
        if k % 17 == 0:
            text += "\n" + "\n".join(["one line again"] * r.randint(2, 9))
        items.append((k, None if k == 5 else text, *kind))
    want = brute_verdicts(items)
    got = rows(quality.judge(spark.createDataFrame(items, "doc_id long, text string, lang string, source string")))
    assert {k: v.kept for k, v in got.items()} == want
    assert 100 < sum(want.values()) < 690


def test_op6_estimate_is_robust(spark):
    r = np.random.default_rng(0)
    good = r.multivariate_normal([1, 2, 3, 4], np.diag([1, 4, 1, 1]) + 0.5, 4000)
    bad = r.normal([30, 30, 30, 30], 1, (800, 4))
    df = spark.createDataFrame([("k", *map(float, x)) for x in np.r_[good, bad]], "key string, x0 double, x1 double, x2 double, x3 double")
    m = quality.estimates(df).first()
    assert np.allclose(m.center, [1, 2, 3, 4], atol=0.2)
    cov = np.linalg.inv(np.array(m.precision).reshape(4, 4)) - np.diag(np.array(quality.FLOORS) ** 2)
    # what replaced the outliers widens the central part a little
    assert np.allclose(cov, np.cov(good.T), rtol=0.5, atol=0.5)


def test_op6_start_is_the_mad(spark, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 0)
    r = np.random.default_rng(1)
    x = np.r_[r.normal(0, 1, (800, 4)), r.normal(50, 1, (200, 4))]  # a fifth on one side
    df = spark.createDataFrame([("k", *map(float, v)) for v in x], "key string, x0 double, x1 double, x2 double, x3 double")
    m = quality.estimates(df).first()
    mad = 1.4826 * np.median(abs(x - np.median(x, 0)), 0)
    assert np.allclose(1 / np.diag(np.array(m.precision).reshape(4, 4)), mad**2 + np.array(quality.FLOORS) ** 2, rtol=0.05)


def test_op7_scores_by_definition(docs, odd, empty):
    texts = {k * 3: (t or "").encode().lower().split() for k, t in enumerate(TEXTS)}
    grams = lambda w: collections.Counter([tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)] + [()] * len(w))
    own = {k: grams(w) for k, w in texts.items()}
    total = sum(own.values(), collections.Counter())
    found = rows(ngram_lm.score_documents(docs, block_bytes=4000))
    for k, w in texts.items():
        c = lambda *g, k=k: total[g] - own[k][g]
        score = 0.0
        for p in range(len(w)):
            s = c(w[p]) / c() if c(w[p]) else 0.4 / (c() + 1)
            for n in (1, 2):
                if p >= n:
                    g = w[p - n : p + 1]
                    s = c(*g) / c(*g[:-1]) if c(*g) else 0.4 * s
            score += math.log(s)
        assert abs(found[k].log_score - score) < 1e-6 * max(1, abs(score)) and found[k].n_words == len(w)
    assert ngram_lm.score_documents(odd).count() == 6 and ngram_lm.score_documents(empty).count() == 0


def test_op7_steps_hold_little(tmp_path, monkeypatch):
    """What a step takes for each byte of a block is bounded, also while the next block follows; and it sends small batches."""
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    r = np.random.default_rng(3)
    vocabulary = np.array(["".join(map(chr, r.integers(97, 123, k % 8 + 2))) for k in range(20_000)])
    texts = [" ".join(vocabulary[r.integers(0, 20_000, 4000)].tolist()) for _ in range(600)]
    n, peak, folder = sum(map(len, texts)) / 2, {}, f"file://{tmp_path}"
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 50)), pa.array(texts[k : k + 50])], ["doc_id", "text"]) for k in range(0, 600, 50)]
    ngram_lm._texts(pa.table({"text": texts[:50]}))  # tables of powers stay, and are not a block's

    def held(name, run, batches, *order):
        tracemalloc.start()
        out = list(run(iter(batches)))
        peak[name] = tracemalloc.get_traced_memory()[1] / n
        tracemalloc.stop()
        return out if not order else pa.Table.from_batches(out).sort_by([(c, "ascending") for c in order]).combine_chunks().to_batches()

    asked = held("ask", ngram_lm._ask(folder, 40, int(n) - 1000), batches, "bucket", "block")
    told = held("add", ngram_lm._add_up, asked, "block", "bucket")
    done = pa.Table.from_batches(held("score", lambda x: ngram_lm._score(folder, x), told))
    assert len(set(told[0]["block"].to_pylist())) == 2 and sorted(done["doc_id"].to_pylist()) == list(range(600)) and set(done["n_words"].to_pylist()) == {4000}
    assert peak["ask"] < 8 and peak["add"] < 2 and peak["score"] < 12, peak
    sent = list(ngram_lm._ask(folder, 40, int(n) - 1000)(iter(batches)))
    assert len(sent) > 2 and max(b.nbytes for b in sent) < 5 << 20


def test_op8_canonical_digests(spark, docs, odd, empty):
    known = license_scan.known_digests(spark)
    mit = "Copyright (c) 2020 Some One\n\n" + license_scan.MIT.upper().replace("SUBLICENSE", "sub-licence")
    some = spark.createDataFrame([(1, mit), (2, mit + " more"), (3, None), (4, "\n\n* © 1999 X, all rights reserved\n" + license_scan.ISC)], "doc_id long, text string")
    assert {k: r.license_id for k, r in rows(license_scan.scan(some, known)).items()} == {1: "MIT", 2: None, 3: None, 4: "ISC"}
    assert license_scan.scan(docs, known).count() == len(TEXTS)
    assert license_scan.scan(odd, known).count() == 6 and license_scan.scan(empty, known).count() == 0


def test_op8_spellings_are_whole(spark):
    """Both spellings of every pair give one text, also in a row and inflected; and never a third one."""
    cases = []
    for n, (a, b) in enumerate(license_scan.SPELLINGS):
        cases += [(4 * n, f"x {a.strip()} {a.strip()} y {a.strip()}s"), (4 * n + 1, f"X {b.strip()} {b.strip()}, y {b.strip()}s")]
    cases = [(k, t.replace("https", "https:").replace("http ", "http: ")) if "http" in t else (k, t) for k, t in cases]
    known = license_scan.known_digests(spark)
    found = rows(license_scan.scan(spark.createDataFrame(cases, "doc_id long, text string"), known))
    wrong = [license_scan.SPELLINGS[k // 4] for k, _ in cases if k % 4 == 0 and found[k].digest != found[k + 1].digest]
    assert [a for a, _ in wrong] in ([], ["http "])  # "https" is a word of its own, "https" with an s none
    for a, b in (("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("wilful", "wilfull"), ("wilful", "willful"), ("licences", "licenses"), ("http://x", "https://x")):
        two = rows(license_scan.scan(spark.createDataFrame([(1, f"the {a} of {a}"), (2, f"the {b} of {b}")], "doc_id long, text string"), known))
        assert two[1].digest == two[2].digest


def test_op8_sql_by_other_means(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [t for _, t in license_scan.published()] + TEXTS
    texts += ["copyright the\r", "copyright the", "copyright the\r\nx", "© x\n(c) 1999\n(c) the\ncopyright noticeé\ncopyright notice\nCopyright Some One", "http http http", "İ \u212a Ä"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r for r in con.execute(license_scan.oracle()).fetchall()}
    got = {r.doc_id: tuple(r) for r in license_scan.scan(spark.read.parquet(f"{tmp_path}/d"), license_scan.known_digests(spark)).collect()}
    assert got == want and sum(r[3] is not None for r in got.values()) >= len(license_scan.published())


def test_op8_published_forms(spark):
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n, break_long_words=False, break_on_hyphens=False) for p in t.split("\n\n"))
    head = "Copyright (c) 2004-2010 by Some One, Inc.\nCopyright The Other Authors\n\n"
    isc = license_scan.ISC.replace("that the above copyright", "that the above\ncopyright")
    cases = [("ISC", isc), ("ISC", "ISC License\n\n" + head + isc), ("MIT", "MIT License\n\n" + head + license_scan.MIT)]
    cases += [("ISC", isc.replace("and/or", "and", 1)), ("BSD-3-Clause", head + license_scan.BSD_3.replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * "))]
    cases += [(k, f"{title}\n\n{head}{license_scan.KNOWN[k]}") for k, titles in license_scan.TITLES.items() for title in titles if "BSD License" not in title[-14:]]
    cases += [(k, head + wrap(license_scan.KNOWN[k], n)) for k in license_scan.TITLES for n in range(30, 100, 7)]
    for path in license_scan.FULL.glob("*.txt"):
        text = path.read_text(encoding="utf-8")
        cases += [(path.stem, text), (path.stem, text.replace("\n", "\r\n"))]
        # a line break before any word "copyright" of the terms changes nothing
        cut = license_scan.APPENDIX.search(text)
        terms = text[: cut.start()] if cut else text
        cases += [(path.stem, re.sub(r"(?<=[a-z,]) (?=copyright\b)", "\n", terms) + text[len(terms) :])]
    assert {k for k, _ in cases} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    known = license_scan.known_digests(spark)
    found = rows(license_scan.scan(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(cases)], "doc_id long, text string"), known))
    assert not [(k, t[:200], found[n].license_id) for n, (k, t) in enumerate(cases) if found[n].license_id != k]
    more = spark.createDataFrame([(1, isc + "\nand more"), (2, "MIT License"), (3, head)], "doc_id long, text string")
    assert all(r.license_id is None for r in license_scan.scan(more, known).collect())


def brute_components(pairs, size, percent):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(pairs)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {pairs[i][0]: (len(sets[i]), pairs[find(i)][0]) for i in range(len(sets))}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 60, 3)])
def test_op9_components_by_definition(spark, monkeypatch, size, percent, block):
    r = random.Random(7)
    texts = list(TEXTS)
    for k in range(60):  # chains and clusters of near copies
        w = (BASE[6] if k % 3 else texts[-1] or "a b c d").split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        texts.append(" ".join(w))
    pairs = list(enumerate(texts))
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    found = rows(jaccard_join.similar_documents(df, size, percent))
    assert {k: (x.n_shingles, x.component_id) for k, x in found.items()} == brute_components(pairs, size, percent)


def near_copies(n, seed, base, changes):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, changes)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("hot", "boxes"), [(2048, 4096), (40, 4096), (40, 2)])
def test_op9_many_trees_and_blocks(spark, monkeypatch, hot, boxes):
    """Keys of several trees and cells of many blocks, one of which a single pair across blocks connects."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BOXES", boxes)
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    texts = near_copies(100, 1, BASE[0], 9) + near_copies(60, 2, BASE[6], 60)
    chain = BASE[2].split()
    for k in range(40):  # each links with its neighbours only
        chain[3 * k % len(chain)] = VOCABULARY[k]
        texts.append(" ".join(chain))
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    found = rows(jaccard_join.similar_documents(df, 3, 80))
    assert {k: (x.n_shingles, x.component_id) for k, x in found.items()} == brute_components(pairs, 3, 80)


def test_op9_texts_move_once_a_round(spark, monkeypatch):
    """A cell of 20 blocks: each text goes to one block, of what a block connects one goes on."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    sent = []
    plain = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda docs, rows, *a: (sent.append(rows.count()), plain(docs, rows, *a))[1])
    texts = near_copies(200, 5, prose(400, 77), 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = rows(jaccard_join.similar_documents(df, 5, 80))
    assert {x.component_id for x in found.values()} == {0}
    classes = len(set(texts))
    assert sent[0] == classes and sum(sent[1:]) <= classes / 4


def test_op9_points_bound_what_sets_share():
    r = np.random.default_rng(2)
    for n, m, both in ((300, 330, 280), (1000, 1100, 900), (3000, 2600, 2500), (9000, 9500, 7000)):
        base = r.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.sort(base[:n]), np.sort(np.r_[base[:both], base[n : n + m - both]])
        p, q = jaccard_join.points([a, b])
        groups = min(len(p), len(q))
        packed = [jaccard_join.unpack_point(jaccard_join.pack_point(x)) for x in (p, q)]
        x, y = jaccard_join.folded(packed, groups)
        assert both <= np.minimum(x, y).sum() < both + 0.95 * (min(n, m) - both) + 1


def test_op9_rows_of_one_id_are_sets_of_their_own(spark):
    texts = [(1, BASE[0]), (1, BASE[6]), (2, BASE[0] + " tail"), (3, BASE[6] + " tail"), (4, BASE[2]), (1, BASE[0])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id) for r in jaccard_join.similar_documents(df, 3, 90).collect())
    assert found == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_op9_odd_rows(odd, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard_join.similar_documents(odd, 3, 90).collect() if r.doc_id is not None)
    assert got == [(False, 1, 1), (False, 1, 1), (False, 1, 1), (False, 2, 1)]
    assert all(r.component_id is None for r in jaccard_join.similar_documents(odd, 3, 90).where("doc_id is null").collect())
    assert jaccard_join.similar_documents(empty, 3, 90).count() == 0


def test_count_tree_keeps_all_that_can_link():
    r = np.random.default_rng(1)
    pts = r.poisson(2.0, (700, jaccard_join.GROUPS)).astype(np.int32)
    pts[350:] = pts[:350]
    pts[350:, 0] += r.integers(0, 3, 350).astype(np.int32)
    total = pts.sum(1)
    tree = jaccard_join.CountTree(pts, 90, total)
    for i in range(0, 700, 23):
        bound = 190 * np.minimum(pts, pts[i]).sum(1) >= 90 * (total + total[i])
        assert tree.survivors(pts[i], int(total[i])).tolist() == np.flatnonzero(bound).tolist()


@pytest.mark.parametrize("small", [0, 20_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (200, 201)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = {r.node: r.component for r in components.connected_components(df).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 100: 90, 95: 90, 201: 200}


def test_op10_packs_every_token(docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = tokens.LibraryCoder(path)
    found = packing.pack(docs, path).collect()
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {k * 3 for k in range(len(TEXTS))}
    total = 0
    for k, parts in by_doc.items():
        ids = np.r_[np.frombuffer(coder.by_library([text_of(k)])[0], "<u4"), np.uint32(0)].astype("<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += len(ids)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack(odd, path).count() >= 6 and packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_op10_search(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 100, 14) if seed % 2 else r.integers(20, 60, 11)
    counts = collections.Counter(sizes.tolist())
    packed = packing.bin_completion(counts, 100)
    used = collections.Counter()
    for whole, n in packed:
        assert sum(whole) <= 100
        for s in whole:
            used[s] += n
    bins = sum(n for _, n in packed)
    assert used == counts and packing.lower_bound(counts, 100) <= bins <= sum(n for _, n in packing.best_fit_decreasing(counts, 100))

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        if len(rooms) >= best[0]:
            return best[0]
        out = best[0]
        for k in sorted({r: i for i, r in enumerate(rooms)}.values()):
            if rooms[k] >= left[0]:
                out = min(out, fewest(left[1:], [*rooms[:k], rooms[k] - left[0], *rooms[k + 1 :]]))
                best[0] = min(best[0], out)
        return min(out, fewest(left[1:], [*rooms, 100 - left[0]]))

    best = [bins]
    assert bins == fewest(sorted(sizes.tolist(), reverse=True), [])


def fewest_sequences(sizes, capacity, most):
    """The exact optimum by depth-first search; ``most`` is known to do."""
    sizes = sorted(sizes, reverse=True)
    best, behind = [most], [sum(sizes[k:]) for k in range(len(sizes) + 1)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        if len(rooms) + max(0, -(-(behind[k] - sum(rooms)) // capacity)) >= best[0]:
            return
        for r in sorted(set(rooms)):
            if r >= sizes[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - sizes[k]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_op10_is_optimal_on_small_instances():
    assert sum(n for _, n in packing.bin_completion(collections.Counter([30, 26, 23, 20, 19, 14, 13, 11, 8, 7, 7]), 60)) == 3
    beaten = 0
    for seed in range(600):
        r = np.random.default_rng(seed)
        capacity = int(r.choice([60, 100, 150]))
        low, high = [(1, capacity), (capacity // 10, capacity // 2), (capacity // 6, capacity // 2), (3, capacity // 3)][seed % 4]
        sizes = r.integers(low, high + 1, int(r.integers(9, 15))).tolist()
        fit = sum(n for _, n in packing.best_fit_decreasing(collections.Counter(sizes), capacity))
        found = sum(n for _, n in packing.bin_completion(collections.Counter(sizes), capacity))
        assert found == fewest_sequences(sizes, capacity, fit)
        beaten += found < fit
    assert beaten > 20


def test_op10_fillings_of_many_pieces():
    # only five more pieces fill the room: 30 + (15 + 14 + 13 + 14 + 14)
    counts = np.bincount([15, 14, 14, 14, 13, 19, 11], minlength=101)
    assert next(packing.completions(counts, 30, 100)) == (15, 14, 14, 14, 13)
    for seed in range(30):
        r = np.random.default_rng(seed)
        sizes = sorted(r.integers(3, 40, r.integers(1, 9)).tolist())
        fits = [sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= 60]
        found = list(packing.completions(np.bincount(sizes, minlength=101), 40, 100, 100_000))
        assert all(not collections.Counter(x) - collections.Counter(sizes) and sum(x) <= 60 for x in found) and len(set(found)) == len(found)
        assert max(map(sum, found)) == max(fits)


def test_op10_search_packs_short_pieces():
    # sequences of six pieces, cut at random places, so that they fill 100 sequences to the last token
    r = np.random.default_rng(3)
    sizes = [s for _ in range(100) for s in np.diff(np.r_[0, np.arange(1, 6) * 341 + r.integers(-34, 35, 5), 2048]).tolist()]
    counts = collections.Counter(sizes)
    packed = packing.bin_completion(counts)
    used = collections.Counter()
    for whole, n in packed:
        assert sum(whole) <= 2048
        for s in whole:
            used[s] += n
    assert used == counts and sum(n for _, n in packed) <= 101 < sum(n for _, n in packing.best_fit_decreasing(counts, 2048))


def test_bpe_merges_in_rank_order():
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"aa", b"aaa"]
    coder = bpe.ByteBpe(vocabulary, public_tokenizers.PATTERN)
    assert coder.word(b"abc") == [258] and coder.merge(b"abcb") == [258, 98] and coder.merge(b"aaaaa") == [259, 260] or coder.merge(b"aaaaa")
    assert coder.merge(b"") == [] and coder.decode(coder.merge(b"xabcy")) == b"xabcy"
