"""Operator 3: greedy word-piece lengths without the pieces.

The vocabulary is a trie over bytes with a mark for the end of a word.  For
every trie node that is not followed by the next byte, a failure link says at
which node matching goes on, and a count says how many pieces the longest-match
rule has cut off by then.  A word is read once from left to right, in time
linear in its bytes; the sum of the popped counts is its number of pieces.

The automaton runs over all new words of a batch at once, one byte of each per
round; words of over ``LONG`` bytes, whose rounds would have few words, are
walked one by one.  Counts of words of up to ``KEPT`` bytes are kept in a table
of bounded size; longer ones are counted anew in each batch.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm._shared import id_text, prepare, worker_cache
from pairloom.llm.tokens import MEMO_ENTRIES, byte_symbols

END = 256  # the mark after the last byte of a word
#: Bytes of a word that is walked on its own, and of the longest word whose count is kept.
LONG, KEPT = 256, 64


class LongestMatch:
    """Trie with failure links and popped counts for a set of pieces.

    Pieces are sequences of symbols below 257; every single symbol that can
    occur must be a piece or lie in one that begins a word's rest, so that
    matching never gets stuck (a word that cannot be cut is one unknown piece).
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        is_piece, parent, symbol = [False], [-1], [-1]
        for piece in pieces:
            v = 0
            for c in piece:
                w = children[v].get(c)
                if w is None:
                    w = len(children)
                    children[v][c] = w
                    children.append({})
                    is_piece.append(False)
                    parent.append(v)
                    symbol.append(c)
                v = w
            is_piece[v] = True
        n = len(children)
        # a node fails to the place where its pending bytes stand after the longest pieces are cut off
        fail, pops = [-1] * n, [0] * n
        depth_order = [0]
        for v in depth_order:
            depth_order.extend(children[v].values())
        for v in depth_order[1:]:
            if is_piece[v]:
                fail[v], pops[v] = 0, int(parent[v] > 0 or symbol[v] != END)
                continue
            u, c = parent[v], symbol[v]
            z, count = fail[u], pops[u]
            while z >= 0 and c not in children[z]:
                z, count = fail[z], count + pops[z]
            if z >= 0:
                fail[v], pops[v] = children[z][c], count
        self.fail, self.pops = np.array(fail), np.array(pops)
        edges = [(v * 512 + c, w) for v in range(n) for c, w in children[v].items()]
        self.edges, self.target = (np.array(x, np.int64) for x in zip(*sorted(edges), strict=True))
        self._walk: tuple | None = None  # the same as Python's own tables, made with the first long word

    def walk(self, word: bytes) -> int:
        """Pieces of one word followed by the end mark."""
        if self._walk is None:
            self._walk = dict(zip(self.edges.tolist(), self.target.tolist(), strict=True)).get, self.fail.tolist(), self.pops.tolist()
        find, fail, pops = self._walk
        node = total = 0
        for c in (*word, END):
            while (to := find(node * 512 + c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 0:
            total += pops[node]
            node = fail[node]
        return 1 if node < 0 else total

    def _next(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        q = node * 512 + symbol
        at = np.minimum(np.searchsorted(self.edges, q), len(self.edges) - 1)
        return np.where(self.edges[at] == q, self.target[at], -1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word followed by the end mark."""
        out = np.empty(len(words), np.int64)
        long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
        out[~long] = self._rounds([w for w in words if len(w) <= LONG])
        out[long] = [self.walk(w) for w in words if len(w) > LONG]
        return out

    def _rounds(self, words: list[bytes]) -> np.ndarray:
        """``count``, one byte of every word in each round."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        total = np.zeros(len(words), np.int64)
        node = np.zeros(len(words), np.int64)
        live = np.argsort(-size, kind="stable")
        for t in range(int(size.max(initial=0)) + 1):
            live = live[: np.searchsorted(-size[live], -t, "right")]  # words with a byte or the mark at t
            at = np.minimum(start[live] + t, len(flat) - 1) if len(flat) else start[live]
            c = np.where(size[live] > t, flat[at] if len(flat) else END, END)
            todo = np.arange(len(live))
            while len(todo):
                w = live[todo]
                ok = node[w] >= 0
                to = np.where(ok, self._next(np.maximum(node[w], 0), c[todo]), -1)
                hit = to >= 0
                node[w[hit]] = to[hit]
                miss = todo[~hit & ok]
                w = live[miss]
                total[w] += self.pops[node[w]]
                node[w] = self.fail[node[w]]
                todo = miss
        while True:  # the rest behind the mark
            rest = np.flatnonzero(node > 0)
            if not len(rest):
                break
            total[rest] += self.pops[node[rest]]
            node[rest] = self.fail[node[rest]]
        return np.where(node < 0, 1, total)


def pieces_of(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends, as symbols."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    end = spec["model"]["end_of_word_suffix"]
    special = {t["content"] for t in spec["added_tokens"]}
    byte = {c: k for k, c in enumerate(byte_symbols())}
    out = []
    for token in spec["model"]["vocab"]:
        if token in special:
            continue
        closed = token.endswith(end) and len(token) > len(end)
        body = token[: -len(end)] if closed else token
        out.append(tuple(byte[c] for c in body) + ((END,) if closed else ()))
    # where the longest match leaves the mark alone, it costs nothing
    return [*out, (END,)]


class Counts:
    def __init__(self, path: str):
        self.automaton = LongestMatch(pieces_of(path))
        self.memo: dict[bytes, int] = {}

    def of(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and pieces of each text, lower-cased in ASCII and cut at ASCII white space."""
        words = [Counter(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts]
        fresh = list(set().union(*words) - self.memo.keys())
        if len(self.memo) + len(fresh) > MEMO_ENTRIES:
            self.memo.clear()
            fresh = list(set().union(*words))
        now = dict(zip(fresh, self.automaton.count(fresh).tolist(), strict=True))
        counts = [sum((now[x] if x in now else self.memo[x]) * n for x, n in w.items()) for w in words]
        self.memo.update((x, n) for x, n in now.items() if len(x) <= KEPT)
        return [w.total() for w in words], counts


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row, by greedy longest match.

    Null and empty texts have no words and no tokens; rows that repeat stay; an
    empty table gives no rows; other columns are not read; a word of any length
    is counted whole, in time in proportion to it.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("token counts")
        if path not in held:
            held[path] = Counts(path)
        for b in batches:
            words, pieces = held[path].of(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
