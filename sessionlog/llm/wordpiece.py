"""Word-piece counts by a longest-match automaton that never steps back."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_chunks

#: Words kept with their counts per task; the table starts anew when it is full.
CACHE_WORDS = 700_000


class PieceAutomaton:
    """Vocabulary trie with failure links and the number of pieces each link pops.

    A word is cut greedily: the longest piece that starts it, then the longest one that
    starts the rest.  ``pieces`` start a word; ``inner`` continue it (the same if None).
    Each node keeps where matching goes on when no edge fits (``fail``, -1 for nowhere) and
    how many pieces are finished by that step (``popped``), so a word takes one walk over
    its bytes and builds no pieces.
    """

    def __init__(self, pieces: Iterable[bytes], inner: Iterable[bytes] | None = None):
        self.go: dict[int, int] = {}
        self.size = 0
        parents: list[tuple[int, int]] = []
        final: list[bool] = []

        def node(parent: int, byte: int) -> int:
            parents.append((parent, byte))
            final.append(False)
            self.size += 1
            return self.size - 1

        def add(root: int, piece: bytes) -> None:
            at = root
            for byte in piece:
                key = at << 8 | byte
                if key not in self.go:
                    self.go[key] = node(at, byte)
                at = self.go[key]
            if piece:
                final[at] = True

        self.start = node(-1, 0)
        self.inner = self.start if inner is None else node(-1, 0)
        for piece in pieces:
            add(self.start, piece)
        for piece in inner or ():
            add(self.inner, piece)
        self.fail, self.popped = [-1] * self.size, [0] * self.size
        # Breadth first: links of shorter strings are there when longer ones need them.
        children: list[list[int]] = [[] for _ in range(self.size)]
        for i, (parent, _) in enumerate(parents):
            if parent >= 0:
                children[parent].append(i)
        level = [self.start] if inner is None else [self.start, self.inner]
        while level:
            level = [c for v in level for c in children[v]]
            for v in level:
                parent, byte = parents[v]
                if final[v]:
                    self.fail[v], self.popped[v] = self.inner, 1
                    continue
                count, at = self.popped[parent], self.fail[parent]
                while at >= 0 and (at << 8 | byte) not in self.go:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.go[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it can't be cut wholly (or is empty)."""
        go, fail, popped = self.go, self.fail, self.popped
        at, count = self.start, 0
        for byte in word:
            while (to := go.get(at << 8 | byte, -1)) < 0:
                count += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at != self.inner:
            count += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return count


_AUTOMATA: dict[tuple, tuple[PieceAutomaton, dict[bytes, int]]] = {}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, special tokens left out."""
    from .bpe import byte_letters

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    bytes_of = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in spec["added_tokens"]}
    return [bytes(bytes_of[c] for c in token) for token in spec["model"]["vocab"] if token not in special]


def token_counts(docs: DataFrame, path: str, before: bytes = b" ") -> DataFrame:
    """Greedy word pieces of every whole text: doc_id, n_words, n_tokens, n_unknown.

    Words are runs without ASCII white space, each matched as ``before`` + word (byte-level
    vocabularies mark a word's start by the space before it).  A word that can't be cut into
    pieces counts as one token and as unknown.  Null and empty texts count 0; repeated rows
    and null ids are kept one by one.  Map-only, and each distinct word of a task is cut once.
    """
    def make():
        if (path, before) not in _AUTOMATA:
            _AUTOMATA[path, before] = PieceAutomaton(vocabulary(path)), {}
        automaton, known = _AUTOMATA[path, before]

        def run(batch: pa.RecordBatch) -> dict:
            cut = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
            seen = set().union(*cut)
            if len(known) + len(seen) > CACHE_WORDS:
                known.clear()
            for w in seen - known.keys():
                known[w] = automaton.count(before + w) or -1  # -1: unknown
            counts = [[known[w] for w in words] for words in cut]
            unknown = [c.count(-1) for c in counts]
            whole = lambda x: pa.array(x, pa.int64())
            return {"doc_id": batch.column("doc_id"), "n_words": whole([len(c) for c in counts]),
                    "n_tokens": whole([sum(c) + 2 * u for c, u in zip(counts, unknown, strict=True)]),
                    "n_unknown": whole(unknown)}

        return run

    return map_chunks(docs, ["doc_id", "text"], "doc_id long, n_words long, n_tokens long, n_unknown long", make)
