"""Byte-pair encoding and decoding on contiguous rank arrays."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_chunks

#: The pattern that cuts text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Unicode White_Space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Units of texts in which some white space is not one inner space or line feed: a run without white space and a space before it, or white space.
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Words kept with their ids per Python worker; the table starts anew when it is full.
CACHE_WORDS = 1_200_000

#: Pieces longer than this many bytes are merged with a heap, one by one.
SHORT = 48

_NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankArrays:
    """Merges of a byte-level BPE vocabulary, applied to many short words at a time.

    All words of about one length form a matrix: a row holds the ids of a word's parts and
    the rank of each part with its right neighbour.  Every step finds the smallest rank of
    each row (the leftmost one of equals), deletes that boundary by moving the rest of the
    row up, and looks up the two neighbouring ranks again.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = max([*vocab.values(), *self.specials.values()]) + 1
        self.pieces = [b""] * self.width
        for token, i in vocab.items():
            self.pieces[i] = bytes(bytes_of[c] for c in token)
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocab[a] * self.width + vocab[b], (rank, vocab[a + b]))
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.by_rank = np.zeros(len(spec["model"]["merges"]) + 1, np.int32)
        self.by_rank[self.ranks] = self.merged

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE).astype(np.int32)

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max())
        cols = np.arange(wide)
        ids = np.full((len(words), wide), -1, np.int32)
        ids[cols < sizes[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        done: list[np.ndarray] = [None] * len(words)
        rows = np.arange(len(words))
        ranks = np.full(ids.shape, _NONE, np.int32)
        if wide > 1:
            ranks[:, :-1] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, wide - 1)
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            over = least == _NONE
            if over.any():
                for r, row, n in zip(rows[over].tolist(), ids[over], sizes[over].tolist(), strict=True):
                    done[r] = row[:n].copy()
                left = ~over
                rows, ids, ranks, sizes, at, least = (x[left] for x in (rows, ids, ranks, sizes, at, least))
            if not len(rows):
                return done
            n = np.arange(len(rows))
            take = np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[:, -1], ranks[:, -1] = -1, _NONE
            ids[n, at] = self.by_rank[least]
            sizes = sizes - 1
            right = ids[n, np.minimum(at + 1, ids.shape[1] - 1)]
            right[at + 1 >= ids.shape[1]] = -1
            ranks[n, at] = self._rank(ids[n, at], right)
            left = at > 0
            ranks[n[left], at[left] - 1] = self._rank(ids[n[left], at[left] - 1], ids[n[left], at[left]])
            wide = int(sizes.max())
            if wide < ids.shape[1]:
                ids, ranks, cols = ids[:, :wide], ranks[:, :wide], cols[:wide]

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, the smallest rank from a heap."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        get = self.pairs.get
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(len(ids) - 1)
                if (p := get(ids[i] * self.width + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := get(ids[x] * self.width + ids[y])):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y], p[1]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each distinct word."""
        words = sorted({w for w in words if w}, key=len)
        out, at = {b"": np.zeros(0, np.int32)}, 0
        while at < len(words):
            if len(words[at]) > SHORT:
                out[words[at]] = self._long(words[at])
                at += 1
                continue
            to = at
            limit = max(4, len(words[at]) + 2)
            while to < len(words) and len(words[to]) <= min(limit, SHORT) and to - at < 50_000:
                to += 1
            out.update(zip(words[at:to], self._matrix(words[at:to]), strict=True))
            at = to
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ``ids``, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


class CachedEncoder:
    """Whole texts to ids, each distinct word once; ``words`` gives the ids of each of a list as bytes.

    A word is what stands between two spaces or line feeds, with the one before it; the
    pattern never matches across its bounds.  Texts with other white space are cut by a
    slower pattern with the same meaning, those with special tokens around these.
    """

    def __init__(self, words, specials: dict[str, int]):
        self.words, self.specials = words, specials
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") \
            if specials else None
        self.cache: dict[str, bytes] = {}
        self.top = 0  # the largest id, where it is known

    @staticmethod
    def _units(text: str) -> list[str]:
        return ("\n" + text.replace("\n", " \n")).split(" ")

    @staticmethod
    def _odd(unit: str) -> bool:
        """Whether a unit shows that its text has other white space than single inner spaces and line feeds."""
        return unit.split() != [unit[1:] if unit[:1] == "\n" else unit]

    def _fill(self, missing: list[str], units: set[str]) -> None:
        if not missing:
            return
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = list(units)
        plain = [u[1:] if u[0] == "\t" else u if u[0] == "\n" else " " + u for u in missing]
        self.cache.update(zip(missing, self.words(plain), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty give none."""
        cut, plain = [], []
        for text in texts:
            if not text:
                parts = []
            elif self.special and any(s in text for s in self.specials):
                parts = [self.specials[p] if i % 2 else p for i, p in enumerate(self.special.split(text)) if p]
            else:
                parts = [text]
            plain.append(parts)
            cut.append([p if isinstance(p, int) else self._units(p) for p in parts])
        units = set().union(*(p for parts in cut for p in parts if isinstance(p, list)))
        missing = units.difference(self.cache)
        odd = {u for u in missing if self._odd(u)}
        if odd:
            # Such units are never kept, so every text that has one is found here.
            for parts, raw in zip(cut, plain, strict=True):
                for i, p in enumerate(parts):
                    if isinstance(p, list) and not odd.isdisjoint(p):
                        # A mark that no fast unit starts with: units of one text are not mixed with others.
                        parts[i] = ["\t" + u for u in _UNITS.findall(raw[i])]
            units = set().union(*(p for parts in cut for p in parts if isinstance(p, list)))
            missing = units.difference(self.cache)
        self._fill(list(missing), units)
        get, out = self.cache.__getitem__, []
        for parts in cut:
            done = []
            for p in parts:
                if isinstance(p, int):
                    done.append(p.to_bytes(4, "little"))
                else:
                    joined = b"".join(map(get, p))
                    done.append(joined if p[0][0] == "\t" else joined[4:])  # less the line feed put before
            out.append(done[0] if len(done) == 1 else b"".join(done))
        return out


_ENCODERS: dict[tuple, object] = {}


def rank_array_encoder(path: str) -> tuple[CachedEncoder, RankArrays]:
    """Encoder on our own rank arrays; kept for the life of the Python worker."""
    if ("own", path) not in _ENCODERS:
        import regex

        pattern, arrays = regex.compile(PATTERN), RankArrays(path)

        def words(units: list[str]) -> list[bytes]:
            cut = [[p.encode() for p in pattern.findall(u)] for u in units]
            ids = {w: x.tobytes() for w, x in arrays.encode_words(p for pieces in cut for p in pieces).items()}
            return [b"".join([ids[p] for p in pieces]) for pieces in cut]

        _ENCODERS["own", path] = CachedEncoder(words, arrays.specials), arrays
    return _ENCODERS["own", path]


def library_encoder(path: str) -> CachedEncoder:
    """Encoder on the ``tokenizers`` library; kept for the life of the Python worker."""
    if ("library", path) not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

        def words(units: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

        _ENCODERS["library", path] = CachedEncoder(words, specials)
        _ENCODERS["library", path].top = max([*tokenizer.get_vocab().values()])
    return _ENCODERS["library", path]


def encode(docs: DataFrame, path: str, carry: list[str] = ()) -> DataFrame:
    """Every whole text as ids: doc_id, the columns ``carry``, n_tokens, ids (array of int).

    Null and empty texts have no ids.  Rows with equal ids, null ids or repeated texts are
    kept one by one; other columns are not looked at.
    """
    kept = ["doc_id", *carry]

    def make():
        encoder, _ = rank_array_encoder(path)

        def run(batch: pa.RecordBatch) -> dict:
            ids = encoder.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            return {**{c: batch.column(c) for c in kept}, "n_tokens": np.diff(ends),
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

        return run

    schema = docs.select(*kept).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return map_chunks(docs, [*kept, "text"], schema, make)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ids counted and hashed, and the hash of the text decoded from them.

    Columns doc_id, n_tokens, ids_sha256, decoded_sha256.  One pass over the texts, no
    shuffle; rules for nulls and repeats as in :func:`encode`.
    """
    def make():
        encoder, arrays = rank_array_encoder(path)

        def run(batch: pa.RecordBatch) -> dict:
            ids = encoder.encode(batch.column("text").to_pylist())
            texts = (arrays.decode(np.frombuffer(x, "<u4")).encode() for x in ids)
            return {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in texts],
            }

        return run

    return map_chunks(docs, ["doc_id", "text"],
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
