"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is exactly one token with which its encoding can end. A suffix automaton
(Aho-Corasick over the vocabulary) gives the tokens that end at each place; a token is the last one of a prefix if its
neighbour, the last token of what stands before it, is compatible with it: no merge across their border would have come
before the merges that build them. Back-pointers then give the ids. Time is linear in the text, whatever its content.

Pieces are white space with what stands behind it up to the next one; as pieces and the words in them repeat, their ids are
kept in tables of bounded size.

Nulls and edge cases: null and empty texts have no tokens; strings of special tokens in a text become their ids; decoding
replaces invalid UTF-8 as a lossy decoder does.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, keep_first, text_batches, two_columns

# Unicode white space, and the pattern that cuts a text before the merges.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
KEPT_PIECES = 400_000
KEPT_PAIRS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    rest = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.names = {i: bytes(symbols[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        ids = {b: i for i, b in self.names.items()}
        vocab = spec["model"]["vocab"]
        self.merge = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.words = regex.compile(PATTERN)
        self._build(ids)
        self.known, self.kept_words, self.pairs = {}, {}, {}

    def _build(self, ids: dict[bytes, int]) -> None:
        """How each token is formed (rank, left, right), and the automaton of those that their own bytes encode to."""
        self.formed = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in ids.items():
            parts, last = [ids[name[j:j + 1]] for j in range(len(name))], (-1, None, None)
            while len(parts) > 1:
                options = [(self.merge[p][0], j) for j, p in enumerate(zip(parts, parts[1:])) if p in self.merge]
                if not options:
                    break
                rank, j = min(options)
                last = (rank, parts[j], parts[j + 1])
                parts[j:j + 2] = [self.merge[parts[j], parts[j + 1]][1]]
            self.formed[i] = last
            if parts == [i]:
                self.automaton.add_word(name.decode("latin-1"), (len(name), i))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stays as it is: going back in time at their border, no merge across it would have come first."""
        formed, merge = self.formed, self.merge
        # ``over``: ranks from here on come too late to join the two neighbours
        over = float("inf")
        while True:
            across = merge.get((a, b))
            if across is not None and across[0] < over:
                return False
            left, right = formed[a], formed[b]
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                over, a = left[0], left[2]  # of equal ranks the left merge comes first
            else:
                over, b = right[0] + 1, right[1]

    def encode_word(self, word: bytes) -> list[int]:
        last, pairs = [None] * (len(word) + 1), self.pairs
        for end, (length, token) in self.automaton.iter(word.decode("latin-1")):
            start = end + 1 - length
            if start == 0:
                last[end + 1] = token
            elif last[end + 1] is None and (before := last[start]) is not None:
                key = (before, token)
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(before, token)
                if fits:
                    last[end + 1] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(self.names[last[at]])
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        out, kept = [], self.kept_words
        for word in self.words.findall(piece):
            ids = kept.get(word)
            if ids is None:
                ids = np.array(self.encode_word(word.encode()), "<u4").tobytes()
                if len(word) < 64:
                    keep_first(kept, KEPT_PIECES)
                    kept[word] = ids
            out.append(ids)
        found = b"".join(out)
        if len(piece) < 64:
            keep_first(self.known, KEPT_PIECES)
            self.known[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += [known.get(p) or self._piece(p) for p in self.pieces.findall(part)]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.names.__getitem__, np.asarray(ids).tolist())).decode("utf-8", errors="replace")


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One encoder per vocabulary and worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of token ids) of every whole text. ``vocabulary`` is a path that every executor can read."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = load(vocabulary)
        for keys, texts in text_batches(batches, "text"):
            for i in range(0, len(keys), 256):
                yield batch_of(schema, keys[i:i + 256], [bpe.encode(t).astype(np.int32) for t in texts[i:i + 256]])

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of every id sequence."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            yield batch_of(schema, b.column("doc_id").to_pylist(), [bpe.decode(x or []) for x in b.column("ids").to_pylist()])

    return tokens.selectExpr(f"CAST(`{key}` AS bigint) AS doc_id", f"CAST(`{ids}` AS array<int>) AS ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digest(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text, in one pass without keeping ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = load(vocabulary)
        for keys, texts in text_batches(batches, "text"):
            out = []
            for k, t in zip(keys, texts):
                ids = bpe.encode(t)
                out.append((k, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            if out:
                yield batch_of(schema, *zip(*out))

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
