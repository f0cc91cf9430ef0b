"""Byte-level BPE by a lazily determinised finite-state transducer.

A sequence of tokens is what the merges yield just when every token is what they make of its own bytes and
every two neighbours are what they make of the two together. That is a non-deterministic transducer over
bytes whose states are (last token, bytes of the next token so far). It is determinised on demand: a state is a
set of hypotheses with the tokens each has not emitted yet; what all of them agree on is emitted, so tokens
leave after a bounded lookahead. States and transitions are remembered within bounds, and so are the ids of
whole pieces.

A text is first split by the pattern, each piece by itself; a piece that is a token whole is that token.

Decoding is a stream: ids become bytes, and a UTF-8 state machine holds back an unfinished character until its
last byte has come.

Defined results: a null or empty text has no ids (the digests are those of nothing); repeated rows are encoded
alike; very long texts go through in segments that end where a piece ends; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textloom.sources.io import read_table

CACHE_PIECES = 600_000
#: Longer pieces are encoded each time: the cache is bounded in bytes too.
CACHE_CHARS = 64
CACHE_STATES = 400_000
_SEGMENT = 1 << 20
#: Where characters are all of these, re finds the same pieces as the Unicode pattern does, and faster.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\\Z")
_PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The plain procedure: again and again the leftmost pair of the lowest rank becomes one part, down to ``until`` parts."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: A hypothesis: tokens not emitted yet, the last token, the bytes after it.
Hypothesis = tuple[tuple[bytes, ...], bytes, bytes]


class Transducer:
    """Bytes in, tokens out; one object holds the determinised part that was needed so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start: tuple[Hypothesis, ...] = (((), b"", b""),)
        self.states: list[tuple[Hypothesis, ...]] = [start]
        self.index = {start: 0}
        self.steps: list[dict[int, tuple[int, tuple[bytes, ...]]]] = [{}]

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last merge that makes a token; (itself, nothing) for a byte; None where the merges never make it."""
        if token not in self._halves:
            if len(token) == 1:
                self._halves[token] = (token, b"")
            else:
                parts = merge(token, self.ranks, 2)
                self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _is_own(self, token: bytes) -> bool:
        return self._split(token) is not None

    def _follows(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave the border between two tokens alone.

        The merges that made the two are undone at the border, the latest first; the border would have been
        merged over if the parts that meet there at some time make a token of a lower rank than whatever is
        merged next on either side (or the same rank on the right, since the leftmost goes first).
        """
        if not left:
            return True
        found = self._pairs.get((left, right))
        if found is not None:
            return found
        if len(self._pairs) > 4 * CACHE_STATES:
            self._pairs.clear()
        ranks, a, b, limit = self.ranks, left, right, float("inf")
        found = True
        while True:
            joined = ranks.get(a + b)
            if joined is not None and joined < limit:
                found = False
                break
            # undo the later of the two merges; a byte can't be undone
            rank_a = ranks[a] if len(a) > 1 else -1.0
            rank_b = ranks[b] + 0.5 if len(b) > 1 else -1.0
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                limit, a = rank_a, self._split(a)[1]
            else:
                limit, b = rank_b, self._split(b)[0]
        self._pairs[left, right] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[bytes, ...]]:
        after: list[Hypothesis] = []
        add, prefixes, ranks, pairs = bytes((byte,)), self.prefixes, self.ranks, self._pairs
        agree = True
        for out, last, pending in self.states[state]:
            grown = pending + add
            if grown in prefixes:
                after.append((out, last, grown))
                agree = agree and bool(out)
            if grown in ranks:
                fits = pairs.get((last, grown))
                if fits is None:
                    fits = self._is_own(grown) and self._follows(last, grown)
                if fits:
                    after.append(((*out, grown), grown, b""))
        if not after:
            raise ValueError("the vocabulary lacks a byte")
        common: tuple[bytes, ...] = ()
        if agree:
            common = after[0][0]
            for out, _, _ in after[1:]:
                n = 0
                while n < min(len(common), len(out)) and common[n] == out[n]:
                    n += 1
                common = common[:n]
            if common:
                n = len(common)
                after = [(out[n:], last, pending) for out, last, pending in after]
        if len(after) > 1:
            after.sort()
        key = tuple(after)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = found = (to, common)
        return found

    def run(self, piece: bytes) -> list[bytes]:
        if len(self.states) > CACHE_STATES:
            self._reset()
        state, tokens, steps = 0, [], self.steps
        for byte in piece:
            found = steps[state].get(byte) or self._step(state, byte)
            state = found[0]
            if found[1]:
                tokens += found[1]
            if state > CACHE_STATES * 2:  # one endless piece: keep its hypotheses, drop the others
                key = self.states[state]
                self._reset()
                steps = self.steps
                state = self.index.setdefault(key, 1)
                if state == 1:
                    self.states.append(key)
                    steps.append({})
        ends = [out for out, _, pending in self.states[state] if not pending]
        if len(ends) != 1:
            raise ValueError("the merges don't determine one result")
        return tokens + list(ends[0])


class Utf8Machine:
    """Incremental UTF-8: the state is the unfinished character at the end of what came."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _unfinished(raw: bytes) -> int:
        """How many bytes at the end begin a character without finishing it."""
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            return back if need > back else 0
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.pending + raw
        keep = self._unfinished(raw)
        self.pending = raw[len(raw) - keep :] if keep else b""
        return raw[: len(raw) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # the library's white space is Unicode's property, Python's isn't
        self.pattern = regex.compile(pattern.replace("[^\\s", "[^\\p{White_Space}").replace("\\S", "\\P{White_Space}").replace("\\s", "\\p{White_Space}"))
        self.transducer = Transducer(ranks)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.transducer.run(raw)]
        return np.array(ids, "<u4").tobytes()

    def segments(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + _SEGMENT) if len(text) - at > _SEGMENT else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, segment by segment."""
        known = self.known
        for part in self.segments(text):
            pieces = _PLAIN_PIECE.findall(part) if _PLAIN.match(part) else self.pattern.findall(part)
            new = set(pieces).difference(known)
            if new:
                if len(known) + len(new) > CACHE_PIECES:  # the first ones are the frequent ones
                    known = self.known = dict(islice(known.items(), CACHE_PIECES // 2))
                    new = set(pieces).difference(known)
                long_ones = {p: self._piece(p) for p in new if len(p) > CACHE_CHARS}
                for piece in new.difference(long_ones):
                    known[piece] = self._piece(piece)
                if long_ones:
                    yield b"".join([long_ones[p] if p in long_ones else known[p] for p in pieces])
                    continue
            yield b"".join(map(known.__getitem__, pieces))

    def decode(self, chunks: Iterable[bytes]) -> Iterator[bytes]:
        """The bytes of a stream of ids, as they come."""
        for chunk in chunks:
            ids = np.frombuffer(chunk, "<u4")
            for at in range(0, len(ids), 1 << 18):
                yield b"".join(map(self.table.__getitem__, ids[at : at + (1 << 18)].tolist()))

    def decode_text(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """The text of a stream of ids; no part ends within a character."""
        machine = Utf8Machine()
        for raw in self.decode(chunks):
            yield machine.feed(raw)
        yield machine.close()


@lru_cache(4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                ids, back, count, good = hashlib.sha256(), hashlib.sha256(), 0, True
                machine = Utf8Machine()
                for chunk in bpe.encode(text.as_py() or ""):
                    ids.update(chunk)
                    count += len(chunk) // 4
                    for raw in bpe.decode([chunk]):
                        back.update(machine.feed(raw).encode())
                rest = machine.close()
                good = not rest
                back.update(rest.encode())
                rows.append((count, ids.hexdigest(), back.hexdigest(), good))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole_characters"])

    return run


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids and that of what they decode to."""
    return docs.select("doc_id", "text").mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, whole_characters boolean")


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            lists = [np.frombuffer(b"".join(bpe.encode(t.as_py() or "")), "<u4").astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of whole texts."""
    return docs.select("doc_id", "text").mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode_text([np.array(ids.as_py() or [], "<u4").tobytes()])) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(read_table(spark, f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
SQL: dict[str, str] = {}
