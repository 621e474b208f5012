"""SentencePiece encoding and decoding as a weighted finite-state transduction.

The model file is compiled once into transducers:
- the normaliser: the model's character map (leftmost longest rule, as its double array has it), then a sequential
  transducer that escapes spaces, collapses them if the model asks for it, and adds the dummy prefix;
- the pieces: a trie whose arcs read characters and whose leaves write an id at a cost;
- byte fallback: a character that no piece covers writes the ids of its bytes (or the unknown id) at a high cost;
- for BPE models the pairs: a state for the id written last, an arc's cost is 0 if merging the two pieces' characters
  by rank gives back that very pair, and infinite otherwise.
Their composition with an input is made lazily: its states are (position, last id), and the tropical shortest path
through them is the encoding, for unigram models (cost: negative log probability) and BPE models (the one path of finite cost, which is
the one that merging gives) alike.

The shortest path of a text is that of its segments one after the other, for no piece crosses a segment's edge and the
normaliser's state is carried over; a bounded memo keeps segments met before. A segment costs its length, runs of
spaces included.

Defined results: null and empty texts have no ids and decode to the empty string; the symbol U+2581 in a text decodes
to a space, as the format has it; without byte fallback adjoining unknown characters write the unknown id once; very
long texts are read whole; equal costs are settled alike on every run; a null id stays null; repeated rows each give
a row; no rows give no rows; other columns are ignored. Refused with ValueError: models with user-defined pieces,
without space escaping, with the space symbol as a suffix, or of another kind than unigram and BPE."""

from __future__ import annotations

import functools
import hashlib
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import per_batch
from vigilspark.llm.wfst import Sequential, shortest_path

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SEGMENTS, PAIRS = 500_000, 500_000  # bounds of the memos, entries


def _wire(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """A model's precompiled rules, source bytes to target text, read from their double array as the input needs them."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.targets = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """End and target of the longest rule whose source stands at a place."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = units[node] if node < len(units) else 1 << 31
            if unit & (1 << 31 | 0xFF) != raw[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k + 1, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.targets[found[1] : self.targets.index(b"\0", found[1])].decode()

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def run(self, text: str) -> str:
        """What the only path of a text through the rules writes; characters without a rule are copied."""
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            if rule := self.longest(raw, at):
                at, target = rule
                out.append(target)
            else:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out.append(raw[at : at + size].decode())
                at += size
        return "".join(out)


START, INSIDE, GAP = 0, 1, 2


def spaces(prefix: bool, collapse: bool) -> Sequential:
    """The normaliser's last part. START: nothing written yet; GAP: a space is owed."""
    first = SPACE if prefix else ""
    if collapse:
        return Sequential(START, {(START, " "): ("", START), (INSIDE, " "): ("", GAP), (GAP, " "): ("", GAP)}, {START: (first, INSIDE), INSIDE: ("", INSIDE), GAP: (SPACE, INSIDE)})
    return Sequential(START, {(START, " "): (first + SPACE, INSIDE), (INSIDE, " "): (SPACE, INSIDE)}, {START: (first, INSIDE), INSIDE: ("", INSIDE)}, {INSIDE: {ord(" "): SPACE}})


class Pieces:
    """A compiled model: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, model: bytes) -> None:
        self.names: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind, prefix, strip, escape, suffix, charsmap, fallback = UNIGRAM, True, True, True, False, b"", False
        for field, value in _wire(model):
            if field == 1:
                d = dict(_wire(value))
                self.names.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kinds.append(d.get(3, NORMAL))
            elif field == 2:
                d = dict(_wire(value))
                kind, suffix, fallback = d.get(3, UNIGRAM), bool(d.get(24, 0)), bool(d.get(35, 0))
            elif field == 3:
                d = dict(_wire(value))
                charsmap, prefix, strip, escape = d.get(2, b""), bool(d.get(3, 1)), bool(d.get(4, 1)), bool(d.get(5, 1))
        if not escape or suffix or kind not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and BPE models with escaped spaces and without user-defined pieces are compiled")
        self.bpe, self.prefix, self.collapse = kind == BPE, prefix, strip
        self.map = CharacterMap(charsmap) if charsmap else None
        self.spaces = spaces(prefix, strip)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_of = {int(n[3:5], 16): k for k, n in enumerate(self.names) if self.kinds[k] == BYTE} if fallback else {}
        self.ids = {n: k for k, n in enumerate(self.names) if self.kinds[k] == NORMAL}
        # A constant on every score leaves BPE's ranks alone; unigram costs are negative log probabilities, 0 at least.
        # They are added in single precision, as the format's scores are.
        self.costs = [0.0 if self.bpe else np.float32(max(0.0, -x)) for x in self.scores]
        self.unknown_cost = 0.0 if self.bpe else np.float32(-min((self.scores[k] for k in self.ids.values()), default=0.0) + 10.0)
        # The piece transducer: a state is a dict, its arcs read a character; "" holds the id written at that state.
        self.trie: dict = {}
        for name, k in self.ids.items():
            state = self.trie
            for c in name:
                state = state.setdefault(c, {})
            state[""] = k
        inner = {c for n in self.ids for c in n}
        self.segments = self._cuts("".join(c for c in "\n\t\r" if c not in inner))
        self.memo: dict[str, bytes] = {}  # of segments within a text, where the normaliser's state stays the same
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _cuts(self, hard: str) -> re.Pattern:
        """Segments whose edges no piece crosses, as the vocabulary has it: characters outside it, spaces before
        something, and changes between letters and other characters."""
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            return re.compile("(?s).+")
        gap = f"[ {SPACE}]"
        free = rf"(?:(?![ {SPACE}{hard}])%s)+"
        bodies = [n.lstrip(SPACE) for n in self.ids]
        if all(re.fullmatch(r"[^\W\d_]*|[\W\d_]*", n) for n in bodies):
            return re.compile(rf"{gap}*[^\W\d_]+|{gap}*{free % r'[\W\d_]'}|{gap}+" + (f"|[{hard}]" if hard else ""))
        # A word ends before a mark that no piece has after a letter.
        crossed = {b for n in bodies for a, b in zip(n, n[1:]) if re.fullmatch(r"[^\W\d_]", a)}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in crossed)
        word = rf"{gap}*[^\W\d_]+(?=[{marks}])|" if marks else ""
        return re.compile(rf"{word}{gap}*{free % r'(?s:.)'}|{gap}+" + (f"|[{hard}]" if hard else ""))

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by rank makes of text: best score first, leftmost of equals first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stable(self, k: int) -> bool:
        """Whether merging a piece's characters gives the piece."""
        if k not in self.whole:
            self.whole[k] = self.merged(self.names[k]) == [self.names[k]]
        return self.whole[k]

    def _follows(self, a: int, b: int) -> bool:
        """Whether the pair of pieces costs nothing."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def arcs(self, text: str, at: int, last: int) -> Iterator[tuple[int, int, float, int]]:
        """Arcs of finite cost of the composed machine at a position after the id last (-1: none), the longest piece
        first: end, state after it, cost, what is written."""
        found, state, n, j = [], self.trie, len(text), at
        while j < n and (state := state.get(text[j])) is not None:
            j += 1
            if (k := state.get("")) is not None:
                found.append((j, k))
        if not self.bpe:
            for j, k in reversed(found):
                yield j, -1, self.costs[k], k
        else:
            pairs = self.pairs
            for j, k in reversed(found):
                good = self._stable(k) if last < 0 else pairs.get(last << 32 | k)
                if self._follows(last, k) if good is None else good:
                    yield j, k, 0.0, k
        if text[at] not in self.ids:  # nothing merges across it
            yield at + 1, -1, self.unknown_cost, -1 - ord(text[at])

    def path(self, text: str) -> list[int]:
        """What the shortest path of a normalised segment writes."""
        found = shortest_path(text, -1, self.arcs)
        return found if min(found) >= 0 else [i for k in found for i in ((k,) if k >= 0 else self.fallback(chr(-1 - k)))]

    def fallback(self, char: str) -> list[int]:
        if self.bytes_of:
            return [self.bytes_of[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _segment(self, state: int, raw: str) -> tuple[bytes, int]:
        text, after = self.spaces.run(state, raw)
        return (array("I", self.path(text)).tobytes() if text else b""), after

    def _segments(self, found: list[str]) -> bytes:
        """Ids of segments within a text, each from the state INSIDE back to it."""
        if len(self.memo) >= SEGMENTS:  # two generations: what is in use moves on
            self.memo, self.older = {}, self.memo
        known, long = self.memo, {}
        for s in set(found).difference(known):
            ids = self.older.get(s)
            (known if len(s) < 64 else long)[s] = self._segment(INSIDE, s)[0] if ids is None else ids
        return b"".join([long[s] if s in long else known[s] for s in found] if long else map(known.__getitem__, found))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.map:
            text = self.map.run(text)
        if not self.collapse:
            found = self.segments.findall(text)
            raw = self._segment(START, found[0])[0] + self._segments(found[1:]) if found else b""
        else:
            # A segment may end in a gap, but none does whose last character is no space.
            out, state = [], START
            for s in self.segments.findall(text.rstrip(" " + SPACE)):
                if state == INSIDE and s[-1] != " ":
                    out.append(self._segments([s]))
                else:
                    ids, state = self._segment(state, s)
                    out.append(ids)
            raw = b"".join(out)
        if self.bytes_of or not raw:
            return raw
        ids = np.frombuffer(raw, dtype="<u4")
        return ids[np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)))].tobytes()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    @functools.cached_property
    def _written(self) -> list[bytes]:
        """What each id writes, as bytes."""
        out = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            out.append(bytes([int(name[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else name.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        written, head, at = self._written, b"", 0
        # The dummy prefix goes; if the model collapses spaces, every piece before the first text loses a space.
        while at < len(ids) and not head and (self.prefix or self.collapse):
            piece = written[ids[at]]
            at += 1
            head = piece[1:] if piece[:1] == b" " and self.kinds[ids[at - 1]] == NORMAL else piece
            if piece[:1] == b" " and not self.collapse:
                break
        return (head + b"".join(map(written.__getitem__, ids[at:]))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def compiled(model_path: str) -> Pieces:
    """One model for each worker process, with its memos."""
    with open(model_path, "rb") as f:
        return Pieces(f.read())


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, lossless of every whole text."""

    def start() -> object:
        model = compiled(model_path)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n_ids": [], "ids_crc32": [], "decoded_sha256": [], "lossless": []}
            for text in batch.column("text").to_pylist():
                raw = model.encode_bytes(text)
                back = model.decode(np.frombuffer(raw, dtype="<u4").tolist())
                for column, value in zip(out.values(), (len(raw) // 4, zlib.crc32(raw), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (text or "")), strict=True):
                    column.append(value)
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean", start)
