"""Offset-preserving subword encoding with a SentencePiece BPE model, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows, and every normalised
character remembers the bytes of the original that it came from. The normalised text is merged into pieces, and
each is projected back to the bytes of the original text it covers.

No piece of such a model holds a space mark behind another character, so merges never cross the start of a run
of space marks; a line end that stands in no longer piece is a border as well. Between borders the pieces depend
on the segment alone: segments are merged by the library, with its own normalisation switched off, and
remembered in a memory of bounded size, with the characters that each piece covers. Counts and digests of a text are made
from the pieces and bytes that :func:`encode` returns.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

MARK = "▁"
REMEMBERED = 100_000  # segments that a worker remembers as used lately, and as many used before
AT_ONCE, BYTES = 200, 500_000  # texts whose segments are merged together, and their bytes, unless a text has more
#: A normaliser specification without map, prefix, trimming and escaping. Put after a model it overrides the model's own.
AS_IS = bytes([3 << 3 | 2, 8, 2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie of prefixes and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start:self.texts.index(b"\0", start)]
        return found


class Encoder:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        options = {2: b"", 3: 1, 4: 1, 5: 1}
        kind = 1
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                options |= dict(_fields(value))
        if kind != 2 or any(t == USER for *_, t in self.pieces):
            raise ValueError("only BPE models without user-defined symbols are supported")
        self.map = CharacterMap(options[2])
        self.dummy_prefix, self.trim, self.escape = (bool(options[i]) for i in (3, 4, 5))
        self.id_of = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, UNUSED)}
        self.unknown = next(i for i, (*_, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        if any(t == UNUSED for *_, t in self.pieces) or any(MARK in p.lstrip(MARK) for p in self.id_of):
            self.segments = re.compile(r".+", re.S)
        else:
            inside = {c for p in self.id_of if len(p) > 1 for c in p}
            border = "\n" if "\n" not in inside else ""
            self.segments = re.compile(f"{MARK}+[^{MARK}{border}]*|[^{MARK}{border}]+" + (f"|{border}" if border else ""))
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=model + AS_IS)
        self.kinds = np.array([kind for *_, kind in self.pieces], np.int8)
        self.names = [" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else piece for piece, _, kind in self.pieces]
        self.numbers = [str(i) for i in range(len(self.pieces))]
        self.sizes = [len(piece) for piece, *_ in self.pieces]
        self.special = frozenset([*self.byte_ids.values(), self.unknown])
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # --- normalisation ------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and for each of its characters (and the end) the first byte it came from.

        Without a character map and trimming the alignment is the plain one, given as None.
        """
        if not text:
            return "", [0]
        space = MARK if self.escape else " "
        if not self.map.units and not self.trim:
            return (space if self.dummy_prefix else "") + text.replace(" ", space), None
        data = text.encode("utf-8", "surrogatepass")
        out: list[str] = []
        origin: list[int] = []
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            if known:
                size, put = known[0], known[1].decode()
            else:
                size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                put = data[at:at + size].decode("utf-8", "surrogatepass")
            for c in put:
                if not (self.trim and c == " " and (not out or out[-1] == " ")):
                    out.append(c)
                    origin.append(at)
            at += size
        end = len(data)
        while self.trim and out and out[-1] == " ":
            out.pop()
            end = origin.pop()
        if not out:
            return "", [0]
        if self.dummy_prefix:
            out.insert(0, " ")
            origin.insert(0, origin[0])
        return "".join(space if c == " " else c for c in out), [*origin, end]

    # --- pieces ---------------------------------------------------------------------------------

    def remember(self, segments: Iterable[str]) -> list[bytes]:
        """Ids, first and last characters of the pieces of each of some different segments, merged if they aren't known."""
        missing = [s for s in segments if s not in self.memory]
        if len(self.memory) + len(missing) > REMEMBERED:
            # What is used on is taken over from the older memory, so common segments stay.
            self.older, self.memory = self.memory, {}
            missing = list(segments)
        new = []
        for s in missing:
            if s in self.older:
                self.memory[s] = self.older[s]
            else:
                new.append(s)
        for s, ids in zip(new, self.merger.encode(new, num_threads=1)):
            begins, ends = self._characters(s, ids)
            self.memory[s] = array("i", [*ids, *begins, *ends]).tobytes()
        return [self.memory[s] for s in segments]

    def _characters(self, segment: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First and last (exclusive) character of a segment that each piece covers; byte pieces all cover their character."""
        if self.special.isdisjoint(ids):
            ends = list(accumulate(self.sizes[i] for i in ids))
            return [0, *ends[:-1]], ends
        begins: list[int] = []
        ends = []
        at = left = size = 0  # left: byte pieces that the character before ``at`` still has
        for i in ids:
            kind = self.pieces[i][2]
            if left:
                left -= 1
            elif kind == BYTE:
                at, size = at + 1, 1
                left = len(segment[at - 1].encode()) - 1
            else:
                size = self._unknown_run(segment, at) if kind == UNKNOWN else self.sizes[i]
                at += size
            begins.append(at - size)
            ends.append(at)
        return begins, ends

    def _decoded(self, ids: list[int]) -> str:
        """Pieces put together, with space marks; runs of byte pieces are read as UTF-8."""
        out = [self.names[i] for i in ids]
        at = np.flatnonzero(self.kinds[ids] == BYTE).tolist() if ids else []
        for k, i in enumerate(at):
            if k and at[k - 1] == i - 1:
                continue
            end = i
            while end < len(ids) and self.pieces[ids[end]][2] == BYTE:
                end += 1
            text = _utf8(bytes(int(piece[3:5], 16) for piece in out[i:end]))
            out[i:end] = [text, *[""] * (end - i - 1)]
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the model's own decoder gives it."""
        if not ids:
            return ""
        text = self._decoded(ids)
        if self.dummy_prefix and self.pieces[ids[0]][2] != BYTE and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")

    def spans(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts, one text after the other, with the first and the last byte (exclusive) of the original that each
        piece covers, behind the places where the texts begin and end.

        The byte pieces of one character all cover that character.
        """
        texts = [t or "" for t in texts]
        normal, origins = zip(*map(self.normalise, texts)) if texts else ((), ())
        cuts = [self.segments.findall(n) for n in normal]
        number = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(cuts)))}
        known = self.remember(number)
        data = np.frombuffer(b"".join(known), np.int32)
        each = np.fromiter(map(len, known), np.int64, len(known)) // 12
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(cuts)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])

        # Where the pieces of every segment lie in what is remembered, and its first character in the texts put together.
        n, size = each[code], sizes[code]
        place = np.arange(n.sum()) + np.repeat(3 * (np.cumsum(each) - each)[code] - (np.cumsum(n) - n), n)
        origin, starts = self._origins(texts, origins)
        lengths = np.fromiter(map(len, normal), np.int64, len(normal))
        first = np.repeat(np.cumsum(size) - size - (np.cumsum(lengths) - lengths)[owner] + starts[owner], n)
        step = np.repeat(n, n)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=n, minlength=len(texts)))]).astype(np.int32)
        return offsets, data[place], origin[first + data[place + step]], origin[first + data[place + 2 * step]]

    def _origins(self, texts: list[str], origins: tuple[list[int] | None, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The first byte of every normalised character and the end, one text after the other, and where each text begins."""
        if any(o is not None and t for o, t in zip(origins, texts)):
            sizes = np.array([len(o) for o in origins])
            return np.concatenate([np.array(o, np.int32) for o in origins]), np.cumsum(sizes) - sizes
        # As the texts are: the prefix and the end take a place, but no byte.
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1 + self.dummy_prefix
        points = np.frombuffer("".join([f"{' ' * self.dummy_prefix}{t} " for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        each = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        each[starts + sizes - 1] = 0
        if self.dummy_prefix:
            each[starts] = 0
        before = np.cumsum(each) - each
        return (before - np.repeat(before[starts], sizes)).astype(np.int32), starts

    def _unknown_run(self, normal: str, at: int) -> int:
        """Characters that one unknown piece stands for: the library merges neighbours that no piece knows."""
        end = at + 1
        while end < len(normal) and normal[end] not in self.id_of:
            end += 1
        return end - at

    def digest(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[int, str, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, of the decoded text, and of the covered bytes of the pieces."""
        listed = ids.tolist()
        joined, decoded = ",".join([self.numbers[i] for i in listed]), self.decode(listed)
        spans = np.column_stack([begins, ends]).astype("<i4").tobytes()
        return len(listed), *[hashlib.sha256(x).hexdigest() for x in (joined.encode(), decoded.encode("utf-8", "replace"), spans)]


def _utf8(data: bytes) -> str:
    """Byte pieces as text; a byte that doesn't start a valid character gives one replacement mark."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at:at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as f:
        return Encoder(f.read())


def _shared_model(df: DataFrame, path: str) -> str:
    """Send the model file, whose size is fixed, to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def token_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row; a null text counts as empty and has no ids."""
    return encode(docs, model_path, key, text, digests=True).drop("spans_sha256")


def _digest_kind(key: str, kind: str) -> str:
    return f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def _digested(encoder: Encoder, keys: pa.Array, lists: list[pa.ListArray], key: str) -> pa.RecordBatch:
    flat = [x.flatten().to_numpy() for x in lists]
    cuts = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    found = [encoder.digest(*[x[low:high] for x in flat]) for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    n, *digests = zip(*found) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), *[pa.array(d, pa.string()) for d in digests]], [key, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])


def piece_digests(rows: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of encoded rows.

    The last is the digest of every piece's first and last byte, as little-endian 32-bit numbers.
    """
    name = _shared_model(rows, model_path)
    rows = rows.select(rows[key].alias(key), "ids", "begins", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            yield _digested(encoder, batch.column(0), [batch.column(i) for i in (1, 2, 3)], key)

    return rows.mapInArrow(run, _digest_kind(key, rows.schema[key].dataType.simpleString()))


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(key, ids, begins, ends): the pieces of every text and the bytes of the original each one covers.

    With ``digests`` what :func:`piece_digests` makes of them, in the same task: the pieces stay in its memory.
    """
    name = _shared_model(docs, model_path)
    rows = docs.select(docs[key].alias(key), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            start = 0
            while start < batch.num_rows:
                most = int(np.searchsorted(ends, ends[start] + BYTES, side="right")) - 1 - start
                part = batch.slice(start, max(1, min(AT_ONCE, most)))
                start += part.num_rows
                offsets, *found = encoder.spans(part.column(1).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in found]
                if digests:
                    yield _digested(encoder, part.column(0), lists, key)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *lists], [key, "ids", "begins", "ends"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, _digest_kind(key, kind) if digests else f"`{key}` {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(rows: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows with id lists; null or no ids give an empty text."""
    name = _shared_model(rows, model_path)
    rows = rows.select(rows[key].alias(key), rows[ids].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
