"""Streaming Viterbi over SentencePiece vocabularies (operator 9).

The lattice has one node per boundary between code points and one edge per
piece.  Every node keeps one back pointer, so only the pieces that end at the
next node have to be looked at: a window of the longest piece.  Whenever the
back pointers of all nodes in the window lead to one common boundary, what lies
before it can no longer change and its ids are committed; text and pointers
before the boundary are dropped.

``unigram``  an edge costs its piece's score; the best sum wins, on ties the
             path whose last piece is longer.
``bpe``      merging by score gives every prefix exactly one encoding, and a
             sequence is an encoding if and only if each pair of neighbours is
             the encoding of its joined text (a merge that first crosses a
             border would cross it in the pair too).  So a node has one valid
             edge, found by that test on pairs; no text is merged as a whole.

Where no piece holds the two characters around a boundary, all paths converge
there.  Such boundaries are taken as known, first those before a space mark,
and the ids between two of them, which depend on nothing else, are remembered
(at most ``LIMIT`` segments per worker).

Defined results: null is read as empty and has no ids; ids are those of the
model's own library for every text, its byte fallback and (without one) its
joined unknown runs included; decoding gives the library's text, with U+FFFD
for each byte that is not UTF-8; repeated rows are encoded each; an empty table
gives no rows.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_workers, plain

SPACE = "▁"
#: Segments remembered per worker, and the longest of them in code points.
LIMIT, LONGEST = 600_000, 64
#: Bytes of output gathered before an Arrow batch is handed over.
BATCH = 8 << 20
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class StreamingViterbi:
    """The pieces of a text, given in chunks of any size."""

    def __init__(self, scores: dict[str, float], kind: str, unknown: float = -1e6) -> None:
        self.scores, self.unknown = scores, unknown
        self.width = max(map(len, scores), default=1)
        #: Every ending of a piece, and whether it is a piece itself.
        self._endings = {p[k:]: p[k:] in scores for p in scores for k in range(len(p))}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._extend, self._start = (self._merged_pieces, "") if kind == "bpe" else (self._best_pieces, 0.0)

    def pieces(self, chunks: Iterable[str]) -> Iterator[list[str]]:
        """Lists of committed pieces, in order."""
        text = ""                            # since the last committed boundary
        back, state = [0], [self._start]     # per boundary: length of its last piece; that piece, or the path's score
        check = 2 * self.width
        for chunk in chunks:
            for at in range(0, len(chunk), 4 * self.width):
                text += chunk[at:at + 4 * self.width]
                self._extend(text, back, state)
                if len(text) >= check:
                    cut = self._converged(back)
                    if cut:
                        yield _path(text, back, cut)
                        text, back, state = text[cut:], [0, *back[cut + 1:]], state[cut:]
                    check = len(text) + 2 * self.width
        if text:
            yield _path(text, back, len(text))

    def _merged_pieces(self, text: str, back: list[int], state: list) -> None:
        ending, pair = self._endings.get, self._pairs.get
        for end in range(len(back), len(text) + 1):
            for start in range(end - 1, -1, -1):
                piece = text[start:end]
                whole = ending(piece)
                if whole or start == end - 1:
                    known = pair((state[start], piece))
                    if known or known is None and self._neighbours(state[start], piece):
                        break
                # one of the lengths is valid, so the loop ends by the break above
            back.append(end - start)
            state.append(piece)

    def _best_pieces(self, text: str, back: list[int], state: list) -> None:
        for end in range(len(back), len(text) + 1):
            chosen, top = 1, state[end - 1] + self.scores.get(text[end - 1:end], self.unknown)
            for n in range(2, end + 1):
                whole = self._endings.get(text[end - n:end])
                if whole is None:
                    break
                if whole and state[end - n] + self.scores[text[end - n:end]] >= top:
                    chosen, top = n, state[end - n] + self.scores[text[end - n:end]]
            back.append(chosen)
            state.append(top)

    def _converged(self, back: list[int]) -> int:
        """The last boundary on the paths of all nodes a coming piece can start at."""
        alive = set(range(max(0, len(back) - self.width), len(back)))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - back[last])
        return alive.pop()

    def _neighbours(self, left: str, right: str) -> bool:
        if len(self._pairs) >= LIMIT:
            self._pairs.clear()
        known = self._pairs[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def _merged(self, text: str) -> list[str]:
        """Merges by highest score, on ties from the left; at most two pieces long."""
        parts = list(text)
        while True:
            found = [(-self.scores[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1)
                     if parts[i] + parts[i + 1] in self.scores]
            if not found:
                return parts
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]


def _path(text: str, back: list[int], end: int) -> list[str]:
    out = []
    while end:
        out.append(text[end - back[end]:end])
        end -= back[end]
    return out[::-1]


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("webtext-bytes", _byte_by_byte)


class PieceModel:
    """A vocabulary file with its streaming encoder and decoder."""

    def __init__(self, path: str, kind: str) -> None:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = list(map(sp.id_to_piece, range(n)))
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.viterbi = StreamingViterbi({p: sp.get_score(i) for p, i in self.ids.items()}, kind)
        self.normalise: Callable[[str], str] = sp.normalize
        self.unknown = sp.unk_id()
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        self.bytes = {int(names[i][3:5], 16): i for i in byte_ids}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.prefix = sp.normalize("a").startswith(SPACE)
        self.known: dict[str, bytes] = {}
        # what an id stands for in the decoded bytes; control pieces stand for nothing
        self.table = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i)
                      else names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.table[i] = bytes([b])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for slab in _slabs(self.normalise(text)):
            for segment in _SEGMENT.findall(slab) if self.cuts else [slab]:
                ids = self.known.get(segment)
                out.append(self._segment(segment) if ids is None else ids)
        return b"".join(out)

    def _segment(self, segment: str) -> bytes:
        if self.bytes and len(segment) <= LONGEST:
            # no piece holds the two characters around these boundaries
            ends = [i for i in range(1, len(segment)) if segment[i - 1:i + 1] not in self.inside]
            if ends:
                parts = [segment[a:b] for a, b in zip([0, *ends], [*ends, len(segment)])]
                return self._keep(segment, b"".join([self.known.get(p) or self._segment(p) for p in parts]))
        out, unknown = array("I"), False
        for pieces in self.viterbi.pieces([segment]):
            for piece in pieces:
                i = self.ids.get(piece)
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in piece.encode())
                elif not unknown:
                    out.append(self.unknown)
                unknown = i is None
        return self._keep(segment, out.tobytes())

    def _keep(self, segment: str, data: bytes) -> bytes:
        if len(segment) <= LONGEST:
            if len(self.known) >= LIMIT:    # common segments are met early: the younger half goes
                self.known = dict(islice(self.known.items(), LIMIT // 2))
            self.known[segment] = data
        return data

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, array("I", ids))).decode("utf-8", "webtext-bytes")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _slabs(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of a long text, cut before a space mark that follows another character."""
    at = 0
    while len(text) - at > size:
        cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})").search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def model(path: str, kind: str) -> PieceModel:
    """One per worker process and model file."""
    return PieceModel(path, kind)


def _mapped(df: DataFrame, step: Callable, names: list[str], kind: pa.DataType, schema: str) -> DataFrame:
    on_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, value in zip(b.column(0), b.column(1)):
                rows.append((doc_id.as_py(), step(value.as_py())))
                size += len(rows[-1][1])
                if size >= BATCH:
                    yield _batch(rows, names, kind)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, names, kind)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    ids, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, kind)], names)


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """``doc_id`` and ``ids``: a binary of little-endian unsigned 32-bit ids."""
    return _mapped(plain(docs), lambda text: model(path, kind).encode(text), ["doc_id", "ids"], pa.binary(),
                   "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """``doc_id`` and ``text`` of frames as ``encode`` returns them."""
    return _mapped(encoded.select("doc_id", "ids"), lambda ids: model(path, kind).decode(ids or b""),
                   ["doc_id", "text"], pa.string(), "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """``doc_id, ids`` and ``text``, decoded again from the ids."""
    encoded = encode(docs, path, kind)
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for b in batches:
            yield b.append_column("text", pa.array([m.decode(x.as_py()) for x in b.column(1)], pa.string()))

    return encoded.mapInArrow(run, "doc_id long, ids binary, text string")
