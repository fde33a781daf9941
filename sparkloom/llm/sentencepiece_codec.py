"""SentencePiece encoding and decoding with public models: a streaming trellis over piece boundaries.

Texts are walked once, character by character. A window keeps, for each of the last positions that a piece can
reach back to, the best way to arrive there; when the ways to all positions still reachable go through one
boundary, the ids before it are final and leave the window. Memory does not depend on the text's length. All text
goes through that window; a boundary where all ways are known to meet starts it afresh, and what it then made of a word
once is remembered, within a bound.

For unigram models the best way is the one with the greatest sum of scores (Viterbi). For BPE models it is the
one way whose last piece may stand next to the piece before it, that is, whose two pieces are what merging
their joined text gives; a prefix of a text has exactly one such way, so the trellis is the same with
admissible steps in place of scores.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textarrays as ta
from sparkloom.llm.common import small_batches
from sparkloom.llm.token_counts import tokenizer_path

#: Fixed values of the model file format: kinds of pieces and of models, and the visible space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: Words kept with their ids in a worker, the first ones met; others are encoded again each time.
CACHE_WORDS, CACHE_PAIRS = 1 << 19, 1 << 18
#: Of these, kept between tasks: the first ones met, which are the common ones.
KEPT_WORDS = 1 << 17


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a .model file, with encode() and decode()."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape, self.byte_fallback = UNIGRAM, True, True, True, False
        for number, value in _fields(data):
            if number == 1:
                fields = dict(_fields(value))
                self.pieces.append(fields[1].decode())
                self.scores.append(struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0)
                self.kinds.append(fields.get(3, NORMAL))
            elif number == 2:
                fields = dict(_fields(value))
                self.kind = fields.get(3, UNIGRAM)
                self.byte_fallback = bool(fields.get(35, 0))
            elif number == 3:
                fields = dict(_fields(value))
                self.prefix, self.squeeze, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))
                if fields.get(2):
                    raise ValueError("models with a character map are not supported: their normaliser is not the identity")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.id_of = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (NORMAL, USER)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[1:-1], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == BYTE}
        plain = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if kind == BYTE else plain.get(kind, p.encode()) for p, kind in zip(self.pieces, self.kinds, strict=True)]
        self.longest = max(map(len, self.id_of), default=1)
        self.unknown_score = min(self.scores, default=0.0) - 10.0
        self.trie: dict = {}
        for piece, k in self.id_of.items():
            if self.kind == UNIGRAM or self.merged(piece) == (piece,):  # BPE cannot make the others
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = k
        self._beside: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        # a character in no piece but its own is a part by itself, and no piece crosses from a word into a space
        crossing = [p for p in self.id_of if re.search(f"[^{SPACE}]{SPACE}", p)]
        joined = "".join(sorted({c for p in self.id_of if len(p) > 1 for c in p if c != SPACE}))
        self._split = re.compile(f"{SPACE}*[{re.escape(joined)}]+|{SPACE}+|[^{SPACE}{re.escape(joined)}]") if not crossing else None

    def normalised(self, text: str) -> str:
        """The text as the trellis sees it: spaces made visible, and one put before it, as the model asks."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> tuple[str, ...]:
        """BPE merges of a short text: the best-scored adjacent pair first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.id_of.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], k
            if best is None:
                return tuple(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves two pieces, by id, as they are when one follows the other."""
        key = left << 32 | right
        found = self._beside.get(key)
        if found is None:
            a, b = self.pieces[left], self.pieces[right]
            found = self.merged(a + b) == (a, b)
            if len(self._beside) < CACHE_PAIRS:
                self._beside[key] = found
        return found

    def _text(self, piece: int) -> str:
        """A step of the trellis as text: a piece, or a character that no piece is, as -2 less its number."""
        return self.pieces[piece] if piece >= 0 else chr(-2 - piece)

    def beside(self, left: int, right: int) -> bool:
        """fits() for steps of which one may be an unknown character."""
        if left >= 0 <= right:
            return self.fits(left, right)
        a, b = self._text(left), self._text(right)
        return self.merged(a + b) == (a, b)

    def stream(self, text: str) -> Iterator[list[int]]:
        """The text's steps, in lists that are final as soon as every live way agrees on a boundary.

        The window holds, for each place behind the last final boundary, the last step of the best way there and where that
        step starts. Places that a piece from a later character can still reach are live. Once the window is twice the longest
        piece long, the live ways are followed back, and what they share leaves it; it grows only while they share nothing.
        """
        size, root, longest, scores, ids = len(text), self.trie, self.longest, self.scores, self.id_of
        ranked, known, fits = self.kind == UNIGRAM, self._beside.get, self.fits
        room = 2 * longest
        step, before, score = [-1] * (room + longest + 2), [0] * (room + longest + 2), [0.0] * (room + longest + 2)
        r = 0
        for start in range(size):
            left = step[r]
            if left != -1 or not start:
                node, end, value = root, r, score[r]
                for place in range(start, size):
                    node = node.get(text[place])
                    if node is None:
                        break
                    end += 1
                    found = node.get("")
                    if found is None:
                        continue
                    if ranked:
                        if step[end] == -1 or value + scores[found] > score[end]:
                            step[end], before[end], score[end] = found, r, value + scores[found]
                    elif step[end] == -1:
                        ok = True if not start else known(left << 32 | found) if left >= 0 else self.beside(left, found)
                        if ok is None:
                            ok = fits(left, found)
                        if ok:
                            step[end], before[end] = found, r
                if (ranked or step[r + 1] == -1) and text[start] not in ids:
                    other = -2 - ord(text[start])
                    if ranked:
                        if step[r + 1] == -1 or value + self.unknown_score > score[r + 1]:
                            step[r + 1], before[r + 1], score[r + 1] = other, r, value + self.unknown_score
                    elif not start or self.beside(left, other):
                        step[r + 1], before[r + 1] = other, r
            r += 1
            if r >= room and start + 1 < size:
                meet = self._common(step, before, r, r + longest)
                if meet:
                    yield self._path(step, before, meet)
                    base = score[meet]
                    step = step[meet:] + [-1] * meet
                    before = [x - meet for x in before[meet:]] + [0] * meet
                    score = [x - base for x in score[meet:]] + [0.0] * meet
                    r -= meet
                else:
                    room += longest
                    for x, empty in ((step, -1), (before, 0), (score, 0.0)):
                        x.extend([empty] * longest)
        if r:
            yield self._path(step, before, r)

    @staticmethod
    def _common(step: list[int], before: list[int], low: int, high: int) -> int:
        """The last boundary that the ways to all live places, from low to high, go through."""
        live = {k for k in range(low, high + 1) if step[k] != -1}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(before[top])
        return live.pop() if live else 0

    @staticmethod
    def _path(step: list[int], before: list[int], end: int) -> list[int]:
        steps = []
        while end > 0:
            steps.append(step[end])
            end = before[end]
        return steps[::-1]

    def _encode_part(self, part: str) -> list[int]:
        """Ids of the trellis's steps; an unknown character is its bytes, or with others in a row one unknown piece."""
        found: list[int] = []
        for steps in self.stream(part):
            if min(steps) >= 0:
                found += steps
                continue
            for x in steps:
                if x >= 0:
                    found.append(x)
                elif self.byte_fallback:
                    found += [self.byte_ids[b] for b in chr(-2 - x).encode()]
                elif found[-1:] != [self.unknown]:
                    found.append(self.unknown)
        return found

    def _word(self, word: str) -> bytes:
        packed = np.array(self._encode_part(word), np.int32).tobytes()
        if len(word) <= 64 and len(self._words) < CACHE_WORDS:
            self._words[word] = packed
        return packed

    def trim(self) -> None:
        """Give back most of the memory for words, between tasks."""
        self._words = dict(itertools.islice(self._words.items(), KEPT_WORDS))

    def packed(self, text: str) -> bytes:
        """Ids of the text as 32-bit numbers, all from stream().

        Where no piece crosses from a word into the next space, all ways meet before each space. From such a boundary the
        trellis goes on as from the start, so what it makes of the part up to the next one is remembered, as one transition.
        """
        text = self.normalised(text)
        if self._split is None or not self.byte_fallback:  # neighbouring unknown pieces are one: parts are not independent
            return np.array(self._encode_part(text), np.int32).tobytes()
        known, fresh = self._words.get, self._word
        return b"".join([known(w) or fresh(w) for w in self._split.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def text_of(self, data: bytes) -> str:
        """The text of joined piece bytes; bytes that are no UTF-8 become replacement characters."""
        text = data.decode("utf-8", "replace")
        text = text.replace(SPACE, " ") if self.escape else text
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode(self, ids: list[int]) -> str:
        return self.text_of(b"".join([self.bytes_of[k] for k in ids]))


@functools.cache
def model(name: str) -> Model:
    """The model of a public file or path; one for each worker process."""
    with open(tokenizer_path(name), "rb") as source:
        return Model(source.read())


def _lists(known: Model, texts: list[str | None]) -> pa.ListArray:
    """The texts' ids, null for null."""
    ids = [b"" if x is None else known.packed(x) for x in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=pa.array([x is None for x in texts]))


def _texts(known: Model, table: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The texts that lists of ids stand for; table holds the bytes of each id."""
    data, at = ta.buffer_of(table.take(lists.flatten()))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = at[np.concatenate(([0], np.cumsum(counts)))]
    return pa.array([known.text_of(data[a:b].tobytes()) if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)], pa.string())


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """All columns of docs and ids, the text's piece ids without begin or end, and, if decoded_col is given, the text
    decoded from them again in the same pass. Null texts give null, empty ones no ids; rows that repeat give equal rows; an empty
    table gives no rows; texts of any length pass the same window. Columns of docs with the names of the new ones are
    replaced."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(name)
        table = pa.array(known.bytes_of, pa.binary())
        for batch in batches:
            for part in ta.chunks(batch, 1):
                lists = _lists(known, part.column(1).to_pylist())
                more = [_texts(known, table, lists)] if decoded_col else []
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *more], names=["rows", "ids", "decoded"][: 2 + len(more)])
        known.trim()

    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    rows = docs.select(F.struct(*names).alias("rows"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["rows"].dataType.simpleString()
    coded = rows.mapInArrow(run, f"rows {kind}, ids array<int>" + ", decoded string" * bool(decoded_col))
    return coded.select("rows.*", F.col("ids").alias(ids_col), *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def decode(docs: DataFrame, name: str = "piece_bpe_32k.model", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of docs and the decoded text of its ids, in place of a column of that name; null ids give null, no ids an
    empty text, rows that repeat equal rows, an empty table no rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(name)
        table = pa.array(known.bytes_of, pa.binary())
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), _texts(known, table, part.column(1))], names=["rows", "text"])

    names = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*names).alias("rows"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["rows"].dataType.simpleString()
    return rows.mapInArrow(run, f"rows {kind}, text string").select("rows.*", F.col("text").alias(text_col))
