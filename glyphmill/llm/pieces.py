"""SentencePiece encoding by streaming Viterbi, and decoding.

A text is a path over character boundaries whose steps are pieces of the vocabulary. The path is
built from left to right; a boundary looks back over one piece length at most. Whenever all paths
that can still go on share a boundary, the ids up to there are committed and their pointers dropped,
so only a short window is held however long the text is.

* Unigram files: the path of the highest sum of piece scores.
* Byte-pair files: the path that the merges would give. It is the one path on which every two
  neighbouring pieces stay apart when they are merged on their own, so each boundary has one survivor.

Boundaries that no piece can cross (before a word's space mark) split a text into short stretches, whose ids
are remembered; stretches of any length go through the same window.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

SPACE = "▁"
# The model kinds of the file format, and the score of an unknown character below the least piece.
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
# Stretches whose ids a task remembers, and their longest length.
REMEMBER, SHORT = 1 << 19, 48
# Lengths of beginnings whose windows a task remembers.
HEADS = (3, 5)
# Characters before a boundary that tell which pieces can end there.
TAIL = 4
# Boundaries between two looks for a shared boundary.
LOOK = 64


def _field(message: bytes, number: int) -> list[int | bytes]:
    """Values of one field of a protocol-buffer message."""
    at, out = 0, []

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        if key >> 3 == number:
            out.append(value)
    return out


class Remembered(dict):
    """A function that keeps a bounded number of its results (of arguments up to a length).

    When it is full, its results become the older half; those used again come back from there.
    """

    def __init__(self, fn, longest: int | None = None, size: int = REMEMBER):
        super().__init__()
        self.fn, self.longest, self.size, self.older = fn, longest, size, {}

    def __missing__(self, value):
        found = self.older.get(value)
        if found is None:
            found = self.fn(value)
            if self.longest is not None and len(value) > self.longest:
                return found
        if len(self) >= self.size // 2:
            self.older = dict(self)
            self.clear()
        self[value] = found
        return found


class Pieces:
    """A vocabulary read from the bytes of a SentencePiece model file."""

    def __init__(self, model: bytes):
        self.model = model
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer = _field(model, 2)
        self.kind = next(iter(_field(trainer[0], 3)), UNIGRAM) if trainer else UNIGRAM
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair files are read")
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in usable}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        # With a byte piece for each byte nothing is unknown.
        self.fallback = len(self.bytes) == 256
        self.floor = min(self.score.values()) - UNKNOWN_PENALTY
        self.text = [self._bytes_of(i) for i in range(n)]
        self.dummy = sp.encode("a")[:1] != sp.encode("aa")[:1] or sp.normalize("a").startswith(SPACE)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # Plain characters that are in no longer piece (line ends, mostly) stand alone as well.
        inside = set("".join(p for p in self.ids if len(p) > 1))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        cut = f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.stretch = re.compile("(?s).+" if crossing else cut)
        spec = _field(model, 3)
        rules = {k: next(iter(_field(spec[0], k)), default) for k, default in ((2, b""), (3, 1), (4, 1), (5, 1))} if spec else {}
        # No character map, a space mark first, spaces kept and marked, and line ends in no longer piece.
        self.plain = rules == {2: b"", 3: 1, 4: 0, 5: 1} and "\n" in alone and not crossing
        self.known = Remembered(self.window, SHORT)
        self.marked = Remembered(lambda word: self.window(SPACE + word), SHORT, 2 * REMEMBER)
        self.heads = Remembered(self._head, size=1 << 17)
        self.apart = Remembered(self._apart)
        self.runs = Remembered(self._run)
        self.sizes = Remembered(self._sizes)
        self.tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) >= TAIL:
                self.tails.setdefault(piece[-TAIL:], set()).add(len(piece))
        self.line_end = self.window("\n") if self.plain else ()

    def __reduce__(self):
        return Pieces, (self.model,)

    def _bytes_of(self, i: int) -> bytes:
        if self.sp.is_control(i):
            return b""
        if self.sp.is_byte(i):
            return bytes([int(self.sp.id_to_piece(i)[3:5], 16)])
        if self.sp.is_unknown(i):
            return " ⁇ ".encode()
        return self.sp.id_to_piece(i).replace(SPACE, " ").encode()

    def _run(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """The merges that form a piece, in order: their scores, and the first and last part before each.

        Ends with a score below all and the whole piece (or what its merges leave of it).
        """
        parts, score = list(piece), self.score
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                scores.append(-math.inf)
                return scores, firsts, lasts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])

    def _apart(self, pair: tuple[str, str]) -> bool:
        """Do two neighbouring pieces stay apart when the merges of both run side by side?

        At each step the best merge is the next one inside either piece or the one across the
        boundary; among equals the leftmost goes first.
        """
        (left, _, ends), (right, starts, _) = self.runs[pair[0]], self.runs[pair[1]]
        score = self.score
        i = j = 0
        across = score.get(ends[0] + starts[0])
        while True:
            a, b = left[i], right[j]
            if across is not None and across > a and across >= b:
                return False
            if a >= b:
                if a == -math.inf:
                    return True
                i += 1
                if ends[i] == ends[i - 1]:
                    continue
            else:
                j += 1
                if starts[j] == starts[j - 1]:
                    continue
            across = score.get(ends[i] + starts[j])

    def _sizes(self, tail: str) -> tuple[int, ...]:
        """Lengths, longest first, that pieces can have which end where the text ends in ``tail`` (up to ``TAIL`` characters)."""
        longer = sorted(self.tails.get(tail, ()), reverse=True) if len(tail) == TAIL else ()
        return (*longer, *(n for n in range(min(len(tail), TAIL - 1), 1, -1) if tail[-n:] in self.ids), 1)

    def _grow(self, text: str, last: list[str], total: list[float], base: int, start: int, stop: int) -> None:
        """Find the surviving step to each boundary from ``start`` to ``stop``.

        ``last`` and ``total`` hold, for the boundaries from ``base`` on, the last piece of the
        surviving path to it and (unigram) its score.
        """
        ids, apart, sizes, score = self.ids, self.apart, self.sizes, self.score
        if self.kind == BPE:
            for i in range(start, stop + 1):
                for size in sizes[text[i - TAIL : i] if i > TAIL else text[:i]]:
                    if size < i:
                        step = text[i - size : i]
                        # Lengths up to the tail's are of pieces (or one character).
                        if (size <= TAIL or step in ids) and apart[last[i - size - base], step]:
                            break
                    elif size == i:
                        step = text[:i]
                        if size <= TAIL or step in ids:
                            break
                last.append(step)
            return
        for i in range(start, stop + 1):
            best = step = None
            for size in sizes[text[i - TAIL : i] if i > TAIL else text[:i]]:
                piece = text[i - size : i] if size <= i else ""
                value = score.get(piece)
                if value is None:
                    if size > 1:
                        continue
                    value = self.floor
                value += total[i - size - base]
                if best is None or value > best:
                    step, best = piece, value
            total.append(best)
            last.append(step)

    def _head(self, head: str) -> tuple[list[str], list[float]]:
        """State of the window after the beginning of a stretch, which does not depend on how it goes on."""
        if len(head) > HEADS[0]:
            last, total = map(list, self.heads[head[: HEADS[0]]])
        else:
            last, total = [""], [0.0]
        self._grow(head, last, total, 0, len(last), len(head))
        return last, total

    def _at_once(self, text: str) -> list[str]:
        """:meth:`steps` of a stretch that one look covers: grown once, walked back once."""
        n = len(text)
        if n > HEADS[1]:
            last, total = self.heads[text[: HEADS[1]]]
            last, total = last[:], total[:]
        else:
            last, total = [""], [0.0]
        self._grow(text, last, total, 0, len(last), n)
        path = []
        while n:
            path.append(step := last[n])
            n -= len(step)
        path.reverse()
        return path

    def steps(self, text: str) -> Iterator[str]:
        """Pieces (or unknown characters) of one stretch, committed as soon as no path can change them."""
        n, longest = len(text), self.longest
        last, total = [""], [0.0]
        for size in HEADS:
            if n > size:
                last, total = self.heads[text[:size]]
        last, total, base, done = list(last), list(total), 0, 0
        i = len(last) - 1
        while i < n:
            stop = min(n, i + LOOK)
            self._grow(text, last, total, base, i + 1, stop)
            i = stop
            # Boundaries from which a path can go on: those within one piece length, or the end.
            live = set(range(max(done, i - longest + 1), i + 1)) if i < n else {i}
            while len(live) > 1:
                top = max(live)
                live.discard(top)
                live.add(max(top - len(last[top - base]), done))
            shared, path = live.pop(), []
            while shared > done:
                path.append(last[shared - base])
                shared -= len(path[-1])
            yield from reversed(path)
            done += sum(map(len, path))
            # Everything before the committed boundary and one piece length is forgotten.
            old = max(0, min(done, i - longest) - base)
            del last[:old], total[:old]
            base += old

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unknown]

    def window(self, stretch: str) -> tuple[int, ...]:
        path = self._at_once(stretch) if len(stretch) <= LOOK else [*self.steps(stretch)]
        ids = tuple(map(self.ids.get, path))
        if None not in ids:
            return ids
        out: list[int] = []
        for piece in path:
            found = self.ids_of(piece)
            # Unknown characters in a row are one unknown piece.
            if not (found == [self.unknown] and out[-1:] == found):
                out += found
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for NULL and empty texts."""
        if not text:
            return []
        if not self.plain or "  " in text or SPACE in text or text[0] == " " or "\n " in text:
            return list(chain.from_iterable(map(self.known.__getitem__, self.stretch.findall(self.sp.normalize(text)))))
        # Single spaces and line ends alone are where the expression above would cut as well.
        first, *lines = text.split("\n")
        marked, out = self.marked.__getitem__, []
        out += chain.from_iterable(map(marked, first.split(" ")))
        for line in lines:
            out += self.line_end
            start, *rest = line.split(" ")
            if start:
                out += self.known[start]
            out += chain.from_iterable(map(marked, rest))
        return out

    def decode(self, ids) -> str:
        """Text of a sequence of ids; the space mark that encoding puts first is taken off."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", intact: str = "intact") -> DataFrame:
    """``df`` with the ids of ``text`` (array of int) and whether decoding them gives the text back.

    The model file is read where the job starts and sent to the tasks. Rows are independent: NULL and
    empty texts have no ids and are intact; columns ``ids`` and ``intact`` of ``df`` are replaced;
    every other column stays. A text is read whole, its ids are found in a window.
    """
    source = df.drop(ids, intact)
    pieces = Pieces(_read(model_path))
    schema = StructType(list(source.schema.fields)).add(ids, ArrayType(IntegerType(), False)).add(intact, BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here refers to itself, and looking for what does costs a tenth of the time.
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found, same = [], []
            for value in batch.column(at):
                value = value.as_py()
                row = pieces.encode(value)
                found.append(pa.array(row, pa.int32()))
                same.append(pieces.decode(row) == (value or ""))
            offsets, total = [0], 0
            for row in found:
                total += len(row)
                offsets.append(total)
            flat = pa.concat_arrays(found) if found else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            columns = [*batch.columns, lists, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, ids, intact])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with ``text`` made of ``ids`` (NULL for NULL); other columns stay."""
    source = df.drop(text)
    pieces = Pieces(_read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids))
            texts = [None if v.as_py() is None else pieces.decode(v.as_py()) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return source.mapInArrow(run, StructType(list(source.schema.fields)).add(text, "string"))
