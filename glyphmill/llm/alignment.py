"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide counts of linked id pairs.

Both encodings of a text are cut into groups at the byte offsets where a token of either ends. Most
groups are one token of each with the same bytes; an array from A ids to the B id of the same bytes
recognises them, and they are counted in a vector of the vocabulary's length in every task. Only the
pairs of other groups are rows of a shuffle, once for each block of texts that holds them.

Texts are encoded by stretches without spaces, whose groups a task remembers: at a single space or
line end between other characters both tokenizers begin anew. Other texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from glyphmill.llm.pieces import SPACE, Pieces
from glyphmill.operators.skew import join_by_key
from glyphmill.session import stored

# Fixed value: the published pattern that byte-level vocabularies of this family cut texts by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters of a block of texts, and bytes of remembered stretches; neither changes a result.
BLOCK, REMEMBER = 1 << 22, 64 << 20
# Links of a group up to which its tokens are paired one by one; larger groups pair their distinct ids.
PAIRED = 4096


def byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable Latin-1 stands for itself, the rest counts up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _lengths(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int64, len(tokens))


class Rows:
    """Arrays of different lengths, one after the other, that grow."""

    def __init__(self, dtype: type):
        self.flat, self.ends = np.empty(1024, dtype), np.zeros(1024, np.int64)
        self.n = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        start, stop = int(self.ends[self.n]), int(self.ends[self.n]) + len(flat)
        if stop > len(self.flat):
            self.flat = np.concatenate([self.flat[:start], np.empty(max(stop, 2 * start) - start, self.flat.dtype)])
        if self.n + len(lengths) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n + 1], np.zeros(self.n + 2 * len(lengths) + 1024, np.int64)])
        self.flat[start:stop] = flat
        self.ends[self.n + 1 : self.n + len(lengths) + 1] = start + np.cumsum(lengths)
        self.n += len(lengths)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays ``at``, one after the other, and their lengths."""
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.flat[_spans(starts, lengths)], lengths


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ..`` for every start, as long as its length says."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class _Index(dict):
    """Numbers keys as they are asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Aligner:
    """Two vocabularies, read from the bytes of their files."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.files = a_file, b_file
        spec = json.loads(a_file)
        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first = len(ranks) - len(merges)
        cut = spec["pre_tokenizer"] or {}
        if any(vocabulary["".join(m)] != first + i for i, m in enumerate(merges)) or spec["normalizer"] or cut.get("add_prefix_space"):
            raise ValueError("only byte-level files whose ids follow their merges are read")
        self.a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        n = self.b.get_piece_size()
        self.b_bytes = [self._piece(i) for i in range(n)]
        self.by_stretch = Pieces(b_file).plain
        of_bytes = {t: i for i, t in reversed(list(enumerate(self.b_bytes))) if t and not self.b.is_byte(i)}
        of_bytes = {t: i for i, t in enumerate(self.b_bytes) if t and self.b.is_byte(i)} | of_bytes
        self.identity = np.fromiter((of_bytes.get(t, -1) for t in self.a_bytes), np.int64, len(self.a_bytes))
        self.stride = n
        if n * len(self.a_bytes) >= 1 << 32:
            raise ValueError("a pair of ids has to fit 32 bits")
        self.a_length, self.b_length = _lengths(self.a_bytes), _lengths(self.b_bytes)
        ids = max(n, len(self.a_bytes))
        width = len(str(ids)) + 1
        self.digits = np.frombuffer("".join(str(i).ljust(width) for i in range(ids)).encode(), np.uint8).reshape(ids, width)
        self.width = np.fromiter((len(str(i)) for i in range(ids)), np.int64, ids)
        self.forget()

    def __reduce__(self):
        return Aligner, self.files

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def forget(self) -> None:
        """Nothing is remembered any more."""
        self.index = _Index()
        self.sound: list[bool] = []
        self.shown: list[bytes] = []
        self.counts = Rows(np.int64)  # tokens of A, of B, groups and links
        self.codes, self.weights = Rows(np.int64), Rows(np.int64)
        self.held = 0

    def _encode(self, keys: list) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both tokenizers, and whether their bytes are those of the text they stand for."""
        texts = [k if isinstance(k, str) else k[0] for k in keys]
        pieces = self.b.encode(texts, num_threads=1) if texts else []
        a, b, sound = [], [], []
        for key, text, right in zip(keys, texts, pieces):
            line = isinstance(key, str) and text[:1] == "\n"
            if isinstance(key, str):
                body = text[line:]
                fits = bool(body) and body == body.strip()
            else:
                fits = bool(text)
            if line:
                # The encoder's own space stands alone before a line end.
                fits, right = fits and self.b_bytes[right[0]] == b" ", right[1:]
            given = text if line else " " + text
            left = self.a.encode_ordinary(given) if fits else []
            want = given.encode() if fits else b""
            fits = fits and b"".join(map(self.a_bytes.__getitem__, left)) == want == b"".join(map(self.b_bytes.__getitem__, right))
            a.append(left if fits else [])
            b.append(right if fits else [])
            sound.append(fits)
        return a, b, sound

    def _learn(self) -> None:
        """Align what the index has been asked for anew."""
        keys, self.index.new = self.index.new, []
        left, right, sound = self._encode(keys)
        n = len(keys)
        a_n, b_n = (np.fromiter(map(len, x), np.int64, n) for x in (left, right))
        a, b = (np.fromiter((i for row in x for i in row), np.int64, int(m.sum())) for x, m in ((left, a_n), (right, b_n)))
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        # Tokens of B that end where one of A ends, and those of A.
        at = np.searchsorted(a_ends, b_ends)
        close_b = np.flatnonzero(a_ends[at] == b_ends) if len(a) else np.empty(0, np.int64)
        close_a = at[close_b]
        from_a, from_b = (np.concatenate([[0], c[:-1] + 1]).astype(np.int64)[: len(c)] for c in (close_a, close_b))
        size_a, size_b = close_a - from_a + 1, close_b - from_b + 1
        unit = np.searchsorted(np.cumsum(a_n), close_a, side="right")
        links = size_a * size_b
        per = lambda values: np.bincount(unit, values, n).astype(np.int64) if len(unit) else np.zeros(n, np.int64)
        self.counts.add(np.stack([a_n, b_n, per(np.ones(len(unit))), per(links)], axis=1).ravel(), np.full(n, 4))
        self._show(a, b, from_b, close_a, close_b, size_a, size_b, unit, n)
        code, weight, group = self._pairs(a, b, from_a, from_b, size_a, size_b, links)
        order = np.argsort(group, kind="stable")
        per_unit = np.bincount(unit[group], minlength=n) if len(group) else np.zeros(n, np.int64)
        self.codes.add(code[order], per_unit)
        self.weights.add(weight[order], per_unit)
        self.sound += sound
        self.held += sum(map(len, self.shown[-n:])) + 16 * len(code) + 300 * n if n else 0

    def _show(self, a, b, from_b, close_a, close_b, size_a, size_b, unit, n) -> None:
        """Decimal ids in order, ``a,a|b,b;`` for each group."""
        after_a, after_b = np.full(len(a), ord(","), np.uint8), np.full(len(b), ord(","), np.uint8)
        after_a[close_a], after_b[close_b] = ord("|"), ord(";")
        ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        place_a = np.arange(len(a)) + np.repeat(from_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(close_a + 1, size_b)
        ids[place_a], ids[place_b], marks[place_a], marks[place_b] = a, b, after_a, after_b
        rows, width = self.digits[ids], self.width[ids]
        rows[np.arange(len(ids)), width] = marks
        text = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes() if len(ids) else b""
        tokens = np.bincount(unit, size_a + size_b, n).astype(np.int64) if len(unit) else np.zeros(n, np.int64)
        ends = np.concatenate([[0], np.cumsum(width + 1)])[np.cumsum(tokens)].tolist() if n else []
        start = 0
        for end in ends:
            self.shown.append(text[start:end])
            start = end

    def _pairs(self, a, b, from_a, from_b, size_a, size_b, links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes ``A id * stride + B id`` of all links, how often each is meant, and its group."""
        small = np.flatnonzero(links <= PAIRED)
        group = np.repeat(small, links[small])
        within = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        code = a[from_a[group] + within // size_b[group]] * self.stride + b[from_b[group] + within % size_b[group]]
        codes, weights, groups = [code], [np.ones(len(code), np.int64)], [group]
        for g in np.flatnonzero(links > PAIRED).tolist():
            x, x_n = np.unique(a[from_a[g] : from_a[g] + size_a[g]], return_counts=True)
            y, y_n = np.unique(b[from_b[g] : from_b[g] + size_b[g]], return_counts=True)
            codes.append((x[:, None] * self.stride + y).ravel())
            weights.append((x_n[:, None] * y_n).ravel())
            groups.append(np.full(len(codes[-1]), g))
        return np.concatenate(codes), np.concatenate(weights), np.concatenate(groups)

    def _units(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.by_stretch:
            return [self.index[(text,)]]
        return list(map(self.index.__getitem__, text.replace("\n", " \n").split(" ")))

    def texts(self, values: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For every text its four counts and the digest of its groups; and the distinct links of all:
        row, code, and how often the row holds it, in order of row and code."""
        if self.held > REMEMBER:
            self.forget()
        units = [self._units(v) for v in values]
        self._learn()
        broken = [i for i, own in enumerate(units) if not all(map(self.sound.__getitem__, own))]
        for i in broken:
            units[i] = [self.index[(values[i],)]]
        self._learn()
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.fromiter((u for own in units for u in own), np.int64, int(lengths.sum()))
        row = np.repeat(np.arange(len(units)), lengths)
        counts = self.counts.flat[: 4 * self.counts.n].reshape(-1, 4)[flat]
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts, axis=0)])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        totals = sums[bounds[1:]] - sums[bounds[:-1]]
        digests = [hashlib.sha256(b"".join(map(self.shown.__getitem__, own))[:-1]).hexdigest() if n else "" for own, n in zip(units, totals[:, 0].tolist())]
        key, times = np.unique(row << 32 | flat, return_counts=True)
        codes, n = self.codes.take(key & 0xFFFFFFFF)
        weights = self.weights.take(key & 0xFFFFFFFF)[0] * np.repeat(times, n)
        link = np.repeat(key >> 32, n) << 32 | codes
        order = np.argsort(link)
        link, weights = link[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], link[1:] != link[:-1]])) if len(link) else np.empty(0, np.int64)
        held = np.add.reduceat(weights, first) if len(first) else weights
        return totals, digests, link[first] >> 32, link[first] & 0xFFFFFFFF, held

    def regular(self, codes: np.ndarray) -> np.ndarray:
        """Are these the pairs of one A id and the B id of the same bytes?"""
        return self.identity[codes // self.stride] == codes % self.stride


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Pieces of a batch of about ``BLOCK`` characters, with their first row."""
    start, held, size = 0, [], 0
    for value in texts:
        held.append(value.as_py())
        size += len(held[-1] or "") + 64
        if size >= BLOCK:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token alignment of every text with the corpus-wide standing of its links.

    Returns the columns ``keep`` of ``docs`` (all but the text, by default) as the struct ``row``,
    so that no name clashes, with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` (bigint) and ``groups_sha256``.
    ``a_path`` is a byte-level vocabulary, whose texts get a space in front, ``b_path`` a
    SentencePiece model that adds it itself; both are read where the job starts and sent to the tasks.

    Every row counts as a document, also rows with equal or NULL ids. NULL and empty texts, and
    texts whose pieces do not spell them, have zeros and an empty digest. Texts of any length are
    encoded whole; what a task holds is bounded by a block of texts, and in it by the links of a text.
    Counts are exact: one vector of the vocabulary's length for each task, and a shuffle with a row
    for each other pair and block. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"))
    aligner = spark.sparkContext.broadcast(Aligner(_read(a_path), _read(b_path)))
    longs = ArrayType(LongType(), False)
    schema = StructType().add("block", LongType()).add("row", source.schema["row"].dataType)
    for name in _COUNTS:
        schema = schema.add(name, LongType())
    schema = schema.add("groups_sha256", StringType()).add("codes", BinaryType()).add("held", BinaryType())
    schema = schema.add("kind", IntegerType()).add("pairs", longs).add("docs", longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner.value
        vector = np.zeros(len(known.identity), np.int64)
        block, kind = TaskContext.get().partitionId() << 32, None

        def rows(block: int, n: int, row: pa.Array | None, filled: dict, number: int) -> pa.RecordBatch:
            own = row if row is not None else pa.nulls(n, kind)
            columns = {"block": pa.array([block] * n, pa.int64()), "row": own, "kind": pa.array([number] * n, pa.int32()), **filled}
            arrays = [columns.get(f) if f in columns else pa.nulls(n, t) for f, t in types.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(types))

        types = {"block": pa.int64(), "row": None, **{c: pa.int64() for c in _COUNTS}, "groups_sha256": pa.string(), "codes": pa.binary(),
                 "held": pa.binary(), "kind": pa.int32(), "pairs": pa.list_(pa.int64()), "docs": pa.list_(pa.int64())}
        for batch in batches:
            given, texts = batch.column(0), batch.column(1)
            kind = types["row"] = given.type
            for start, values in _blocks(texts):
                totals, digests, at, codes, held = known.texts(values)
                plain = known.regular(codes)
                np.add.at(vector, codes[plain] // known.stride, 1)
                pairs, n = np.unique(codes[~plain], return_counts=True)
                bounds = np.searchsorted(at, np.arange(len(values) + 1)).tolist()
                codes, held = codes.astype(np.uint32), held.astype(np.int64)
                filled = {c: pa.array(totals[:, i], pa.int64()) for i, c in enumerate(_COUNTS)}
                filled["groups_sha256"] = pa.array(digests, pa.string())
                filled["codes"] = pa.array([codes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                filled["held"] = pa.array([_packed(held[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary())
                yield rows(block, len(values), given.slice(start, len(values)), filled, 0)
                if len(pairs):
                    yield rows(block, 1, None, {"pairs": pa.array([pairs.tolist()], types["pairs"]), "docs": pa.array([n.tolist()], types["docs"])}, 1)
                block += 1
        seen = np.flatnonzero(vector)
        if len(seen):
            codes = seen * known.stride + known.identity[seen]
            yield rows(block, 1, None, {"pairs": pa.array([codes.tolist()], types["pairs"]), "docs": pa.array([vector[seen].tolist()], types["docs"])}, 2)

    parts = stored(source.mapInArrow(run, schema))
    pair = F.explode(F.arrays_zip("pairs", "docs")).alias("p")
    listed = parts.where("kind > 0").select("block", "kind", pair).select("block", "kind", F.col("p.pairs").alias("code"), F.col("p.docs").alias("n"))
    counts = stored(listed.groupBy("code").agg(F.sum("n").alias("count"), F.max("kind").alias("kind"), F.count(F.lit(1)).alias("blocks")))
    stride, size = aligner.value.stride, len(aligner.value.identity)
    # One row for each A id at most: bounded by the vocabulary.
    best, plain = np.zeros(size, np.int64), np.zeros(size, np.int64)
    per_id = F.expr(f"code div {stride}").alias("a")
    for r in counts.groupBy(per_id).agg(F.max("count").alias("best"), F.max(F.when(F.col("kind") == 2, F.col("count"))).alias("plain")).toLocalIterator():
        best[r.a], plain[r.a] = r.best, r.plain or 0
    law = spark.sparkContext.broadcast((best, plain))
    others = counts.where("kind = 1").select("code", "count", "blocks")
    total = others.agg(F.sum("blocks")).first()[0] or 0
    looked = join_by_key(listed.where("kind = 1").select("block", "code"), others, ["code"], "blocks", total, ["block"]).select(F.col("block").alias("of"), "code", "count")
    texts = parts.where("kind = 0").select("block", "row", *_COUNTS, "groups_sha256", "codes", "held")
    out = StructType().add("row", parts.schema["row"].dataType)
    for name in [*_COUNTS, "n_best", "count_sum"]:
        out = out.add(name, LongType())

    def stand(left: pa.Table, right: pa.Table) -> pa.Table:
        known, (best, plain) = aligner.value, law.value
        codes = [np.frombuffer(x, np.uint32) for x in left["codes"].to_pylist()]
        held = np.concatenate([_unpacked(x) for x in left["held"].to_pylist()])
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        code = np.concatenate(codes).astype(np.int64)
        a = code // known.stride
        count = plain[a]
        other = np.flatnonzero(~known.regular(code))
        keys, values = right["code"].to_numpy(), right["count"].to_numpy()
        order = np.argsort(keys)
        count[other] = values[order][np.searchsorted(keys[order], code[other])] if len(other) else 0
        sums = np.concatenate([[[0, 0]], np.cumsum(np.stack([held * (count == best[a]), held * count], axis=1), axis=0)])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        found = sums[bounds[1:]] - sums[bounds[:-1]]
        table = left.select(["row", *_COUNTS])
        table = table.append_column("n_best", pa.array(found[:, 0], pa.int64())).append_column("count_sum", pa.array(found[:, 1], pa.int64()))
        return table.append_column("groups_sha256", left["groups_sha256"])

    out = out.add("groups_sha256", StringType())
    return texts.groupBy("block").cogroup(looked.groupBy("of")).applyInArrow(stand, out)


def _packed(values: np.ndarray) -> bytes:
    """Positive numbers in as few bytes as the largest needs; the first byte says how many."""
    most = int(values.max()) if len(values) else 0
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)
