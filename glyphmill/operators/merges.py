"""Byte-pair vocabularies: merges learned from a table of word types, and texts cut by them.

Word types, packed into blocks, and pair counts are Spark tables. A round applies a batch of merges to the types and
returns only what changes in the pair counts, so that a count is never taken anew. A batch holds as many
merges as the ``LOOK`` best pairs decide without a further look at the types; it is the beginning of what
merging one pair at a time would give, ties (the smaller symbols first) included. Once the types have at most
``WHOLE`` symbols, one task ends the work: it merges one pair after the other in one array.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import discard, stored

# Best pairs that a round looks at, and sums that a task holds before it returns them.
LOOK, HELD = 512, 1 << 20
# Symbols of a block (a batch of types more at most). A character's number is its code point, what merges make comes after all of them.
BLOCK, CHARS = 1 << 18, 0x110000
# Symbols that one task holds with their places (some 50 bytes each), the most frequent pairs that it follows then, and
# rounds from one look at the number of symbols to the next.
WHOLE, PAIRS, EVERY = 1 << 24, 1 << 17, 8

Pair = tuple[str, str]
_ROUND = "kind int, n bigint, a string, b string, x string, symbols binary, counts binary"


def merged(symbols: list[str], pair: Pair) -> list[str]:
    """Every occurrence of the pair joined, from left to right."""
    a, b = pair
    out: list[str] = []
    i, last = 0, len(symbols) - 1
    while i <= last:
        if i < last and symbols[i] == a and symbols[i + 1] == b:
            out.append(a + b)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _joined(s: np.ndarray, a: int, b: int, new: int) -> np.ndarray:
    """:func:`merged` for an array of numbered symbols, in which a negative number ends a type."""
    at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
    if a == b and len(at):
        # Of a run of equal symbols every second place.
        starts = np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0)
        at = at[(at - at[np.maximum.accumulate(starts)]) % 2 == 0]
    s[at] = new
    return np.delete(s, at + 1)


class _Finder:
    """Finds some pairs of numbered symbols in an array."""

    def __init__(self, pairs: list[tuple[int, int]], width: int) -> None:
        codes = np.array([a * width + b for a, b in pairs], np.int64)
        self.order, self.width = np.argsort(codes), width
        self.codes = codes[self.order]
        # One place more, which the number that ends a type looks at.
        self.first, self.second = np.zeros(width + 1, bool), np.zeros(width + 1, bool)
        self.first[codes // width] = True
        self.second[codes % width] = True

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``s`` pairs begin, and which."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.first[s[:-1]] & self.second[s[1:]])
        codes = s[at].astype(np.int64) * self.width + s[at + 1]
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        good = self.codes[place] == codes
        return at[good], self.order[place[good]]


class _Sums:
    """Sums by code."""

    def __init__(self) -> None:
        self.codes, self.sums, self.held = [], [], 0

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.codes.append(codes)
        self.sums.append(n)
        self.held += len(codes)

    def crowded(self) -> bool:
        """Whether there are too many sums to hold; adds up what waits."""
        if self.held > HELD:
            self._reduce()
        return self.held > HELD // 2

    def _reduce(self) -> None:
        codes, n = np.concatenate(self.codes), np.concatenate(self.sums)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        sums = np.add.reduceat(n, starts)
        self.codes, self.sums, self.held = [codes[starts][sums != 0]], [sums[sums != 0]], int((sums != 0).sum())

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their sums other than 0; holds nothing after."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._reduce()
        out = self.codes[0], self.sums[0]
        self.__init__()
        return out


def _sizes(s: np.ndarray) -> np.ndarray:
    """Places that each type takes in an array of symbols, its end included."""
    return np.diff(np.flatnonzero(s < 0), prepend=-1)


def _count_pairs(moves: _Sums, s: np.ndarray, n: np.ndarray, width: int) -> None:
    whole = (s[:-1] >= 0) & (s[1:] >= 0)
    moves.add((s[:-1].astype(np.int64) * width + s[1:])[whole], np.repeat(n, _sizes(s))[:-1][whole])


def _longer(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The types of two symbols or more: one has nothing to merge any more."""
    sizes = _sizes(s)
    return s[np.repeat(sizes > 2, sizes)], n[sizes > 2]


def _frame(**columns) -> pd.DataFrame:
    return pd.DataFrame({c: columns.get(c) for c in ("kind", "n", "a", "b", "x", "symbols", "counts")})


def _block(s: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return _frame(kind=[0], symbols=[s.astype(np.int32).tobytes()], counts=[n.astype(np.int64).tobytes()])


def _pair_rows(moves: _Sums, width: int, name) -> Iterator[pd.DataFrame]:
    codes, sums = moves.taken()
    if len(codes):
        yield _frame(kind=1, n=sums, a=[name(i) for i in (codes // width).tolist()], b=[name(i) for i in (codes % width).tolist()])


def _pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: types packed into blocks (kind 0), the counts of their pairs (1) and the characters (4)."""
    moves, seen = _Sums(), set()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pd.DataFrame]:
        s, n = (np.concatenate(part) for part in zip(*held))
        held.clear()
        if len(n):
            _count_pairs(moves, s, n, CHARS)
            yield _block(s, n)
            if moves.crowded():
                yield from _pair_rows(moves, CHARS, chr)

    for frame in frames:
        if not len(frame):
            continue
        sizes = frame["w"].str.len().to_numpy() + 1
        s = np.full(sizes.sum(), -1, np.int32)
        inner = np.ones(len(s), bool)
        inner[np.cumsum(sizes) - 1] = False
        s[inner] = np.frombuffer("".join(frame["w"]).encode("utf-32-le", "surrogatepass"), np.int32)
        seen.update(np.unique(s[inner]).tolist())
        held.append(_longer(s, frame["n"].to_numpy()))
        if sum(len(part) for part, _ in held) > BLOCK:
            yield from flush()
    if held:
        yield from flush()
    yield from _pair_rows(moves, CHARS, chr)
    if seen:
        yield _frame(kind=4, x=[chr(c) for c in sorted(seen)])


def _round(batch: list[Pair], looked: list[Pair], made: list[str]):
    """Task function: the blocks after ``batch`` (kind 0), changes of pair counts (1), and what stands before and after the pairs ``looked`` at (2: before, 3: after).

    ``made`` are the strings that merges have made so far, those of the batch included.
    """
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, width = {x: CHARS + i for i, x in enumerate(made)}, CHARS + len(made)
        number = lambda x: ids[x] if len(x) > 1 else ord(x)
        name = lambda i: made[i - CHARS] if i >= CHARS else chr(i)
        steps = [(number(a), number(b), number(a + b)) for a, b in batch]
        merging = _Finder([step[:2] for step in steps], width)
        looking = _Finder([(number(a), number(b)) for a, b in looked], width)
        moves, around = _Sums(), _Sums()

        def flush() -> Iterator[pd.DataFrame]:
            yield from _pair_rows(moves, width, name)
            codes, sums = around.taken()
            if len(codes):
                pairs = [looked[i] for i in (codes // (2 * width)).tolist()]
                x = [name(i) for i in (codes // 2 % width).tolist()]
                yield _frame(kind=2 + codes % 2, n=sums, a=[a for a, _ in pairs], b=[b for _, b in pairs], x=x)

        for frame in frames:
            for symbols, counts in zip(frame["symbols"], frame["counts"]):
                s, n = np.frombuffer(symbols, np.int32), np.frombuffer(counts, np.int64)
                at, _ = merging.find(s)
                if len(at):
                    ends = s < 0
                    owner = np.cumsum(ends) - ends
                    hit = np.zeros(len(n), bool)
                    hit[owner[at]] = True
                    mine = hit[owner]
                    # The merges of a batch in their order; each looks at what the ones before have left.
                    new, new_n = s[mine], n[hit]
                    _count_pairs(moves, new, -new_n, width)
                    for step in steps:
                        new = _joined(new, *step)
                    _count_pairs(moves, new, new_n, width)
                    new, new_n = _longer(new, new_n)
                    s, n = np.concatenate([s[~mine], new]), np.concatenate([n[~hit], new_n])
                if not len(n):
                    continue
                yield _block(s, n)
                at, which = looking.find(s)
                weight = np.repeat(n, _sizes(s))[at]
                # Every type has its end behind it, and the first one finds the end of the last before it.
                for side, x in ((0, s[at - 1]), (1, s[at + 2])):
                    inner = x >= 0
                    around.add(((which * width + x) * 2 + side)[inner], weight[inner])
                if moves.crowded() | around.crowded():
                    yield from flush()
        yield from flush()

    return run


class _Whole:
    """All types in one array, in which places of merged symbols fall out of a chain: the merges one after the other.

    Only pairs of at least ``floor`` occurrences are counted. A pair of less can only get more when a merge makes a
    symbol that there is already; its pairs are counted anew then. When no counted pair is left, all are counted
    again from a lower floor. So the counts that decide are whole ones.
    """

    def __init__(self, s: np.ndarray, n: np.ndarray, made: list[str]) -> None:
        self.names, self.ids = made, {x: CHARS + i for i, x in enumerate(made)}
        self.s, self.weight = s.astype(np.int32), np.repeat(n, _sizes(s))
        self._look()

    def name(self, i: int) -> str:
        return self.names[i - CHARS] if i >= CHARS else chr(i)

    def _look(self) -> None:
        """Packs what is left and counts its pairs; the most frequent ones are followed."""
        keep = self.s > -2
        self.s, self.weight = self.s[keep], self.weight[keep]
        sizes = _sizes(self.s)
        longer = np.repeat(sizes > 2, sizes)
        self.s, self.weight = self.s[longer], self.weight[longer]
        self.heap, self.count, self.places = [], {}, {}
        self.next = self.last = None
        first = np.flatnonzero((self.s[:-1] >= 0) & (self.s[1:] >= 0)).astype(np.int32)
        code = self.s[first].astype(np.int64) << 32 | self.s[first + 1]
        order = np.argsort(code, kind="stable")
        code, first = code[order], first[order]
        del order
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        sums = np.add.reduceat(self.weight[first], starts) if len(starts) else np.zeros(0, np.int64)
        # Only the most frequent are followed; of those that tie for the last place none, if there are many.
        self.floor = 1
        if len(sums) > PAIRS:
            self.floor = int(np.partition(sums, -PAIRS)[-PAIRS])
            if (sums >= self.floor).sum() > 2 * PAIRS:
                self.floor = min(self.floor + 1, int(sums.max()))
        places = np.arange(len(self.s), dtype=np.int32)
        self.next, self.last = places + 1, places - 1
        bounds = np.append(starts, len(code))
        for k in np.flatnonzero(sums >= self.floor).tolist():
            pair = int(code[starts[k]])
            self.places[pair] = [first[bounds[k] : bounds[k + 1]]]
            self._set(pair, int(sums[k]))

    def _set(self, pair: int, n: int) -> None:
        self.count[pair] = n
        heapq.heappush(self.heap, (-n, self.name(pair >> 32), self.name(pair & 0xFFFFFFFF), pair))

    def _best(self) -> int | None:
        while True:
            while self.heap:
                n, _, _, pair = self.heap[0]
                now = self.count.get(pair, 0)
                if now == -n and now >= self.floor:
                    return pair
                heapq.heappop(self.heap)
                if now < self.floor:
                    self.count.pop(pair, None)
                    self.places.pop(pair, None)
                elif now < -n:
                    self._set(pair, now)
            if self.floor == 1:
                return None
            self._look()

    def _found(self, a: int, b: int, places: list[np.ndarray]) -> np.ndarray:
        """Where the pair stands now, of a run of equal symbols every second place."""
        at = np.unique(np.concatenate(places))
        at = at[(self.s[at] == a) & (self.s[self.next[at]] == b)]
        if a == b and len(at):
            taken, end = [], -1
            for x, y in zip(at.tolist(), self.next[at].tolist()):
                if x != end:
                    taken.append(x)
                    end = y
            at = np.array(taken, np.int32)
        return at

    def merge(self) -> Pair | None:
        """The next merge, done; None if no pair is left."""
        pair = self._best()
        if pair is None:
            return None
        a, b = pair >> 32, pair & 0xFFFFFFFF
        left, right = self.name(a), self.name(b)
        known = left + right in self.ids
        if not known:
            self.ids[left + right] = CHARS + len(self.names)
            self.names.append(left + right)
        new = self.ids[left + right]
        at = self._found(a, b, self.places[pair])
        s, follow, last, weight = self.s, self.next, self.last, self.weight
        changes: list[tuple[np.ndarray, np.ndarray]] = []

        def around(begins: np.ndarray, sign: int) -> np.ndarray:
            begins = begins[s[begins] >= 0]
            ends = s[follow[begins]]
            begins, ends = begins[ends >= 0], ends[ends >= 0]
            changes.append((s[begins].astype(np.int64) << 32 | ends, sign * weight[begins]))
            return begins

        # Places that begin a pair which goes: before, at and behind the merge.
        second = follow[at]
        before = last[at]
        around(np.unique(np.concatenate([before[before >= 0], at, second])), -1)
        behind = follow[second]
        s[at], s[second] = new, -2
        follow[at], last[behind] = behind, at
        before = last[at]
        begins = around(np.unique(np.concatenate([before[before >= 0], at])), 1)
        self._count(changes, begins)
        self.count.pop(pair, None)
        self.places.pop(pair, None)
        if known:
            self._recount(new)
        return left, right

    def _count(self, changes: list, begins: np.ndarray) -> None:
        codes, sums = np.concatenate([c for c, _ in changes]), np.concatenate([w for _, w in changes])
        found, which = np.unique(codes, return_inverse=True)
        moved = np.zeros(len(found), np.int64)
        np.add.at(moved, which, sums)
        grown = []
        for pair, n in zip(found.tolist(), moved.tolist()):
            if pair in self.count:
                self.count[pair] += n
                if n > 0:
                    self._set(pair, self.count[pair])
                    grown.append(pair)
            elif n >= self.floor:
                self.places[pair] = []
                self._set(pair, n)
                grown.append(pair)
        if grown:
            self._remember(changes[-1][0], begins, np.array(grown, np.int64))

    def _remember(self, codes: np.ndarray, begins: np.ndarray, grown: np.ndarray) -> None:
        """Adds the places of some pairs."""
        mine = np.isin(codes, grown)
        codes, begins = codes[mine], begins[mine]
        order = np.argsort(codes, kind="stable")
        codes, begins = codes[order], begins[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
            self.places[int(codes[k])].append(begins[k:end])

    def _recount(self, symbol: int) -> None:
        """The counts of all pairs of a symbol that there was already."""
        at = np.flatnonzero(self.s == symbol).astype(np.int32)
        before = self.last[at]
        begins = np.unique(np.concatenate([before[before >= 0], at]))
        begins = begins[self.s[begins] >= 0]
        ends = self.s[self.next[begins]]
        begins, ends = begins[ends >= 0], ends[ends >= 0]
        codes = self.s[begins].astype(np.int64) << 32 | ends
        found, which = np.unique(codes, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, which, self.weight[begins])
        order = np.argsort(which, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(found)))])
        for k in np.flatnonzero(sums >= self.floor).tolist():
            pair = int(found[k])
            self.places[pair] = [begins[order[bounds[k] : bounds[k + 1]]]]
            if self.count.get(pair) != int(sums[k]):
                self._set(pair, int(sums[k]))


def _finish(made: list[str], n_merges: int):
    """Task function over all blocks: the next ``n_merges`` merges in order, as far as there are pairs."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [(np.frombuffer(x, np.int32), np.frombuffer(n, np.int64)) for f in frames for x, n in zip(f["symbols"], f["counts"])]
        if not blocks:
            return
        whole = _Whole(*(np.concatenate(part) for part in zip(*blocks)), list(made))
        blocks.clear()
        out = []
        while len(out) < n_merges and (pair := whole.merge()) is not None:
            out.append(pair)
        yield pd.DataFrame({"at": range(len(out)), "a": [a for a, _ in out], "b": [b for _, b in out]})

    return run


def decided(ranked: list[tuple[str, str, int]], limit: tuple | None, bound: dict[Pair, int], chains: dict[tuple[Pair, Pair], int], room: int) -> list[Pair]:
    """The first merges that counting once decides.

    ``ranked`` are the best pairs with their counts and ``limit`` the key of the best pair that is not among
    them. ``bound`` is, for pairs that were looked at, the largest count of a triple around them: no pair that a
    merge creates can count more. ``chains`` counts the triples that two looked-at pairs share: what one merge
    takes from the other, if neither has lost to a third; else it takes that much at most. So every count is known
    from above and below, and the batch ends where these do not tell the best.
    """
    most = {(a, b): n for a, b, n in ranked}
    least = dict(most)
    touched: set[Pair] = set()
    starts, ends = {}, {}
    for a, b in most:
        starts.setdefault(a, []).append((a, b))
        ends.setdefault(b, []).append((a, b))
    out: list[Pair] = []
    created = 0
    while most and len(out) < room:
        best = min(most, key=lambda p: (-most[p], p))
        sure = least.pop(best)
        del most[best]
        key = (-sure, *best)
        if out and (sure <= created or (limit is not None and key > limit) or any((-n, *p) < key for p, n in most.items())):
            break
        out.append(best)
        if best not in bound:
            break
        a, b = best
        created = max(created, bound[best])
        for other in {*ends.get(a, ()), *starts.get(b, ())} & most.keys():
            if other not in bound:
                least[other] = 0
                continue
            taken = (chains.get((other, best), 0) if other[1] == a else 0) + (chains.get((best, other), 0) if other[0] == b else 0)
            least[other] -= taken
            if other in touched or best in touched or a == b or (other[1] == a and other[0] == b):
                touched.add(other)
            elif taken:
                most[other] -= taken
                touched.add(other)
    return out


def word_types(df: DataFrame, words: Column) -> DataFrame:
    """``w, n``: every distinct word that is not empty, and how often it occurs."""
    return df.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("w <> ''")


def train_merges(df: DataFrame, words: Column, n_merges: int, look: int = LOOK) -> tuple[list[str], list[Pair]]:
    """Characters and the first ``n_merges`` byte-pair merges of the words of ``df`` (fewer, if no pair is left).

    The best pair is the most frequent, ties by its symbols. The types are packed into blocks of numbered
    symbols, so that a round goes over arrays. It writes the blocks and the changes of the pair counts to the
    shared folder and removes the round before; the driver sees ``look`` pairs and the triples that those share.
    As soon as all types together have at most ``WHOLE`` symbols, one task does the rest of the merges.
    """
    spark = df.sparkSession
    # As many files as tasks can run, so that small tables are worked on by all of them.
    done = stored(word_types(df, words).repartition(spark.sparkContext.defaultParallelism, "w").mapInPandas(_pack, _ROUND))
    alphabet = sorted(r[0] for r in done.where("kind = 4").select("x").distinct().collect())
    merges: list[Pair] = []
    made: dict[str, None] = {}
    looked: list[Pair] = []
    counts = None
    for number in itertools.count():
        if len(merges) >= n_merges:
            break
        if number % EVERY == 0 and (done.where("kind = 0").agg(F.sum(F.length("symbols"))).first()[0] or 0) <= 4 * WHOLE:
            rest = done.where("kind = 0").select("symbols", "counts").coalesce(1).mapInPandas(_finish(list(made), n_merges - len(merges)), "at int, a string, b string")
            merges += [(r.a, r.b) for r in sorted(rest.collect())]
            break
        moved = done.where("kind = 1").select("a", "b", "n")
        if counts is not None:
            moved = counts.unionByName(moved)
        old, counts = counts, stored(moved.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"))
        if old is not None:
            discard(old)
        best = counts.orderBy(F.desc("n"), "a", "b").limit(look + 1).collect()
        ranked = [(r.a, r.b, r.n) for r in best[:look]]
        limit = (-best[look].n, best[look].a, best[look].b) if len(best) > look else None
        bound, chains, beside = _around(done, looked, ranked[-1][2] if ranked else 0)
        batch = decided(ranked, limit, bound, chains, n_merges - len(merges))
        if not batch:
            break
        merges += batch
        if len(merges) >= n_merges:
            break
        made |= dict.fromkeys(a + b for a, b in batch)
        gone = set(batch)
        # The pairs that the batch creates, as far as they can be among the best, are looked at as well.
        new = sorted((-n, (x, a + b) if kind == 2 else (a + b, x)) for a, b in batch for kind, x, n in beside.get((a, b), ()))
        looked = list(dict.fromkeys([(a, b) for a, b, _ in ranked if (a, b) not in gone] + [p for _, p in new[:look]]))
        before, done = done, stored(done.where("kind = 0").mapInPandas(_round(batch, looked, list(made)), _ROUND))
        discard(before)
    for table in (done, counts):
        if table is not None:
            discard(table)
    return alphabet, merges


def _around(done: DataFrame, looked: list[Pair], floor: int) -> tuple[dict[Pair, int], dict[tuple[Pair, Pair], int], dict[Pair, list]]:
    """Of each looked-at pair the largest count of a triple around it, the triples that two of them share, and
    what stands beside it (before: 2, after: 3) ``floor`` times or more."""
    if not looked:
        return {}, {}, {}
    sums = done.where("kind > 1").groupBy("kind", "a", "b", "x").agg(F.sum("n").alias("n"))
    pairs = F.broadcast(done.sparkSession.createDataFrame(looked, "x string, a string")).withColumn("own", F.lit(True))
    # A triple before a pair is shared if its first two symbols are a looked-at pair as well: at most ``look`` squared
    # rows. A triple of ``floor`` occurrences has two of the best pairs.
    marked = sums.join(pairs, ["x", "a"], "left")
    listed = F.collect_list(F.when((F.col("own") & (F.col("kind") == 2)) | (F.col("n") >= floor), F.struct("kind", "x", "n", "own")))
    rows = marked.groupBy("a", "b").agg(F.max("n").alias("most"), listed.alias("listed")).collect()
    bound = dict.fromkeys(looked, 0) | {(r.a, r.b): r.most for r in rows}
    chains = {((s.x, r.a), (r.a, r.b)): s.n for r in rows for s in r.listed if s.own and s.kind == 2}
    return bound, chains, {(r.a, r.b): [(s.kind, s.x, s.n) for s in r.listed if s.n >= floor] for r in rows}


class Segmenter(dict):
    """Word -> ids of its symbols by the merges; remembers a bounded number of words."""

    def __init__(self, alphabet: list[str], merges: list[Pair], first_id: int, unknown: int, remember: int = 1 << 18):
        super().__init__()
        self.ranks = {p: i for i, p in enumerate(merges)}
        self.ids = {s: first_id + i for i, s in enumerate(dict.fromkeys([*alphabet, *(a + b for a, b in merges)]))}
        self.merges, self.unknown, self.remember = merges, unknown, remember

    def symbols(self, word: str) -> list[str]:
        """Symbols of a word: the earliest merge first, as often as one applies."""
        out = list(word)
        while len(out) > 1:
            best = min((self.ranks.get(p, len(self.merges)) for p in zip(out, out[1:])), default=len(self.merges))
            if best == len(self.merges):
                break
            out = merged(out, self.merges[best])
        return out

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.remember:
            self.clear()
        self[word] = found = [self.ids.get(s, self.unknown) for s in self.symbols(word)]
        return found
