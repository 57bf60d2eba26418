"""Claims beside all moves of their pool, in arrays. Pools of bounded size lie whole in one task, so pairs are never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of whole pools that are read at a time, and pairs that are scored at a time.
CHUNK_ROWS, PAIRS_AT_ONCE = 65_536, 1 << 19
#: Points in hundredths, in the order of the options in matching.scored_pairs; sums of them are exact.
PLAYER, CLUB, SEASON, DIRECTION, KIND = (45, 25, 15), (20, 10), (10,), (8, -12), (5, 3, -5)
DATE, FEE = ((7, 10), (30, 8), (90, 5), (180, 2)), ((0.8, 8), (0.5, 4))
_BY_GAP = np.array([next((points for days, points in DATE if gap <= days), 0) for gap in range(DATE[-1][0] + 2)], dtype=np.int16)
_NEVER = 10**9


def _pools_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of `h`, which ascends."""
    held, n, limit = [], 0, CHUNK_ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        h = t["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), len(h) - cut
        limit = max(CHUNK_ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    """Numbers of equal values (-1: null), and the values."""
    coded = _whole(column).dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _number(values: pa.Array, x: str) -> int:
    """The number of a value, -2 if it is not there."""
    at = pc.index(values, x).as_py()
    return at if at >= 0 else -2


class _Names:
    """Of each row: number of the name, of the last word (-1: short or none), and its distinct words: how many, where, a mask."""

    def __init__(self, column) -> None:
        names = _whole(column).fill_null("")
        self.name, values = _codes(names)
        self.name[self.name == _number(values, "")] = -1
        lists = pc.split_pattern(names, " ")
        coded = lists.flatten().dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        said = size[word] > 0
        row, word = row[said], word[said]
        first = np.sort(np.unique(row * (len(size) + 1) + word, return_index=True)[1])
        row, self.word = row[first], word[first]
        self.n = np.bincount(row, minlength=len(names)).astype(np.int16)
        self.start = np.concatenate(([0], np.cumsum(self.n, dtype=np.int64)))[:-1]
        some = self.n > 0
        self.last = np.full(len(names), -1, dtype=np.int64)
        self.mask = np.zeros(len(names), dtype=np.uint64)
        if some.any():
            last = self.word[self.start[some] + self.n[some] - 1]
            self.last[some] = np.where(size[last] >= 4, last, -1)
            bit = np.uint64(1) << ((self.word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
            self.mask[some] = np.bitwise_or.reduceat(bit, self.start[some])

    def maybe(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which pairs may have a player signal: words whose bits the other side lacks are not shared."""
        a, b, n, k = self.mask[c], self.mask[m], self.n[c], self.n[m]
        shared = np.minimum(n - np.bitwise_count(a & ~b), k - np.bitwise_count(b & ~a))
        return ((shared > 0) & (3 * shared >= n + k)) | ((self.last[c] == self.last[m]) & (self.last[c] >= 0))

    def signals(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Number of each pair's player signal, -1 for none."""
        n, k = self.n[c].astype(np.int64), self.n[m].astype(np.int64)
        pairs = n * k
        i = np.repeat(np.arange(len(c)), pairs)
        at = np.arange(len(i)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        same = self.word[self.start[c][i] + at // k[i]] == self.word[self.start[m][i] + at % k[i]]
        shared = np.bincount(i[same], minlength=len(c))
        fuzzy = (shared > 0) & (3 * shared >= n + k)
        surname = (self.last[c] == self.last[m]) & (self.last[c] >= 0)
        exact = (self.name[c] == self.name[m]) & (self.name[c] >= 0)
        return np.where(exact, 0, np.where(surname, 1, np.where(fuzzy, 2, -1))).astype(np.int8)


class _Facts:
    """What rows of a chunk say besides names. Fees: null counts as none; NaN is the largest number, as it is in SQL."""

    def __init__(self, t: pa.Table) -> None:
        number = lambda c, none: _whole(t[c]).fill_null(none).to_numpy(zero_copy_only=False)
        self.side = number("side", 0)
        day = number("day", _NEVER).astype(np.int64)
        self.day = np.where((day == _NEVER) & (self.side == 1), -_NEVER, day)
        self.way, ways = _codes(t["direction"])
        self.told = (self.way == _number(ways, "in")) | (self.way == _number(ways, "out"))
        self.kind, kinds = _codes(t["kind"])
        self.typed = (self.kind >= 0) & (self.kind != _number(kinds, "unclear"))
        self.loan = number("loan", False)
        self.lent = self.kind == _number(kinds, "loan")
        self.fee = number("fee", 0.0)
        self.paid = ~(self.fee <= 0)
        self.club, self.season = number("o1", -1).astype(np.int8), number("o2", -1).astype(np.int8)
        self.base = np.append(CLUB, 0)[self.club] + np.append(SEASON, 0)[self.season]

    def room(self, c: np.ndarray) -> np.ndarray:
        """The most that a move without a player signal can have."""
        return self.base[c] + DATE[0][1] + DIRECTION[0] * self.told[c] + KIND[0] * self.typed[c] + FEE[0][1] * self.paid[c]

    def scores(self, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Points of pairs without those of the player, and the options of date, direction, kind and fee (-1: none)."""
        near = _BY_GAP[np.minimum(np.abs(self.day[c] - self.day[m]), len(_BY_GAP) - 1)]
        told, typed = self.told[c], self.typed[c]
        way = np.where(told, np.where(self.way[c] == self.way[m], 0, 1), -1)
        kind = np.where(typed, np.where(self.kind[c] == self.kind[m], 0, np.where(self.lent[c] & self.loan[m], 1, 2)), -1)
        a, b = self.fee[c], self.fee[m]
        with np.errstate(all="ignore"):
            close = 1 - np.abs(a - b) / np.maximum(a, b)
        paid = self.paid[c] & self.paid[m]
        fee = np.where(paid & ~(close < FEE[0][0]), 0, np.where(paid & ~(close < FEE[1][0]), 1, -1))
        points = self.base[c] + near + np.append(DIRECTION, 0)[way] + np.append(KIND, 0)[kind] + np.append([p for _, p in FEE], 0)[fee]
        return points, [np.where(near > 0, 0, -1), way, kind, fee]


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of claims with about PAIRS_AT_ONCE pairs."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
        yield i, j
        i = j


def _scored(t: pa.Table, close: int) -> dict[str, np.ndarray] | None:
    """Rows of claims (see scanned), as numbers of rows of t and points; -1 for none."""
    rank = np.empty(t.num_rows, dtype=np.int64)
    rank[pc.sort_indices(_whole(t["move_id"]), null_placement="at_start").to_numpy()] = np.arange(t.num_rows)
    part = t["part"].to_numpy()
    keys = (t["h"].to_numpy(), _codes(t["club"])[0], _codes(t["season"])[0], part)
    facts, names = _Facts(t), _Names(t["name"])
    order = np.lexsort((rank, facts.side, *keys[::-1]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    pool = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    moves = np.bincount(pool, weights=facts.side[order] == 0, minlength=len(start)).astype(np.int64)
    at = np.flatnonzero((facts.side[order] == 1) & (moves[pool] > 0))
    claims, sizes, firsts = order[at], moves[pool[at]], start[pool[at]]
    found = []
    for i, j in _blocks(sizes):
        k = sizes[i:j]
        turn = np.repeat(np.arange(j - i), k)
        begin = np.cumsum(k) - k
        place = np.arange(len(turn)) - np.repeat(begin - firsts[i:j], k)  # of a move in `order`: by move_id inside its pool
        c, m = claims[i:j][turn], order[place]
        sure = np.flatnonzero(names.maybe(c, m))
        signal = names.signals(c[sure], m[sure])
        sure, signal = sure[signal >= 0], signal[signal >= 0]
        points, options = facts.scores(c[sure], m[sure])
        points = points + np.array(PLAYER)[signal]
        best = np.lexsort((place[sure], -points, turn[sure]))
        owner = turn[sure][best]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
        second = first[np.append(owner, -1)[first + 1] == owner[first]] + 1
        none = lambda: np.full(j - i, -1, dtype=np.int64)
        out = {"claim": claims[i:j], "move": none(), "other": none(), **{x: np.full(j - i, np.iinfo(np.int32).min) for x in ("score", "next", "rival")}}
        w, top = owner[first], best[first]
        out["move"][w], out["score"][w], out["next"][owner[second]] = m[sure[top]], points[top], points[best[second]]
        for x, values in zip(("o0", "o1", "o2", "o3", "o4", "o5", "o6"), (signal, facts.club[c[sure]], facts.season[c[sure]], *options)):
            out[x] = none()
            out[x][w] = values[top]
        # Moves without a player signal count where they may come within `close` of the best named one of the pool.
        free = np.repeat((out["move"] < 0) | (facts.room(claims[i:j]) > out["score"] - close), k)
        free[sure] = False
        free = np.flatnonzero(free)
        if len(free):
            rivals, _ = facts.scores(c[free], m[free])
            both = (rivals.astype(np.int64) << 32) + (_NEVER - place[free])
            edge = np.flatnonzero(np.append(True, turn[free][1:] != turn[free][:-1]))
            most = np.maximum.reduceat(both, edge)
            out["rival"][turn[free][edge]], out["other"][turn[free][edge]] = most >> 32, order[_NEVER - (most & 0xFFFFFFFF)]
            far = (out["move"] >= 0) & (out["rival"] <= out["score"] - close)
            out["other"][far] = -1
        found.append({x: v[(out["move"] >= 0) | (out["other"] >= 0)] for x, v in out.items()})
    return {x: np.concatenate([f[x] for f in found]) for x in found[0]} if found else None


def scanned(close: int):
    """A function of Arrow batches with whole pools, ordered by h, to a row of each claim in each of its pools: the best move with a
    player signal (score, move_id, numbers of its signals), the score of the next such move, and the best move without one (other,
    other_id) where it may come within `close` hundredths of the best. Batches: h, side (0: move, 1: claim), club, season, part,
    claim_id, move_id, name (in its normal form), day, direction, kind, loan, fee, and of claims the options of club and season (o1, o2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pools_of(batches):
            rows = _scored(t, close)
            if rows is None or not len(rows["claim"]):
                continue
            taken = lambda column, at: _whole(t[column]).take(pa.array(at, mask=at < 0))
            points = lambda x, none: pa.array(rows[x] / 100.0, mask=none)
            unnamed, alone = rows["move"] < 0, rows["other"] < 0
            columns = {"claim_id": taken("claim_id", rows["claim"]), "move_id": taken("move_id", rows["move"]), "score": points("score", unnamed), "next": points("next", rows["next"] < -1000)}
            columns |= {f"_o{i}": pa.array(rows[f"o{i}"].astype(np.int8), mask=rows[f"o{i}"] < 0) for i in range(7)}
            yield pa.RecordBatch.from_pydict(columns | {"other": points("rival", alone), "other_id": taken("move_id", rows["other"])})

    return run
