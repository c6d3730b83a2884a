"""Which pairs of texts are few edits apart, many pairs at once.

Bit-parallel edit distance in words of 64 rows, laid out so that each step of numpy takes one letter of every pair.
Only the words that hold cells at most the allowed edits off the diagonal are worked on, and pairs that can't
stay within them are left out as soon as a column shows it. Answers are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64
#: Pairs of a batch, and bytes of its table of letters.
PAIRS, TABLE_BYTES = 2048, 16 << 20
#: Pairs for each word in a column below which a batch costs more than its pairs one by one.
LEAST = 8
#: Shares of the letters after which pairs are looked at for being too far apart.
LOOKS = (0.26, 0.32, 0.5, 0.7)


def _least(plus: np.ndarray, minus: np.ndarray, bottom: np.ndarray, first: int, j: int, over: np.ndarray) -> np.ndarray:
    """Least edits that column ``j`` allows, by its words below row ``first``; ``over`` is how many more letters than rows are to come."""
    words = len(plus)
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little").view(np.int8)
    here = np.cumsum(bits(plus) - bits(minus), axis=1, dtype=np.int16)
    here += (bottom - here[:, -1]).astype(np.int16)[:, None]
    row = np.arange(first + 1, first + 64 * words + 1, dtype=np.int16)
    here += np.abs(row[None, :] + over.astype(np.int16)[:, None])
    least = here.min(axis=1)
    return least if first else np.minimum(least, j + np.abs(over))


def _letters(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points numbered from 0, and how many there are."""
    known = np.zeros(int(points.max()) + 1, bool)
    known[points] = True
    number = np.cumsum(known)
    return (number - 1)[points], int(number[-1])


def _batch(xs: list[np.ndarray], ys: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether each pair is at most so many edits apart; of each pair ``xs`` is the shorter text, and the longest of ``ys`` is first."""
    pairs, m, n = len(xs), np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    code, letters = _letters(np.concatenate([*xs, *ys]))
    words, longest, k = int(m.max() + 63) >> 6, int(n[0]), int(most.max())
    row = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    table = np.zeros((words, pairs * letters), U)
    np.add.at(table.reshape(-1), (row >> 6) * (pairs * letters) + np.repeat(np.arange(pairs) * letters, m) + code[: len(row)], U(1) << (row & 63).astype(U))
    letter = np.zeros((longest, pairs), np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    letter[at, np.repeat(np.arange(pairs), n)] = code[len(row) :] + np.repeat(np.arange(pairs) * letters, n)
    plus, minus = np.full((words, pairs), ~U(0)), np.zeros((words, pairs), U)
    bottom = np.zeros(pairs, np.int64)  # edits at the end of the last word worked on
    out, who, last = np.zeros(pairs, bool), np.arange(pairs), (m - 1) >> 6
    beyond = np.where(m & 63, ~U(0) << (m & 63).astype(U), U(0))
    room = np.empty((7, pairs), U)
    one, up = U(1), U(63)
    looks = {int(x * longest) for x in LOOKS} if longest >= 128 else ()
    hi = -1
    for j in range(1, longest + 1):
        if not len(who):
            break
        c = len(who)
        lo, now = (max(j - k, 1) - 1) >> 6, min(words - 1, (j + k - 1) >> 6)
        bottom += 64 * (now - hi)
        hi = now
        eq, xv, xh, ph, mh, pin, min_ = room[:, :c]
        pin[:], min_[:] = 1, 0
        for w in range(lo, hi + 1):
            p, q = plus[w], minus[w]
            np.take(table[w], letter[j - 1], out=eq, mode="clip")
            np.bitwise_or(eq, q, out=xv)
            np.bitwise_or(eq, min_, out=eq)
            np.bitwise_and(eq, p, out=xh)
            np.add(xh, p, out=xh)
            np.bitwise_xor(xh, p, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_or(xh, p, out=ph)
            np.invert(ph, out=ph)
            np.bitwise_or(ph, q, out=ph)
            np.bitwise_and(p, xh, out=mh)
            np.right_shift(ph, up, out=eq)
            np.right_shift(mh, up, out=xh)
            np.left_shift(ph, one, out=ph)
            np.bitwise_or(ph, pin, out=ph)
            np.left_shift(mh, one, out=mh)
            np.bitwise_or(mh, min_, out=mh)
            pin, eq, min_, xh = eq, pin, xh, min_
            np.bitwise_or(xv, ph, out=p)
            np.invert(p, out=p)
            np.bitwise_or(p, mh, out=p)
            np.bitwise_and(ph, xv, out=q)
        bottom += pin.view(np.int64)
        bottom -= min_.view(np.int64)
        keep = None
        if n[-1] == j:
            ended = np.arange(np.searchsorted(-n, -j), c)
            w, apart = last[ended], bottom[ended]
            for x in range(int(w.min()), hi + 1):
                below = np.where(w < x, ~U(0), np.where(w == x, beyond[ended], U(0)))
                apart += np.bitwise_count(minus[x, ended] & below)
                apart -= np.bitwise_count(plus[x, ended] & below)
            out[who[ended]] = apart <= most[ended]
            keep = np.arange(ended[0])
        if j in looks:
            left = np.arange(c) if keep is None else keep
            if len(left):
                keep = left[_least(plus[lo : hi + 1, left], minus[lo : hi + 1, left], bottom[left], 64 * lo, j, (n - j - m)[left]) <= most[left]]
        if keep is not None:
            plus, minus, letter = (np.ascontiguousarray(x[:, keep]) if j in looks else x[:, : len(keep)] for x in (plus, minus, letter))
            who, last, beyond, most, n, m, bottom = (x[keep] for x in (who, last, beyond, most, n, m, bottom))
    return out


def within(a: list[bytes], b: list[bytes], allowed: Callable[[int], int], longest: int, alone: Callable[[str, str, int], int]) -> np.ndarray:
    """Whether the texts of each pair are at most ``allowed`` (longer length in code points) edits apart.

    Pairs whose shorter text is over ``longest``, and few pairs of a length, are left to ``alone`` (two texts, edits allowed).
    """
    out = np.zeros(len(a), bool)
    known: dict[bytes, np.ndarray] = {}

    def points(x: bytes) -> np.ndarray:
        if (p := known.get(x)) is None:
            p = known[x] = np.frombuffer(x, np.uint8) if x.isascii() else np.frombuffer(x.decode().encode("utf-32-le"), np.uint32)
        return p

    rest: list[tuple[int, int, int, np.ndarray, np.ndarray, int]] = []
    for k, (x, y) in enumerate(zip(map(points, a), map(points, b))):
        if len(x) > len(y):
            x, y = y, x
        most, m = allowed(len(y)), len(x)
        if len(y) - m > most:
            continue
        differ = np.flatnonzero(x != y[:m])
        i = int(differ[0]) if len(differ) else m
        x, y = x[i:], y[i:]
        m -= i
        differ = np.flatnonzero(x[::-1] != y[len(y) - m :][::-1])
        end = m - (int(differ[0]) if len(differ) else m)
        y = y[: len(y) - m + end]
        if len(y) <= most:
            out[k] = True
        elif end:
            rest.append(((end + 63) >> 6, len(y), k, x[:end], y, most))
    rest.sort(key=lambda p: p[:3])
    text = lambda x: x.tobytes().decode("latin-1" if x.dtype == np.uint8 else "utf-32-le")
    while rest:
        words = rest[-1][0]
        size = max(1, min(PAIRS, TABLE_BYTES // (8 * 64 * words)))
        part = [p for p in rest[-size:] if 2 * p[0] >= words]
        del rest[len(rest) - len(part) :]
        if words > longest >> 6 or len(part) < LEAST * words:
            for p in part:
                out[p[2]] = alone(text(p[3]), text(p[4]), p[5]) <= p[5]
            continue
        step = max(16, min(len(part), TABLE_BYTES // (8 * words * _letters(np.concatenate([x for p in part for x in p[3:5]]))[1])))
        part.reverse()
        part.sort(key=lambda p: -p[1])
        for at in range(0, len(part), step):
            some = part[at : at + step]
            out[[p[2] for p in some]] = _batch([p[3] for p in some], [p[4] for p in some], np.array([p[5] for p in some]))
    return out
