"""Counting quotient filters that keep every bit of their keys.

A key is permuted invertibly; the upper bits of the result, the quotient, are its home slot, and all other bits, the
remainder, are stored.  Keys of one quotient form a run in ascending order, as near to their home as runs before allow.
Bit vectors tell which quotients have a run, where runs end and which slots hold a remainder (Pandey et al., 2017).  A
count over 1 takes slots of its own behind its remainder, marked in one more vector, that hold its digits.  As nothing
of the key is lost, the filter is a compact sorted map from keys to counts; filters merge like sorted lists.

Keys are pairs of unsigned integers (left, right) of 2w and w bits; all of NumPy's work is on whole arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Keys of one word have at most so many bits; longer ones are kept in two.
WORD = 64


def _mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x + U(salt)) * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        return h ^ (h >> U(32))


def permute(left: np.ndarray, right: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of 2w and w bits: four rounds in which each half is blurred by the other."""
    for k in (1, 2):
        right = right ^ (_mix(left, k) & _mask(w))
        left = left ^ (_mix(right, k + 7) & _mask(2 * w))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of permute()."""
    for k in (2, 1):
        left = left ^ (_mix(right, k + 7) & _mask(2 * w))
        right = right ^ (_mix(left, k) & _mask(w))
    return left, right


def sorted_counts(left: np.ndarray, right: np.ndarray, w: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their numbers, or with the sums of their counts."""
    if 3 * w <= WORD:
        key = left << U(w) | right
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        left, right = key[first] >> U(w), key[first] & _mask(w)
        total = len(key)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        total = len(left)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, total), bool), (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        left, right = left[first], right[first]
    sums = np.diff(np.append(first, total)) if counts is None else np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    return left, right, sums.astype(np.int64)


def _bytes_of(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of each number, (n, size)."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(len(x), 8)[:, :size]


def _number(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view("<u8").ravel().astype(U)


def _remainders(left: np.ndarray, right: np.ndarray, rest: int, w: int) -> np.ndarray:
    """The low rest bits of left and all of right, as bytes of each key."""
    if rest + w <= WORD:
        return _bytes_of((left & _mask(rest)) << U(w) | right, -(-(rest + w) // 8))
    return np.concatenate([_bytes_of(left & _mask(rest), -(-rest // 8)), _bytes_of(right, -(-w // 8))], axis=1)


def _halves(rows: np.ndarray, rest: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of _remainders()."""
    if rest + w <= WORD:
        x = _number(rows)
        return x >> U(w), x & _mask(w)
    return _number(rows[:, : -(-rest // 8)]), _number(rows[:, -(-rest // 8) :])


def _size(rest: int, w: int) -> int:
    return -(-(rest + w) // 8) if rest + w <= WORD else -(-rest // 8) + -(-w // 8)


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, w: int, prefix: int) -> bytes:
    """The filter of distinct permuted keys in ascending order; all of them share their first prefix bits."""
    n = len(left)
    q = min(max(n - 1, 1).bit_length(), 2 * w - prefix)
    quotient = (left >> U(2 * w - prefix - q)) & _mask(q)
    rest = 2 * w - prefix - q  # bits of the left half that stay in the remainder, before all of the right half
    size = _size(rest, w)
    # Slots of counts over 1: as many digits of a slot's width as the count has.
    digit_bits = 8 * min(size, 7)
    digits = np.zeros(n, np.int64)
    more = counts > 1
    left_over = np.where(more, counts, 0).astype(U)
    while (some := left_over > 0).any():
        digits[some] += 1
        left_over = left_over >> U(digit_bits)
    slots = 1 + digits
    # A key begins at its quotient's home, or behind all slots of the keys before it.
    before = np.cumsum(slots) - slots
    at = np.maximum.accumulate(quotient.astype(np.int64) - before) + before if n else np.zeros(0, np.int64)
    total = int(at[-1] + slots[-1]) if n else 0
    last_of_run = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    occupied, run_end, counter = np.zeros(1 << q, bool), np.zeros(total, bool), np.zeros(total, bool)
    occupied[quotient.astype(np.int64)] = True
    run_end[(at + digits)[last_of_run]] = True
    body = np.zeros((total, size), np.uint8)
    body[at] = _remainders(left, right, rest, w)
    where, value = np.flatnonzero(more), counts[more].astype(U)
    k = 1
    while len(where):
        counter[at[where] + k] = True
        body[at[where] + k, : digit_bits // 8] = _bytes_of(value & _mask(digit_bits), digit_bits // 8)
        value = value >> U(digit_bits)
        where, value, k = where[value > 0], value[value > 0], k + 1
    used = np.zeros(total, bool)
    used[at] = True
    head = np.array([q, total, n], "<u8").tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in (occupied, run_end, counter, used)) + body.tobytes()


def decode(data: bytes, w: int, prefix: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) in ascending order of the filter whose keys begin with the bits of first."""
    q, total, n = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at, parts = 24, []
    for bits in (1 << q, total, total, total):
        size = -(-bits // 8)
        parts.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=bits).astype(bool))
        at += size
    occupied, run_end, counter, used = parts
    rest = 2 * w - prefix - q
    body = np.frombuffer(data, np.uint8, offset=at).reshape(total, _size(rest, w))
    digit_bits = 8 * min(_size(rest, w), 7)
    place = np.flatnonzero(used)
    # The k-th run that ends is that of the k-th occupied quotient.
    run = np.cumsum(run_end) - run_end
    quotient = np.flatnonzero(occupied)[run[place]].astype(U)
    rows = body[place]
    left = U(first) << U(2 * w - prefix) if prefix else U(0)
    low, right = _halves(rows, rest, w)
    left = left | quotient << U(rest) | low
    counts = np.ones(n, np.int64)
    k = 1
    open_ = np.flatnonzero(np.append(counter, False)[place + 1])
    counts[open_] = 0
    while len(open_):
        counts[open_] += (_number(body[place[open_] + k, : digit_bits // 8]) << U(digit_bits * (k - 1))).astype(np.int64)
        k += 1
        open_ = open_[np.append(counter, np.zeros(k, bool))[place[open_] + k]]
    return left, right, counts
