"""Hashes of many byte or token ranges at once, in numpy.

Two kinds. ``Prefix`` gives polynomial hashes of any range in constant time; they are linear, so unlike ranges can be made
to agree, and they only choose minimizers. What decides whether texts are equal comes in two lanes of 64 bits that
share no constant and stir after each 8 bytes or token, so that ranges agree in both by chance only.
"""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(7)
#: Numbers for bytes, one table a lane.
BYTE = _rng.integers(0, 2**64, (2, 256), np.uint64)
_SEED = _rng.integers(0, 2**64, 2, np.uint64)
_STEP = _rng.integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shift, factor, shift, factor, shift of each lane; any odd factors that spread the bits do.
_STIR = [[np.uint64(x) for x in lane] for lane in ((31, 0x7FB5D329728EA185, 27, 0x81DADEF4BC2DD44D, 33), (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31))]
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes from which on a range is hashed alone.
LONG = 256

_MUL = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def stirred(x: np.ndarray, lane: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers that is not linear in any of its bits."""
    a, p, b, q, c = _STIR[lane]
    x = (x ^ (x >> a)) * p
    x = (x ^ (x >> b)) * q
    return x ^ (x >> c)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """2 x ranges: both lanes of each byte range of ``data``."""
    n = end - start
    out = _SEED[:, None] ^ n.astype(np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    on = np.flatnonzero(n <= LONG)
    done = 0
    while len(on):
        left = n[on] - done
        x = eights[start[on] + done] & _MASK[np.minimum(left, 8)]
        out[0, on] = stirred(out[0, on] ^ x, 0)
        out[1, on] = stirred(out[1, on] + x, 1)
        done += 8
        on = on[left > 8]
    for i in np.flatnonzero(n > LONG):
        out[:, i] ^= np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def span_hashes(tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """2 x spans: both lanes of ``size`` tokens each; ``tokens``: 2 x tokens."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    h = _SEED[:, None] ^ size.astype(np.uint64)
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))  # spans of more than k tokens
        x = tokens[:, start[:m] + k]
        h[0, :m] = stirred(h[0, :m] ^ x[0], 0)
        h[1, :m] = stirred(h[1, :m] + x[1], 1)
    out = np.empty_like(h)
    out[:, order] = h
    return out


def window_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """2 x windows: both lanes of all windows of ``n`` tokens, by doubling; two overlapping halves make up the whole."""
    lanes = []
    for lane, x in enumerate(tokens):
        have = 1
        while 2 * have <= n:
            x = stirred((x[:-have] * _STEP[lane]) ^ x[have:], lane)
            have *= 2
        lanes.append(stirred((x[: len(x) - (n - have)] * _STEP[lane]) ^ x[n - have :], lane))
    return np.array(lanes)


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if (which, size) not in _powers:
        m = int(_MUL[which])
        with np.errstate(over="ignore"):
            both = []
            for x in (m, pow(m, -1, 2**64)):
                p = np.full(size, x, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _powers[which, size] = both[0], both[1]
    p, q = _powers[which, size]
    return p[:n], q[:n]


class Prefix:
    """Polynomial hashes of any token range of ``t`` in constant time. Not for telling texts apart."""

    def __init__(self, t: np.ndarray, which: int):
        p, self.inv = _power(which, len(t) + 1)
        self.sums = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(t * p[: len(t)], out=self.sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of every range of n tokens."""
        return stirred((self.sums[n:] - self.sums[:-n]) * self.inv[: len(self.sums) - n])
