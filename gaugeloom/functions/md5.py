"""MD5 of many short texts at once, as numpy steps over all of them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np

_LEFT = [np.uint32(x) for x in [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4]
_RIGHT = [np.uint32(32 - x) for x in _LEFT]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def digest_parts(words: list, shape: tuple) -> list[np.ndarray]:
    """The four numbers in [0, 2^32) that an MD5 in hexadecimal digits holds, for a shape of texts of one block.

    words: the block's 16 little-endian words, each an array of uint32 that can be repeated to the shape, or a number where all texts have the same.
    """
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
            g = 7 * i % 16
        np.add(f, a, f)
        word, same = words[g], _SINES[i]
        if isinstance(word, np.ndarray):
            np.add(f, word, f)
        else:
            same = (same + word) & 0xFFFFFFFF
        np.add(f, np.uint32(same), f)
        np.left_shift(f, _LEFT[i], turned)
        np.right_shift(f, _RIGHT[i], f)
        np.bitwise_or(f, turned, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    for x, start in zip((a, b, c, d), _START):
        np.add(x, np.uint32(start), x)
    return [x.byteswap(inplace=True) for x in (a, b, c, d)]


def numbered(prefixes: list[str], first: int, last: int, at_once: int = 131_072) -> Iterator[tuple[tuple[str, ...], list[np.ndarray]]]:
    """``digest_parts`` of each prefix followed by each whole number from first to last - 1.

    Comes in pieces of about ``at_once`` texts: a few prefixes, the arrays' rows, with numbers of equal length, their columns in rising order.
    """
    while first < last:
        length = len(str(first))
        numbers = np.arange(first, min(last, 10**length), dtype=np.int64)
        digits = [(numbers // 10 ** (length - 1 - j) % 10 + 48).astype(np.uint32) for j in range(length)]
        for size, alike in itertools.groupby(prefixes, lambda p: len(p.encode())):
            end = size + length
            if end > 55:
                raise ValueError(f"a text of {end} bytes is longer than a block of MD5 holds")
            words: list = [0] * 16
            for j, digit in enumerate(digits, size):
                words[j // 4] = words[j // 4] + (digit << np.uint32(8 * (j % 4)))
            words[end // 4] = words[end // 4] + np.uint32(0x80 << 8 * (end % 4)) if end % 4 else 0x80
            words[14] = 8 * end
            for some in itertools.batched(alike, max(1, at_once // len(numbers))):
                own = list(words)
                for w in range((size + 3) // 4):
                    own[w] = own[w] + np.array([[int.from_bytes(p.encode()[4 * w : 4 * w + 4], "little")] for p in some], np.uint32)
                yield some, digest_parts(own, (len(some), len(numbers)))
        first = int(numbers[-1]) + 1
