"""Exact characteristic polynomials of integer matrices, their roots, and vectors of their null spaces.

For matrices that are small in rows and huge in digits: a symmetric d x d matrix of exact sums over any number of
rows. The polynomial is computed modulo primes (reduction to Hessenberg form, then a recurrence) and put
together by Chinese remaindering; enough primes are taken to cover a bound of its coefficients, so it is exact.

All roots of a symmetric matrix are real, and for such polynomials the rule of signs counts exactly: as many
roots (with multiplicity) lie above a as the coefficients of p(x + a) change their sign. Bisection by that
count isolates any root by number, also multiple ones; once a root is alone, signs of p refine it. All
of it is integer arithmetic.
"""

from __future__ import annotations

import decimal
from decimal import Decimal

import numpy as np

#: Primes lie below this, so that products of two residues fit 64 bits.
PRIME_BITS = 31


def is_prime(n: int) -> bool:
    """Miller-Rabin, exact for n below 3.4e14 with these bases."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7, 11, 13, 17)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if n == base or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product exceeds twice the bound."""
    found, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial is larger: (1 + largest row sum)^d bounds their sum."""
    return (1 + max((sum(map(abs, row)) for row in matrix), default=0)) ** len(matrix)


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to this one modulo p with zeros below its first subdiagonal."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1][None, :]) % p
        # The other side of the similarity: the pivot's column gains the others times their factors. Products are
        # reduced before they are added; a sum of 2^31 of them would still fit.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor[None, :] % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - A) modulo p, constant first."""
    h = hessenberg(matrix, p)
    d = len(h)
    known = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: polynomial of the leading k x k part
    known[0, 0] = 1
    for k in range(d):
        here = np.zeros(d + 1, dtype=np.int64)
        here[1:] = known[k, :-1]
        here = (here - int(h[k, k]) * known[k]) % p
        product = 1
        weights = np.zeros(k, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * product % p
        if k:
            here = (here - (weights[:, None] * known[:k] % p).sum(axis=0)) % p
        known[k + 1] = here
    return known[d]


def remaindered(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The integers of smallest size with these residues (a row per prime)."""
    product = 1
    for p in primes:
        product *= p
    parts = [product // p * pow(product // p, -1, p) for p in primes]
    out = []
    for column in zip(*residues):
        value = sum(r * part for r, part in zip(column, parts)) % product
        out.append(value - product if value > product // 2 else value)
    return out


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only lie above the integer a."""
    c = list(poly)
    n = len(c) - 1
    for i in range(n):  # Taylor shift by repeated synthetic division
        for j in range(n - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    n = len(poly) - 1
    return [c << bits * (n - i) for i, c in enumerate(poly)]


def value(poly: list[int], a: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * a + c
    return out


def zero_roots(poly: list[int]) -> int:
    """How often zero is a root."""
    return next((i for i, c in enumerate(poly) if c), len(poly) - 1)


def root(poly: list[int], number: int, top: int, digits: int = 50) -> tuple[int, int, int, int]:
    """The root of this number (1: largest) of a polynomial with real roots, none above ``top`` or below 0.

    Returns (low, bits, first, count): low / 2^bits <= root <= (low + 1) / 2^bits, to ``digits`` digits, and the
    numbers of the roots that lie in there: ``count`` of them from ``first`` on. More than one are equal or
    closer than that.
    """
    low, high = -1, max(top, 1)  # roots above low: at least number; above high: fewer
    bits, above_low, above_high = 0, len(poly) - 1, 0
    p = poly
    fine = int(digits * 3.33) + 1
    while above_low - above_high > 1 or low < 0:
        if high - low <= 1:
            # The root is known to 1 / 2^bits; stop when that is fine enough for its size.
            if low > 0 and low.bit_length() > fine or bits > 4 * fine:
                return max(low, 0), bits, above_high + 1, above_low - above_high
            bits += 16
            low, high, p = low << 16, high << 16, scaled(poly, bits)
        middle = (low + high) // 2
        above = roots_above(p, middle)
        if above >= number:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    # One root in (low, high]: right of it p has the sign of (-1)^(roots above).
    right = 1 if above_high % 2 == 0 else -1
    while True:
        while high - low > 1:
            middle = (low + high) // 2
            v = value(p, middle)
            if v == 0:
                low = middle
                break
            if (v > 0) == (right > 0):
                high = middle
            else:
                low = middle
        if low.bit_length() > fine:
            return low, bits, number, 1
        high = low + 1
        more = fine + 1 - low.bit_length()
        low, high, bits = low << more, high << more, bits + more
        p = scaled(poly, bits)


def _lu(m: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU in place with row pivots; a zero pivot becomes the smallest number that matters."""
    d = len(m)
    swaps = []
    largest = max((abs(x) for x in m.flat), default=Decimal(1)) or Decimal(1)
    tiny = largest.scaleb(-decimal.getcontext().prec + 2)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(m[k:, k])))
        swaps.append(pivot)
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        if k + 1 < d:
            m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
            m[k + 1 :, k + 1 :] = m[k + 1 :, k + 1 :] - m[k + 1 :, k][:, None] * m[k, k + 1 :][None, :]
    return m, swaps


def _solve(lu: np.ndarray, swaps: list[int], b: np.ndarray) -> np.ndarray:
    x, d = b.copy(), len(lu)
    for k, pivot in enumerate(swaps):  # rows of the factors were exchanged whole, so all exchanges come first
        if pivot != k:
            x[[k, pivot]] = x[[pivot, k]]
    for k in range(d):
        x[k + 1 :] = x[k + 1 :] - lu[k + 1 :, k] * x[k]
    for k in range(d - 1, -1, -1):
        x[k] = x[k] / lu[k, k]
        x[:k] = x[:k] - lu[:k, k] * x[k]
    return x


def null_vector(matrix: list[list[int]], low: int, bits: int, nth: int = 0, count: int = 1, digits: int = 80) -> list[Decimal]:
    """A unit vector of the null space of A - root I; of a root of multiplicity ``count`` the ``nth`` of a basis.

    Inverse iteration in decimals of many digits, from fixed starting vectors, each made orthogonal to the
    ones before it; the first entry of largest size is positive. So every caller gets the same basis.
    """
    with decimal.localcontext() as context:
        size = len(str(max((abs(x) for row in matrix for x in row), default=1)))
        context.prec = digits + size
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        mu = (Decimal(2 * low + 1) / Decimal(2)) / (Decimal(2) ** bits)
        d = len(matrix)
        m = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object).reshape(d, d)
        for i in range(d):
            m[i, i] -= mu
        lu, swaps = _lu(m)
        basis: list[np.ndarray] = []
        for which in range(nth + 1):
            x = np.array([Decimal(1) + Decimal((i * (which + 1) * 7 + which) % 11) / 7 for i in range(d)], dtype=object)
            for _ in range(4):
                for known in basis:
                    x = x - known * (known @ x)
                x = _solve(lu, swaps, x)
                x = x / max(abs(v) for v in x)
            for known in basis * 2:
                x = x - known * (known @ x)
            x = x / (x @ x).sqrt()
            if x[int(np.argmax(np.abs(x)))] < 0:
                x = -x
            basis.append(x)
        return [+v for v in basis[nth]]
