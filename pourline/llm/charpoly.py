"""Exact characteristic polynomials of symmetric integer matrices, their roots and null spaces.

``residues`` gives the polynomial modulo many primes at once (Hessenberg reduction with numpy, one
matrix a prime), ``combined`` joins residues by Chinese remaindering.  All roots are real, so
the sign changes of the coefficients of p(x + a) count the roots above a exactly, with multiplicity
(Budan and Descartes); ``roots_above_all`` isolates the largest roots so and then refines them by
the sign of p.  ``null_space`` solves for the vectors of a root with integers of fixed point.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: Primes are below 2**31, so that products fit 64 bits.
_TOP_PRIME = 1 << 31
#: Binary digits of a root behind the leading one, and digits of the eliminations.
ROOT_BITS, WORK_BITS = 220, 420


def primes(count: int) -> list[int]:
    """The largest primes below 2**31, falling."""
    sieve = np.ones(1 << 16, bool)
    sieve[:2] = False
    for k in range(2, 256):
        if sieve[k]:
            sieve[k * k :: k] = False
    small = np.flatnonzero(sieve)
    found: list[int] = []
    top = _TOP_PRIME
    while len(found) < count:
        low = top - (1 << 16)
        block = np.ones(1 << 16, bool)
        for k in small.tolist():
            block[(-low) % k :: k] = False
        found += (low + np.flatnonzero(block)).tolist()[::-1]
        top = low
    return found[:count]


def primes_needed(matrix: list[list[int]]) -> int:
    """So many primes that their product exceeds twice every coefficient of the polynomial of a positive semidefinite matrix.

    Its roots are not negative and add up to the trace, so every coefficient is at most (1 + trace / d) ** d.
    """
    d = len(matrix)
    trace = sum(matrix[k][k] for k in range(d))
    bits = d * (1 + -(-trace // d)).bit_length() + 2
    return -(-bits // 30)


def _inverse(values: np.ndarray, p: np.ndarray) -> np.ndarray:
    """values ** (p - 2) modulo p."""
    out, base, left = np.ones_like(values), values % p, p - 2
    while (left > 0).any():
        out = np.where(left & 1, out * base % p, out)
        base = base * base % p
        left = left >> 1
    return out


def residues(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each prime: one row a prime, constant term first."""
    d, k = len(matrix), len(moduli)
    p = np.array(moduli, np.int64)
    h = np.array([[[x % m for x in row] for row in matrix] for m in moduli], np.int64).reshape(k, d, d)
    all_k = np.arange(k)
    for j in range(d - 2):
        # Similar matrices: rows and columns change places alike, so that the pivot is not zero where any entry below is not.
        at = j + 1 + np.argmax(h[:, j + 1 :, j] != 0, axis=1)
        rows = h[all_k, at].copy()
        h[all_k, at] = h[:, j + 1]
        h[:, j + 1] = rows
        columns = h[all_k, :, at].copy()
        h[all_k, :, at] = h[:, :, j + 1]
        h[:, :, j + 1] = columns
        u = h[:, j + 2 :, j] * _inverse(h[:, j + 1, j], p)[:, None] % p[:, None]  # zero where the pivot is
        h[:, j + 2 :] = (h[:, j + 2 :] - u[:, :, None] * h[:, None, j + 1] % p[:, None, None]) % p[:, None, None]
        h[:, :, j + 1] = (h[:, :, j + 1] + (h[:, :, j + 2 :] * u[:, None, :] % p[:, None, None]).sum(2)) % p[:, None]
    # The polynomials of the leading blocks, each from those before.
    polys = np.zeros((d + 1, k, d + 1), np.int64)
    polys[0, :, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros((k, d + 1), np.int64)
        new[:, 1:] = polys[m - 1, :, :-1]
        new = (new - h[:, m - 1, m - 1][:, None] * polys[m - 1]) % p[:, None]
        below = np.ones(k, np.int64)
        for i in range(m - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new = (new - (h[:, i - 1, m - 1] * below % p)[:, None] * polys[i - 1]) % p[:, None]
        polys[m] = new
    return polys[d]


def combined(moduli: list[int], rows: list[list[int]]) -> list[int]:
    """The integers of least size with these residues, by pairs of moduli in a tree."""
    parts = [(m, list(r)) for m, r in zip(moduli, rows, strict=True)]
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            (m, a), (n, b) = parts[k], parts[k + 1]
            inverse = pow(m, -1, n)
            joined.append((m * n, [x + m * ((y - x) * inverse % n) for x, y in zip(a, b, strict=True)]))
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    m, values = parts[0]
    return [v - m if 2 * v > m else v for v in values]


def _above(poly: list[int], a: Fraction) -> int:
    """How many roots of a polynomial with real roots only are greater than a."""
    d = len(poly) - 1
    num, den = a.numerator, a.denominator
    c = [x * den ** (d - k) for k, x in enumerate(poly)]  # the polynomial of den * x
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: Fraction) -> int:
    num, den, value, power = a.numerator, a.denominator, 0, 1
    for x in reversed(poly):
        value = value * num + x * power
        power *= den
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity), falling, of the positive roots until ``count`` roots are listed; the last may go beyond it.

    Roots are right to ROOT_BITS binary digits; roots that agree to half as many are given as one with
    their number, since no eigenvectors in double precision tell them apart.
    """
    while poly and poly[0] == 0:
        poly = poly[1:]  # roots at zero
    d = len(poly) - 1
    if d < 1:
        return []
    bound = Fraction(1 << (-int(poly[d - 1])).bit_length())  # the sum of the roots, none of which is negative
    todo = [(Fraction(0), bound, d, 0)]  # (low, high, roots above low, roots above high]
    out: list[tuple[Fraction, int]] = []
    listed = 0
    while todo and listed < count:
        low, high, n_low, n_high = todo.pop()
        n = n_low - n_high
        if n == 0:
            continue
        width, near = high - low, high.numerator.bit_length() - high.denominator.bit_length()
        narrow = low > 0 and width * (1 << (ROOT_BITS // 2)) < Fraction(2) ** near
        if n == 1 and low > 0:
            out.append((_refined(poly, low, high), 1))
            listed += 1
        elif narrow:
            out.append(((low + high) / 2, n))
            listed += n
        else:
            middle = (low + high) / 2
            n_middle = _above(poly, middle)
            todo.append((low, middle, n_low, n_middle))
            todo.append((middle, high, n_middle, n_high))
    return out


def _refined(poly: list[int], low: Fraction, high: Fraction) -> Fraction:
    """The one root in (low, high], by halving on the sign of the polynomial."""
    end = _sign(poly, high)
    if end == 0:
        return high
    while (high - low) * (1 << ROOT_BITS) > high:
        middle = (low + high) / 2
        sign = _sign(poly, middle)
        if sign == 0:
            return middle
        if sign == end:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def null_space(matrix: list[list[int]], root: Fraction, count: int) -> list[list[float]]:
    """count orthonormal vectors of the matrix's eigenspace at a root, by inverse iteration in integers of fixed point.

    One elimination with row pivots of (matrix - root) serves every step; what the last pivots lack in size is
    what makes the iteration converge at once.
    """
    d = len(matrix)
    one = 1 << WORK_BITS
    scaled = (root.numerator << WORK_BITS) // root.denominator
    a = np.array([[(x << WORK_BITS) - (scaled if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], object).reshape(d, d)
    order, factors = list(range(d)), []
    for j in range(d):
        pivot = max(range(j, d), key=lambda i: abs(a[i, j]))
        if pivot != j:
            a[[j, pivot]] = a[[pivot, j]]
            for column in factors:
                column[j], column[pivot] = column[pivot], column[j]
            order[j], order[pivot] = order[pivot], order[j]
        if a[j, j] == 0:
            a[j, j] = 1  # the smallest step of the fixed point stands for an exact zero
        column = [0] * d
        for i in range(j + 1, d):
            column[i] = (a[i, j] << WORK_BITS) // a[j, j]
            if column[i]:
                a[i, j:] = a[i, j:] - (column[i] * a[j, j:]) // one
        factors.append(column)

    def solved(b: list[int]) -> list[int]:
        x = [b[k] for k in order]
        for j in range(d):
            if x[j]:
                column, head = factors[j], x[j]
                for i in range(j + 1, d):
                    x[i] -= (column[i] * head) >> WORK_BITS
        for j in range(d - 1, -1, -1):
            rest = x[j] - sum(int(a[j, k]) * x[k] for k in range(j + 1, d)) // one
            x[j] = (rest << WORK_BITS) // int(a[j, j])
        return _unit(x)

    def _unit(x: list[int]) -> list[int]:
        most = max(abs(v) for v in x)
        x = [(v << WORK_BITS) // most for v in x]
        norm = _root(sum(v * v for v in x))
        return [(v << WORK_BITS) // norm for v in x]

    found: list[list[int]] = []
    for n in range(count):
        x = _unit([one // (1 + (7 * k + 13 * n + k * k * (n + 3)) % 101) for k in range(d)])
        for _ in range(3):
            x = solved(x)
            for y in found + found:
                dot = sum(u * v for u, v in zip(x, y, strict=True)) >> WORK_BITS
                x = [u - ((dot * v) >> WORK_BITS) for u, v in zip(x, y, strict=True)]
            x = _unit(x)
        found.append(x)
    return [[float(Fraction(v, one)) for v in x] for x in found]


def _root(x: int) -> int:
    from math import isqrt

    return isqrt(x)
