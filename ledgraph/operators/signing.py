"""Ed25519 signatures over entry hashes, after RFC 8032, without a native library.

Signing is for single local writes.  Verification of whole logs runs in Arrow
batches on the executors, with the (small) table of trusted keys sent along.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)
_Point = tuple[int, int, int, int]


def _add(p: _Point, q: _Point) -> _Point:
    a = (p[1] - p[0]) * (q[1] - q[0]) % _P
    b = (p[1] + p[0]) * (q[1] + q[0]) % _P
    c = 2 * p[3] * q[3] * _D % _P
    d = 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, p: _Point) -> _Point:
    out: _Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p = _add(p, p)
        n >>= 1
    return out


def _x_of(y: int, sign: int) -> int | None:
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    if not square:
        return None if sign else 0
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _I % _P
    if (x * x - square) % _P:
        return None
    return _P - x if x & 1 != sign else x


_BY = 4 * pow(5, _P - 2, _P) % _P
_BX = _x_of(_BY, 0)
_BASE: _Point = (_BX, _BY, 1, _BX * _BY % _P)


def _pack(p: _Point) -> bytes:
    z = pow(p[2], _P - 2, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> _Point | None:
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, sign)
    return None if x is None else (x, y, 1, x * y % _P)


def _secret(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def public_key(key: bytes) -> bytes:
    return _pack(_times(_secret(key)[0], _BASE))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    public = _pack(_times(a, _BASE))
    r = _hash(prefix, message)
    point = _pack(_times(r, _BASE))
    return point + ((r + _hash(point, public, message) * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r = _unpack(public), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    left, right = _times(s, _BASE), _add(r, _times(_hash(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0


def accepted(entries: DataFrame, trusted: dict[str, bytes], strict: bool) -> DataFrame:
    """Entries that pass the signature rules.

    By default unsigned entries pass and signed ones are checked if their author is known; strictly,
    unsigned ones, unknown authors and bad signatures go.  The schema's first entry is exempt.
    """
    keys = dict(trusted)

    @F.pandas_udf("boolean")
    def fits(author: pd.Series, hash_: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([a in keys and s is not None and verify(keys[a], bytes.fromhex(h), bytes(s)) for a, h, s in zip(author, hash_, signature, strict=True)], dtype=bool)

    good = fits("author", "hash", "signature")
    genesis = F.col("op") == "define_ontology"
    if strict:
        return entries.where(genesis | good)
    return entries.where(genesis | F.col("signature").isNull() | ~F.col("author").isin(list(keys)) | good)
