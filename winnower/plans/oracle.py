"""DuckDB SQL of the seeded hash family, for checks of signatures, bands and flags over whole tables.

The statements are put together as layers of common table expressions, one row for each n-gram and seed. They
cover n-grams of 4 to 32 bytes and bands of two hashes, which is all that four-byte characters and n = 5 can make.
"""

from __future__ import annotations

from ..functions.xxh3 import MASK, MX1, MX2, P64_1, _key

M = f"{MASK}::UHUGEINT"


def _u(value: int) -> str:
    return f"{value & MASK}::UHUGEINT"


def _le(first: str, size: int) -> str:
    """Little-endian number of ``size`` bytes from byte ``first`` of the hexadecimal text h."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({first} + {i}) + 1, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _fold(product: str) -> str:
    return f"xor({product} & {M}, {product} >> 64)"


def _swap(x: str) -> str:
    return "(" + " + ".join(f"((({x} >> {8 * i}) & 255) << {56 - 8 * i})" for i in range(8)) + ")"


def _rotl(x: str, n: int) -> str:
    return f"((({x} << {n}) & {M}) | ({x} >> {64 - n}))"


def signed(x: str) -> str:
    """An unsigned number as the bigint of the same bits."""
    return f"CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN CAST({x}::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST({x} AS BIGINT) END"


def gram_rows(n: int, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, unnest(list_transform(range(1, length(text) - {n - 2}), lambda i: substring(text, i, {n}))) AS gram FROM {table}"


def hashes(n: int, seeds: int, table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to ``hashed`` (gram, seed, hash): every distinct n-gram of 5 to 32 bytes under every seed."""
    rows = []
    for s in range(seeds):
        small = s ^ int.from_bytes(s.to_bytes(4, "little"), "big") << 32
        rows.append(
            f"({s}, {_u((_key(8) ^ _key(16)) - small)}, {_u((_key(24) ^ _key(32)) + s)}, {_u((_key(40) ^ _key(48)) - s)}, "
            f"{_u(_key(0) + s)}, {_u(_key(8) - s)}, {_u(_key(16) + s)}, {_u(_key(24) - s)})"
        )
    product = "(lo * hi)"
    return f"""
seeds(seed, fa, f1, f2, c0, c1, c2, c3) AS (VALUES {", ".join(rows)}),
grams AS (SELECT DISTINCT gram FROM ({gram_rows(n, table, key)})),
bytes AS (SELECT gram, hex(encode(gram)) AS h, strlen(gram) AS size FROM grams),
words AS (SELECT gram, size,
  CASE WHEN size <= 8 THEN ({_le("0", 4)} << 32) + {_le("(size - 4)", 4)} END AS w,
  CASE WHEN size > 8 THEN {_le("0", 8)} END AS w0, CASE WHEN size > 8 THEN {_le("(size - 8)", 8)} END AS w1,
  CASE WHEN size > 16 THEN {_le("8", 8)} END AS w2, CASE WHEN size > 16 THEN {_le("(size - 16)", 8)} END AS w3 FROM bytes),
keyed AS (SELECT gram, seed, size, xor(w, fa) AS k, xor(w0, f1) AS lo, xor(w1, f2) AS hi,
  CASE WHEN size > 16 THEN xor(w0, c0) * xor(w2, c1) END AS p1, CASE WHEN size > 16 THEN xor(w3, c2) * xor(w1, c3) END AS p2 FROM words, seeds),
mixed AS (SELECT gram, seed, size, CASE
  WHEN size <= 8 THEN xor(xor(k, {_rotl("k", 49)}), {_rotl("k", 24)})
  WHEN size <= 16 THEN (size::UHUGEINT + {_swap("lo")} + hi + {_fold(product)}) & {M}
  ELSE (size::UHUGEINT * {_u(P64_1)} + {_fold("p1")} + {_fold("p2")}) & {M} END AS y FROM keyed),
m1 AS (SELECT gram, seed, size, CASE WHEN size <= 8 THEN (y * {_u(MX2)}) & {M} ELSE xor(y, y >> 37) END AS y FROM mixed),
m2 AS (SELECT gram, seed, size, CASE WHEN size <= 8 THEN xor(y, (y >> 35) + size::UHUGEINT) ELSE (y * {_u(MX1)}) & {M} END AS y FROM m1),
m3 AS (SELECT gram, seed, size, CASE WHEN size <= 8 THEN (y * {_u(MX2)}) & {M} ELSE y END AS y FROM m2),
hashed AS (SELECT gram, seed, CASE WHEN size <= 8 THEN xor(y, y >> 28) ELSE xor(y, y >> 32) END AS hash FROM m3)"""


def signatures(n: int, seeds: int, table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to ``signature`` (key, seed, hash), unsigned."""
    return f"""{hashes(n, seeds, table, key)},
minima AS (SELECT {key}, seed, min(hash) AS hash FROM (SELECT DISTINCT {key}, gram FROM ({gram_rows(n, table, key)})) JOIN hashed USING (gram) GROUP BY {key}, seed),
signature AS (SELECT d.{key}, s.seed, coalesce(m.hash, {M}) AS hash FROM (SELECT {key} FROM {table}) d CROSS JOIN (SELECT seed FROM seeds) s LEFT JOIN minima m ON m.{key} = d.{key} AND m.seed = s.seed)"""


def bands(n: int, buckets: int, table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to ``band`` (key, bucket_idx, bucket_value as bigint) for bands of two hashes."""
    lo, hi = f"xor(a.hash, {_u(_key(24) ^ _key(32))})", f"xor(b.hash, {_u(_key(40) ^ _key(48))})"
    return f"""{signatures(n, 2 * buckets, table, key)},
pairs AS (SELECT a.{key}, a.seed // 2 AS bucket_idx, {lo} AS lo, {hi} AS hi FROM signature a JOIN signature b ON a.{key} = b.{key} AND b.seed = a.seed + 1 AND a.seed % 2 = 0),
b1 AS (SELECT {key}, bucket_idx, (16::UHUGEINT + {_swap("lo")} + hi + {_fold("(lo * hi)")}) & {M} AS y FROM pairs),
b2 AS (SELECT {key}, bucket_idx, (xor(y, y >> 37) * {_u(MX1)}) & {M} AS y FROM b1),
b3 AS (SELECT {key}, bucket_idx, xor(y, y >> 32) AS y FROM b2),
band AS (SELECT {key}, CAST(bucket_idx AS INTEGER) AS bucket_idx, {signed("y")} AS bucket_value FROM b3)"""
