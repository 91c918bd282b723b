"""Short-code maths as Column expressions.

Spark has no unsigned 64-bit type, so a 64-bit id travels as two 32-bit
halves ``(hi, lo)`` held in LongType columns (each in [0, 2^32)).  All
arithmetic stays below 2^63, so ANSI mode never raises an overflow:
32-bit products are split into 16-bit parts, and integer quotients use
the exact ``div`` operator.

Hot paths are straight-line expressions that whole-stage codegen
compiles: base-62 encode splits the 64-bit value into two exact long
parts (value = A * 62^6 + B) and reads each digit independently; decode
of codes up to 11 characters is the mirror image.  The Feistel cipher
runs as an Arrow-batched pandas UDF over numpy uint32 arrays (see the
note above ``_make_feistel_udf``).  ``aggregate`` higher-order forms remain for
codes longer than 11 characters and as a JVM reference form of the
cipher; Spark interprets lambdas row by row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstream.constants import (
    BASE62_ALPHABET, CODE_LENGTH, FEISTEL_MUL_1, FEISTEL_MUL_2, FEISTEL_ROUND_KEY,
    FEISTEL_ROUNDS, FEISTEL_SHIFT_1, FEISTEL_SHIFT_2, MASK32, SNOWFLAKE_EPOCH_MS,
    SNOWFLAKE_NODE_BITS, SNOWFLAKE_SEQ_BITS, TWO32,
)

_HALVES = "struct<hi:bigint,lo:bigint>"
_HALVES_TYPE = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _div(a: Column, b) -> Column:
    """Exact integer quotient (``a div b``), codegen'd, never via double."""
    return F.call_function("div", a, _lit(b) if isinstance(b, int) else b)


_B62_6 = 62 ** 6
_B62_6_HI, _B62_6_LO = divmod(_B62_6, TWO32)


# --- 64-bit <-> halves ------------------------------------------------------

def halves_from_long(col) -> Column:
    """Non-negative (or two's-complement) LongType id -> struct(hi, lo)."""
    c = _c(col).cast("bigint")
    return F.struct(F.shiftrightunsigned(c, 32).alias("hi"),
                    c.bitwiseAND(_lit(MASK32)).alias("lo"))


def halves_from_decimal(col) -> Column:
    """DECIMAL(20,0) in [0, 2^64) -> struct(hi, lo)."""
    d = _c(col).cast("decimal(20,0)")
    hi = F.floor(d / F.lit(TWO32)).cast("bigint")
    lo = (d - hi.cast("decimal(20,0)") * F.lit(TWO32)).cast("bigint")
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def halves_to_decimal(hi, lo) -> Column:
    """struct halves -> unsigned value as DECIMAL(20,0) (edge format)."""
    return (_c(hi).cast("decimal(20,0)") * F.lit(TWO32).cast("decimal(20,0)")
            + _c(lo).cast("decimal(20,0)")).cast("decimal(20,0)")


# --- 32-bit helpers ---------------------------------------------------------

def _mul32(v: Column, k: int) -> Column:
    """(v * k) mod 2^32 for v, k in [0, 2^32) without 64-bit overflow."""
    lo16 = v.bitwiseAND(_lit(0xFFFF))
    hi16 = F.shiftright(v, 16)
    part = F.shiftleft((hi16 * _lit(k)).bitwiseAND(_lit(0xFFFF)), 16)
    return (lo16 * _lit(k) + part).bitwiseAND(_lit(MASK32))


def _round_fn(v: Column, rnd: Column) -> Column:
    x = v.bitwiseXOR(_lit(FEISTEL_ROUND_KEY).bitwiseXOR(rnd))
    x = _mul32(x, FEISTEL_MUL_1)
    x = x.bitwiseXOR(F.shiftright(x, FEISTEL_SHIFT_1))
    x = _mul32(x, FEISTEL_MUL_2)
    return x.bitwiseXOR(F.shiftright(x, FEISTEL_SHIFT_2))


def feistel_obfuscate_hof(hi, lo) -> Column:
    """Balanced Feistel permutation of a 64-bit id -> struct(hi, lo), as a
    JVM fold (interpreted lambda; reference form).

    Each round: (L, R) -> (R, L xor f(R, round)).
    """
    init = F.struct(_c(hi).cast("bigint").alias("hi"), _c(lo).cast("bigint").alias("lo"))
    rounds = F.sequence(F.lit(0).cast("bigint"), F.lit(FEISTEL_ROUNDS - 1).cast("bigint"))
    return F.aggregate(
        rounds, init,
        lambda acc, r: F.struct(acc["lo"].alias("hi"),
                                acc["hi"].bitwiseXOR(_round_fn(acc["lo"], r)).alias("lo")))


def feistel_invert_hof(hi, lo) -> Column:
    """Inverse permutation as a JVM fold: rounds in reverse, (L, R) -> (R xor f(L, r), L)."""
    init = F.struct(_c(hi).cast("bigint").alias("hi"), _c(lo).cast("bigint").alias("lo"))
    rounds = F.sequence(F.lit(FEISTEL_ROUNDS - 1).cast("bigint"), F.lit(0).cast("bigint"))
    return F.aggregate(
        rounds, init,
        lambda acc, r: F.struct(acc["lo"].bitwiseXOR(_round_fn(acc["hi"], r)).alias("hi"),
                                acc["hi"].alias("lo")))


# The cipher needs wrapping 32-bit multiplies: under ANSI Spark has none,
# split multiplies duplicate their operand (the expression tree grows 16x
# per round) and the fold above is interpreted row by row (~30 us/row).
# numpy uint32 arithmetic wraps natively, so the permutation runs as an
# Arrow-batched pandas UDF: vectorised over each batch, one pass.

def _make_feistel_udf(inverse: bool):
    """The UDF body is a closure, so it is shipped by value with its
    constants; workers need numpy and pandas only, not this package."""
    key, mul1, sh1, mul2, sh2, rounds = (FEISTEL_ROUND_KEY, FEISTEL_MUL_1, FEISTEL_SHIFT_1,
                                         FEISTEL_MUL_2, FEISTEL_SHIFT_2, FEISTEL_ROUNDS)

    def permute(hi: pd.Series, lo: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        def f(v, rnd):
            x = v ^ np.uint32(key ^ rnd)
            x = x * np.uint32(mul1)
            x = x ^ (x >> np.uint32(sh1))
            x = x * np.uint32(mul2)
            return x ^ (x >> np.uint32(sh2))

        missing = (hi.isna() | lo.isna()).to_numpy()
        left = hi.fillna(0).to_numpy().astype(np.uint64).astype(np.uint32)
        right = lo.fillna(0).to_numpy().astype(np.uint64).astype(np.uint32)
        with np.errstate(over="ignore"):
            if inverse:
                for r in range(rounds - 1, -1, -1):
                    left, right = right ^ f(left, r), left
            else:
                for r in range(rounds):
                    left, right = right, left ^ f(right, r)
        out = pd.DataFrame({"hi": left.astype(np.int64), "lo": right.astype(np.int64)})
        if missing.any():
            out = out.astype("Int64")
            out.loc[missing, ["hi", "lo"]] = pd.NA
        return out

    return F.pandas_udf(permute, _HALVES_TYPE)


_feistel_forward = _make_feistel_udf(inverse=False)
_feistel_backward = _make_feistel_udf(inverse=True)


def feistel_obfuscate(hi, lo) -> Column:
    """Feistel permutation of a 64-bit id (halves) -> struct(hi, lo)."""
    return _feistel_forward(_c(hi).cast("bigint"), _c(lo).cast("bigint"))


def feistel_invert(hi, lo) -> Column:
    """Inverse permutation -> struct(hi, lo)."""
    return _feistel_backward(_c(hi).cast("bigint"), _c(lo).cast("bigint"))


def cycle_walk(hi, lo, max_hi: int = MASK32, max_lo: int = MASK32) -> Column:
    """The permuted id within a bound (halves of the largest id) -> struct(hi, lo).

    A value above the bound would be permuted again.  The bound of the codes is
    the largest 64-bit value, so the walk is one step; under a smaller bound a
    value outside it is an error, as no id may leave its domain unseen.
    """
    h = feistel_obfuscate(hi, lo)
    within = (h["hi"] < max_hi) | ((h["hi"] == max_hi) & (h["lo"] <= max_lo))
    return F.when(h["hi"].isNull() | within, h).otherwise(F.raise_error(F.lit("a permuted id lies above its bound")).cast(_HALVES))


# --- base 62 -----------------------------------------------------------------

def _split_62_6(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi * 2^32 + lo) -> (A, B) with value = A * 62^6 + B, in exact longs."""
    m = _B62_6
    x = hi * _lit(1 << 16)                      # < 2^48
    x1, x0 = _div(x, m), F.pmod(x, _lit(m))
    y = x0 * _lit(1 << 16)                      # < 62^6 * 2^16
    y1, y0 = _div(y, m), F.pmod(y, _lit(m))
    z = y0 + lo                                 # < 62^6 + 2^32
    z1, z0 = _div(z, m), F.pmod(z, _lit(m))
    return x1 * _lit(1 << 16) + y1 + z1, z0


def base62_encode(hi, lo, width: int = CODE_LENGTH) -> Column:
    """Unsigned 64-bit (as halves) -> exactly ``width`` base-62 characters
    (most significant first).  Straight-line: each digit is read
    independently from two exact long parts of the value."""
    if width != CODE_LENGTH:
        return base62_encode_hof(hi, lo, width)
    a, b = _split_62_6(_c(hi).cast("bigint"), _c(lo).cast("bigint"))
    alphabet = F.lit(BASE62_ALPHABET)
    chars = []
    for k in range(CODE_LENGTH - 1, -1, -1):
        part, e = (a, k - 6) if k >= 6 else (b, k)
        d = F.pmod(_div(part, 62 ** e) if e else part, _lit(62))
        chars.append(alphabet.substr(d + 1, F.lit(1)))
    return F.concat(*chars)


def base62_encode_hof(hi, lo, width: int = CODE_LENGTH) -> Column:
    """Any width, by repeated long division (interpreted lambda)."""
    alphabet = F.lit(BASE62_ALPHABET)
    init = F.struct(_c(hi).cast("bigint").alias("hi"), _c(lo).cast("bigint").alias("lo"),
                    F.lit("").alias("s"))

    def step(acc, _):
        r1 = F.pmod(acc["hi"], _lit(62))
        t = r1 * _lit(TWO32) + acc["lo"]
        digit = F.pmod(t, _lit(62))
        return F.struct(_div(acc["hi"], 62).alias("hi"), _div(t, 62).alias("lo"),
                        F.concat(alphabet.substr(digit + 1, F.lit(1)), acc["s"]).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(width)), init, step, lambda acc: acc["s"])


# The alphabet is digits, then upper case, then lower case: a character's
# digit follows from its code point range.
assert BASE62_ALPHABET == "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))


def _digit(ch: Column) -> Column:
    a = F.ascii(ch)
    return (F.when((a >= 48) & (a <= 57), a - 48)
             .when((a >= 65) & (a <= 90), a - 55)
             .when((a >= 97) & (a <= 122), a - 61)
             .otherwise(F.lit(-1))).cast("bigint")


def base62_decode(code, general: bool = True) -> Column:
    """Base-62 text -> struct(hi, lo), wrapping mod 2^64.

    Codes of up to 11 characters take a straight-line path: value =
    P * 62^6 + Q with P, Q read digit by digit, then split into halves.
    Longer codes use the general fold when ``general`` (the fold keeps the
    projection out of whole-stage codegen), else give NULL halves.  A
    character outside the alphabet, or an empty / NULL code, gives NULL.
    """
    c = _c(code)
    n = F.length(c)
    padded = F.lpad(c, CODE_LENGTH, "0")  # '0' is digit 0: padding keeps the value
    idx = [_digit(padded.substr(F.lit(i + 1), F.lit(1))) for i in range(CODE_LENGTH)]
    p = sum((idx[i] * _lit(62 ** (4 - i)) for i in range(5)), _lit(0))            # < 62^5
    q = sum((idx[i] * _lit(62 ** (10 - i)) for i in range(5, 11)), _lit(0))       # < 62^6
    lo_sum = p * _lit(_B62_6_LO) + q
    # No CASE around the arithmetic: whole-stage codegen then evaluates each
    # digit once and shares it between the halves.  Invalid input turns both
    # halves NULL through a tiny NULL-or-zero term.
    ok = (n > 0) & (n <= CODE_LENGTH) & c.rlike("^[0-9A-Za-z]+$")
    z = F.when(ok, _lit(0))
    short = F.struct(((p * _lit(_B62_6_HI) + F.shiftright(lo_sum, 32)).bitwiseAND(_lit(MASK32)) + z).alias("hi"),
                     (lo_sum.bitwiseAND(_lit(MASK32)) + z).alias("lo"))
    if not general:
        return short
    return F.when(n > CODE_LENGTH, base62_decode_hof(c)).otherwise(short)


def base62_decode_hof(code) -> Column:
    """Any length, by a fold over the characters (interpreted lambda)."""
    c = _c(code)
    alphabet = F.lit(BASE62_ALPHABET)
    init = F.struct(_lit(0).alias("hi"), _lit(0).alias("lo"), F.lit(False).alias("bad"))

    def step(acc, pos):
        idx = F.position(c.substr(pos, F.lit(1)), alphabet).cast("bigint") - 1
        t = acc["lo"] * _lit(62) + F.greatest(idx, _lit(0))
        return F.struct(
            (acc["hi"] * _lit(62) + F.shiftright(t, 32)).bitwiseAND(_lit(MASK32)).alias("hi"),
            t.bitwiseAND(_lit(MASK32)).alias("lo"),
            (acc["bad"] | (idx < 0)).alias("bad"))

    n = F.length(c)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), init, step)
    return F.when(c.isNull() | (n == 0) | folded["bad"], F.lit(None).cast(_HALVES)) \
            .otherwise(F.struct(folded["hi"].alias("hi"), folded["lo"].alias("lo")))


# --- snowflake layout ------------------------------------------------------------

_TS_SHIFT = SNOWFLAKE_NODE_BITS + SNOWFLAKE_SEQ_BITS
_NODE_MASK = (1 << SNOWFLAKE_NODE_BITS) - 1
_SEQ_MASK = (1 << SNOWFLAKE_SEQ_BITS) - 1


def snowflake_decode(col) -> Column:
    """id -> struct(ts timestamp, node int, seq int)."""
    c = _c(col).cast("bigint")
    ms = F.shiftright(c, _TS_SHIFT) + _lit(SNOWFLAKE_EPOCH_MS)
    return F.struct(F.timestamp_millis(ms).alias("ts"),
                    F.shiftright(c, SNOWFLAKE_SEQ_BITS).bitwiseAND(_lit(_NODE_MASK)).cast("int").alias("node"),
                    c.bitwiseAND(_lit(_SEQ_MASK)).cast("int").alias("seq"))


def snowflake_compose(ms, node, seq) -> Column:
    """(epoch millis, node, seq) -> id.  The sequence is masked to 12 bits."""
    return (F.shiftleft(_c(ms).cast("bigint") - _lit(SNOWFLAKE_EPOCH_MS), _TS_SHIFT)
            .bitwiseOR(F.shiftleft(_c(node).cast("bigint").bitwiseAND(_lit(_NODE_MASK)), SNOWFLAKE_SEQ_BITS))
            .bitwiseOR(_c(seq).cast("bigint").bitwiseAND(_lit(_SEQ_MASK))))


def short_code_for_id(id_col, obfuscate: bool = True) -> Column:
    """Non-negative long id -> 11-char code (optionally obfuscated)."""
    h = halves_from_long(id_col)
    if obfuscate:
        h = feistel_obfuscate(h["hi"], h["lo"])
    return base62_encode(h["hi"], h["lo"])
