"""Scalar functions on bases, cigars of types and text fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGT"


def acgt(text: Column) -> Column:
    """A text as bases: each ASCII letter by its code modulo 4, everything else N."""
    return F.regexp_replace(F.translate(text, LETTERS, "".join(BASES[ord(c) % 4] for c in LETTERS)), "[^ACGT]", "N")


def acgt_sql(text: str) -> str:
    to = "".join(BASES[ord(c) % 4] for c in LETTERS)
    return f"regexp_replace(translate({text}, '{LETTERS}', '{to}'), '[^ACGT]', 'N', 'g')"


def code(base: Column) -> Column:
    """A, C, G, T as 0 to 3 in either case; null for all else."""
    up = F.translate(base, "acgt", "ACGT")
    return F.when(up.isin(*BASES), F.instr(F.lit(BASES), up) - 1)


def pack2(bases: Column) -> Column:
    """Up to 31 bases as a number, two bits each, first base highest; null with any other letter."""
    digits = F.translate(bases, "ACGTacgt", "01230123")
    return F.when(bases == "", F.lit(0).cast("long")).when(digits.rlike("^[0-3]+$"), F.conv(digits, 4, 10).cast("long"))


def unpack2(packed: Column, n: Column) -> Column:
    """The `n` bases of a packed number."""
    digits = F.call_function("lpad", F.conv(packed.cast("string"), 10, 4), n.cast("int"), F.lit("0"))
    return F.when(n > 0, F.translate(digits, "0123", BASES)).otherwise("")


_CODE = np.full(256, 4, np.uint8)
_CODE[[*b"ACGTacgt"]] = [0, 1, 2, 3, 0, 1, 2, 3]


def pack_text(bases: Column) -> Column:
    """A text of bases as an array of numbers, 31 bases each and the rest in the last; null for a number with any other letter."""

    @F.arrow_udf("array<bigint>")
    def pack(texts: pa.Array) -> pa.Array:
        weight = 4 ** np.arange(30, -1, -1, dtype=np.int64)
        values, bad, sizes = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
        for x in texts.to_pylist():
            raw = np.zeros(0, np.uint8) if x is None else _CODE[np.frombuffer(x.encode("ascii", "replace"), np.uint8)]
            n = -(-len(raw) // 31)
            full = np.zeros(31 * n, np.uint8)
            full[: len(raw)] = raw
            rows = full.reshape(n, 31).astype(np.int64)
            if n:
                # the last number holds fewer bases, at its low end
                rows[-1] = np.roll(rows[-1], 31 * n - len(raw))
            values.append(rows @ weight)
            bad.append((rows > 3).any(axis=1))
            sizes.append(n)
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
        flat = pa.array(np.concatenate(values), pa.int64(), mask=np.concatenate(bad))
        return pa.ListArray.from_arrays(offsets, flat, mask=texts.is_null() if texts.null_count else None)

    return pack(bases)


def unpack_text(packed: Column, n: Column) -> Column:
    """The `n` bases of a packed array; null where either or one of its numbers is."""

    @F.arrow_udf("string")
    def unpack(lists: pa.Array, sizes: pa.Array) -> pa.Array:
        shift = np.arange(60, -2, -2, dtype=np.int64)
        out = []
        for i, size in enumerate(sizes.to_pylist()):
            x = lists[i]
            if size is None or not x.is_valid or x.values.null_count:
                out.append(None)
                continue
            digits = (x.values.to_numpy(zero_copy_only=False)[:, None] >> shift & 3).astype(np.uint8)
            flat = digits.ravel()
            if rest := size % 31:
                flat = np.concatenate([flat[: size - rest], digits[size // 31, 31 - rest :]])
            out.append(np.frombuffer(b"ACGT", np.uint8)[flat[:size]].tobytes().decode())
        return pa.array(out, pa.string())

    return unpack(packed, n)


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def unversioned(gene: Column) -> Column:
    """A gene id without what follows its first dot."""
    return F.substring_index(gene, ".", 1)


def seconds(clock: Column) -> Column:
    """h:mm:ss or m:ss (with fractions) as seconds."""
    return F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


@F.pandas_udf(StructType([StructField("first", LongType()), StructField("differing", LongType())]))
def difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Where two texts first differ among the letters that both have (null: nowhere), and in how many of those they do."""

    def of(x: str | None, y: str | None) -> tuple[int | None, int | None]:
        if x is None or y is None:
            return None, None
        n = min(len(x), len(y))
        at = np.flatnonzero(np.frombuffer(x[:n].encode("utf-32-le"), "<u4") != np.frombuffer(y[:n].encode("utf-32-le"), "<u4"))
        return (int(at[0]) if len(at) else None), len(at)

    return pd.DataFrame([of(x, y) for x, y in zip(a, b, strict=True)], columns=["first", "differing"]).astype("Int64")
