"""The synthetic key/value tensors of the text client: one float per token, layer, kind, head and dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.binary import times32, wrap32


def element_count(tokens: Column, layers: int, heads: int, head_dim: int) -> Column:
    """DECIMAL, so that it can't overflow."""
    return (tokens.cast("decimal(20,0)") * F.lit(2 * layers).cast("decimal(8,0)") * F.lit(heads * head_dim).cast("decimal(8,0)")).cast("decimal(38,0)")


def value(token: Column, token_index: Column, layer: Column, kind: Column, head: Column, dim: Column) -> Column:
    """Wrapping 32-bit mix; its low 16 bits over 65535, negative for values (kind 1)."""
    mixed = times32(token, 1664525)
    for x, factor in ((token_index + 1, 1013904223), (layer + 1, 2654435761), (head, 2246822519), (dim, 3266489917), (kind, 668265263)):
        mixed = wrap32(mixed + times32(wrap32(x.cast("bigint")), factor))
    v = (mixed.bitwiseAND(F.lit(0xFFFF)).cast("float") / F.lit(65535.0).cast("float")).cast("float")
    return F.when(kind == 0, v).otherwise(-v)


def chunk_payload(token: Column, begin: Column, layers: int, heads: int, head_dim: int) -> Column:
    """BINARY of a chunk's tensor as little-endian floats in order layer, token, kind, head, dimension. token: ARRAY<BIGINT>, begin: its first index."""
    import numpy as np
    import pandas as pd

    def run(tokens: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        u = np.uint32
        for t, b in zip(tokens, first):
            t = np.asarray(t, dtype=np.int64).astype(u)
            with np.errstate(over="ignore"):
                mixed = (t * u(1664525) + (np.arange(len(t), dtype=np.int64) + b + 1).astype(u) * u(1013904223))[None, :, None, None, None]
                mixed = mixed + (np.arange(1, layers + 1).astype(u) * u(2654435761))[:, None, None, None, None]
                mixed = mixed + (np.arange(2).astype(u) * u(668265263))[None, None, :, None, None]
                mixed = mixed + (np.arange(heads).astype(u) * u(2246822519))[None, None, None, :, None] + (np.arange(head_dim).astype(u) * u(3266489917))[None, None, None, None, :]
            v = (mixed & u(0xFFFF)).astype("<f4") / np.float32(65535)
            v[:, :, 1] *= -1
            out.append(v.tobytes())
        return pd.Series(out)

    run.__annotations__ = {"tokens": pd.Series, "first": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(token, begin)


def _low(token, index, *terms: tuple[int, int]):
    """The 16 bits behind the values of tokens (uint8 or uint16) at these indices: the low half of the mix needs only the low halves of its parts."""
    import numpy as np

    rest = sum(x * factor for x, factor in terms) & 0xFFFF
    return token.astype(np.uint16) * np.uint16(1664525 & 0xFFFF) + (index + 1).astype(np.uint16) * np.uint16(1013904223 & 0xFFFF) + np.uint16(rest)


def low_bits(text: Column, layer: int, kind: int, head: int, dim: int) -> Column:
    """STRUCT(low_sum, low_max) of the 16 bits behind the value of every byte token of a text; null for null and empty texts."""
    import pyarrow as pa

    terms = ((layer + 1, 2654435761), (head, 2246822519), (dim, 3266489917), (kind, 668265263))

    def run(x: pa.Array) -> pa.Array:
        import numpy as np

        total, most = [], []
        for raw in x:
            t = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else ()
            low = _low(t, np.arange(len(t), dtype=np.uint32), *terms) if len(t) else None
            total.append(None if low is None else int(low.sum(dtype=np.int64)))
            most.append(None if low is None else int(low.max()))
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(most, pa.int64())], ["low_sum", "low_max"])

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "low_sum bigint, low_max bigint")(text.cast("binary"))


#: Chunks whose tensors a task holds at once.
CHUNKS_AT_ONCE = 1 << 10


def chunk_checksums(texts: DataFrame, text: str, chunk: int, layers: int, heads: int, head_dim: int) -> DataFrame:
    """(other columns, idx, length, checksum) of every complete chunk of byte tokens: the size and CRC-32 of its chunk_payload(), which stays in the task."""
    keep = [c for c in texts.columns if c != text]

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        u = np.uint16
        # of all 65,536 values the floats as they are in keys and, negative, in values
        value = np.arange(1 << 16, dtype=np.uint32).astype("<f4") / np.float32(65535)
        other = (np.arange(1, layers + 1, dtype=np.int64) * 2654435761)[:, None, None, None] + (np.arange(heads, dtype=np.int64) * 2246822519)[:, None] + np.arange(head_dim, dtype=np.int64) * 3266489917
        size = layers * chunk * 2 * heads * head_dim * 4
        for b in batches:
            own = b.select(keep)
            for r, raw in enumerate(b.column(b.schema.get_field_index(text))):
                t = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid else np.zeros(0, np.uint8)
                n = len(t) // chunk
                for c in range(0, n, CHUNKS_AT_ONCE):
                    m = min(n, c + CHUNKS_AT_ONCE) - c
                    low = _low(t[c * chunk : (c + m) * chunk], np.arange(c * chunk, (c + m) * chunk, dtype=np.int64)).reshape(m, 1, chunk, 1, 1)
                    out = np.empty((m, layers, chunk, 2, heads, head_dim), "<f4")
                    mixed = low + other.astype(u)
                    out[:, :, :, 0] = value[mixed]
                    out[:, :, :, 1] = value[mixed + u(668265263 & 0xFFFF)]
                    out[:, :, :, 1] *= -1
                    data = memoryview(out).cast("B")
                    sums = [zlib.crc32(data[i * size : (i + 1) * size]) for i in range(m)]
                    rows = own.take(pa.array(np.full(m, r, np.int32)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.arange(c, c + m, dtype=np.int32)), pa.array(np.full(m, size, np.int32)), pa.array(sums, pa.int64())], [*keep, "idx", "length", "checksum"])

    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    new = [("idx", IntegerType()), ("length", IntegerType()), ("checksum", LongType())]
    return texts.mapInArrow(run, StructType([*[StructField(f.name, f.dataType) for f in texts.select(*keep).schema.fields], *[StructField(c, k) for c, k in new]]))
