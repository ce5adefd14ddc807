"""Content-addressed identities of token chunks, bit-exact with the published format.

scope = SHA-256 over a tagged canonical encoding; each chunk's prefix digest chains over its parent's; the object id covers scope, prefix
and token count; the block id is the first 8 bytes of the object id as a little-endian number.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.binary import U64, le, low_hex, text, uint

#: Digests are tagged with a domain, so that identities of different ones never meet. Whoever shares a cache gives its domain.
DOMAIN = "kvcache"
ROOT = bytes(32)
#: Rows that a task hands on at once.
CHUNKS_AT_ONCE = 1 << 14


@dataclass(frozen=True)
class Scope:
    namespace: str
    model_id: str
    model_revision: str
    dtype: str
    layers: int
    heads: int
    head_dim: int
    chunk_size: int
    adapter_id: str = ""
    version: int = 1
    layout_version: int = 1
    tp_world_size: int = 1
    tp_rank: int = 0

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in asdict(self).items()}


def tag(kind: str, domain: str = DOMAIN) -> bytes:
    """The domain tag of a scope, prefix or object."""
    return f"{domain}.{kind}.v1\0".encode()


def scope_problem(c: dict[str, Column]) -> Column:
    """Why a scope is invalid, null if it is valid."""
    rules = [(c["version"] != 1, "version"), (c["layout_version"] != 1, "layout version")]
    rules += [(F.coalesce(c[k], F.lit("")) == "", f"empty {k}") for k in ("namespace", "model_id", "model_revision", "dtype")]
    rules += [(F.coalesce(c[k], F.lit(0)) <= 0, f"zero {k}") for k in ("chunk_size", "layers", "heads", "head_dim", "tp_world_size")]
    rules += [(F.coalesce(c["tp_rank"], F.lit(0)) >= c["tp_world_size"], "rank out of range")]
    out = F.when(F.lit(False), F.lit(""))
    for bad, why in rules:
        out = out.when(bad, F.lit(why))
    return out


def scope_digest(c: dict[str, Column], domain: str = DOMAIN) -> Column:
    """BINARY digest of a scope given as columns."""
    parts = [F.lit(tag("scope", domain)), le(c["version"], 2), text(c["namespace"]), text(c["model_id"]), text(c["model_revision"]), text(c["adapter_id"]), le(c["chunk_size"], 4), le(c["layout_version"], 2), text(c["dtype"])]
    parts += [le(c[k], 4) for k in ("layers", "heads", "head_dim", "tp_world_size", "tp_rank")]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def byte_tokens(s: Column) -> Column:
    """Tokens of a text, one per UTF-8 byte, packed as little-endian 32-bit numbers."""
    return F.unhex(F.regexp_replace(F.hex(s.cast("binary")), "(..)", "$1000000"))


def packed(tokens: Column) -> Column:
    """ARRAY<BIGINT> tokens packed as little-endian 32-bit numbers."""
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.hex(le(t, 4))), ""))


def object_id(scope: Column, prefix: Column, token_count: Column, domain: str = DOMAIN) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(tag("object", domain)), scope, prefix, le(token_count, 8)), 256))


def adapter_id(lora: Column, salt: Column) -> Column:
    """The adapter of a scope that keeps fine-tuned models and salted tenants apart."""
    return F.concat(F.lit("lora:"), F.coalesce(lora.cast("string"), F.lit("")), F.lit("|salt:"), F.coalesce(salt.cast("string"), F.lit("")))


def block_id(object_: Column) -> Column:
    """DECIMAL(20,0); a lossy projection: a hit must compare the object id."""
    return uint(object_, 0, 8)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files split into fewer tasks than that; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunk_keys(prompts: DataFrame, scope: Column, chunk: int, tokens: Column, complete_only: bool = True, domain: str = DOMAIN, width: int = 4, less: tuple[str, ...] = ()) -> DataFrame:
    """A row a chunk: prompts' columns, but for those in `less`, and (idx, token_begin, token_end, prefix_digest, object_id) with binary digests.

    scope: binary digest; tokens: packed, or with width=1 a byte a token, which tasks widen. Prompts without a chunk give no rows.
    """
    keep = [c for c in prompts.columns if c not in less]
    prefix_tag, object_tag = tag("prefix", domain), tag("object", domain)

    def run(batches):
        from hashlib import sha256
        from struct import pack

        import numpy as np
        import pyarrow as pa

        def made(b, row, idx, ends, prefixes, objects):
            own = b.take(pa.array(row, pa.int32()))
            idx = np.array(idx, np.int32)
            digests = [pa.array(x, pa.binary()) for x in (prefixes, objects)]
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(idx), pa.array(idx.astype(np.int64) * chunk), pa.array(ends, pa.int64()), *digests], names)

        names = [*keep, "scope_digest", "idx", "token_begin", "token_end", "prefix_digest", "object_id"]
        for b in batches:
            scopes, data = b.column(len(keep)), b.column(len(keep) + 1)
            left = b.select(list(range(len(keep) + 1)))
            row, idx, ends, prefixes, objects = held = [], [], [], [], []
            for r in range(b.num_rows):
                if not data[r].is_valid or not scopes[r].is_valid:
                    continue
                t, own = data[r].as_py(), scopes[r].as_py()
                if width == 1:
                    t = np.frombuffer(t, np.uint8).astype("<u4").tobytes()
                n, prefix = len(t) // 4, bytes(32)
                head, object_head = prefix_tag + own, object_tag + own
                for i in range(n // chunk if complete_only else -(-n // chunk)):
                    end = min((i + 1) * chunk, n)
                    prefix = sha256(head + prefix + (end - i * chunk).to_bytes(4, "little") + t[4 * chunk * i : 4 * end]).digest()
                    row.append(r)
                    idx.append(i)
                    ends.append(end)
                    prefixes.append(prefix)
                    objects.append(sha256(object_head + prefix + pack("<Q", end)).digest())
                    if len(row) == CHUNKS_AT_ONCE:
                        yield made(left, *held)
                        for x in held:
                            x.clear()
            if row:
                yield made(left, *held)

    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    x = prompts.select(*keep, scope.alias("__scope"), tokens.alias("__tokens"))
    new = [("scope_digest", BinaryType()), ("idx", IntegerType()), ("token_begin", LongType()), ("token_end", LongType()), ("prefix_digest", BinaryType()), ("object_id", BinaryType())]
    return x.mapInArrow(run, StructType([*[StructField(f.name, f.dataType) for f in prompts.schema.fields if f.name in keep], *[StructField(c, k) for c, k in new]]))


def shown(keys: DataFrame) -> DataFrame:
    """Digests as lower-case hex, and the block id."""
    x = keys.withColumn("block_id", block_id(F.col("object_id")).cast(U64))
    return x.withColumns({c: low_hex(F.col(c)) for c in ("scope_digest", "prefix_digest", "object_id")})
