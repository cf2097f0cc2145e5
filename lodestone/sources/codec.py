"""Payload envelopes: compression choice, framing with checksums, encryption, archives."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION, MIN_SIZE = 1, 64
# fixed values: flags in an envelope's header
NONE, GZIP, LZ4, DEFLATE = 0, 1, 2, 3
PLAIN, CBC, GCM = 0, 1, 2
# fixed values: estimated savings by size, as (below, share); the last has no bound
ESTIMATES = {
    "gzip": ((64, 0.0), (256, 0.2), (1024, 0.4), (16384, 0.6), (None, 0.7)),
    "lz4": ((64, 0.0), (512, 0.2), (4096, 0.35), (65536, 0.5), (None, 0.58)),
    "deflate": ((64, 0.0), (256, 0.22), (1024, 0.42), (16384, 0.62), (None, 0.72)),
}


def estimated_ratio(size: Column, codec: str) -> Column:
    out = None
    for below, share in ESTIMATES[codec]:
        if below is None:
            return out.otherwise(F.lit(share))
        out = F.when(size < below, F.lit(share)) if out is None else out.when(size < below, F.lit(share))
    return out


def auto_flag(size: Column, large: int = 4096) -> Column:
    """What automatic compression picks for a size: nothing, then the fast codec, then the strong one."""
    return F.when(size < MIN_SIZE, NONE).when(size >= large, GZIP).otherwise(LZ4).cast("int")


def _is_zlib(raw: bytes) -> bool:
    return len(raw) >= 2 and raw[0] == 0x78 and int.from_bytes(raw[:2], "big") % 31 == 0


def deflated(data: Column, level: int = 6) -> Column:
    """Compressed bytes, or the bytes themselves where that is not smaller and they do not begin like compressed ones; Spark has no such function, so zlib runs on Arrow batches."""

    @F.arrow_udf("binary")
    def pack(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch:
            raw = x.as_py()
            small = None if raw is None else zlib.compress(raw, level)
            out.append(small if raw is not None and (len(small) < len(raw) or _is_zlib(raw)) else raw)
        return pa.array(out, pa.binary())

    return pack(data.cast("binary"))


def inflated(data: Column) -> Column:
    @F.arrow_udf("binary")
    def unpack(batch: pa.Array) -> pa.Array:
        rows = (x.as_py() for x in batch)
        return pa.array([zlib.decompress(raw) if raw is not None and _is_zlib(raw) else raw for raw in rows], pa.binary())

    return unpack(data.cast("binary"))


def _lz4(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "big") + pa.compress(raw, codec="lz4_raw", asbytes=True)


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


#: flag -> (pack, unpack). LZ4 blocks do not know their size, which stands before them.
_CODECS = {
    GZIP: (_gzip, lambda raw: zlib.decompress(raw, 31)),
    LZ4: (_lz4, lambda raw: pa.decompress(raw[4:], int.from_bytes(raw[:4], "big"), codec="lz4_raw", asbytes=True)),
    DEFLATE: (zlib.compress, zlib.decompress),
}


def compressed(data: Column, flag: Column) -> Column:
    """struct(flag, data): the data packed by the codec that a flag names, or as they are, with the flag NONE, where that is not smaller."""

    @F.arrow_udf("struct<flag: int, data: binary>")
    def pack(batch: pa.Array, flags: pa.Array) -> pa.Array:
        kept, out = [], []
        for x, f in zip(batch, flags):
            raw, how = x.as_py(), f.as_py()
            small = _CODECS[how][0](raw) if raw and how in _CODECS else raw
            smaller = raw is not None and len(small) < len(raw)
            kept.append(how if smaller else NONE)
            out.append(small if smaller else raw)
        return pa.StructArray.from_arrays([pa.array(kept, pa.int32()), pa.array(out, pa.binary())], ["flag", "data"])

    return pack(data.cast("binary"), flag.cast("int"))


def decompressed(data: Column, flag: Column) -> Column:
    """The data that `compressed` packed; an unknown flag or broken data is an error."""

    @F.arrow_udf("binary")
    def unpack(batch: pa.Array, flags: pa.Array) -> pa.Array:
        pairs = ((x.as_py(), f.as_py()) for x, f in zip(batch, flags))
        return pa.array([raw if raw is None or how == NONE else _CODECS[how][1](raw) for raw, how in pairs], pa.binary())

    return unpack(data.cast("binary"), flag.cast("int"))


def framed(data: Column, compression: Column, encryption: Column) -> Column:
    """version, both flags, big-endian length, data, SHA-256 of the data; the compression flag is that of what is stored."""
    number = lambda c, digits: F.unhex(F.lpad(F.hex(c.cast("long")), digits, "0"))
    return F.concat(number(F.lit(VERSION), 2), number(compression, 2), number(encryption, 2), number(F.octet_length(data), 8), data, F.unhex(F.sha2(data, 256)))


def parsed(frame: Column) -> dict[str, Column]:
    """version, compression, encryption, data, valid. A frame that is too short or whose checksum differs is not valid."""
    byte = lambda at, n: F.conv(F.hex(F.substring(frame, at, n)), 16, 10).cast("int")
    size = byte(4, 4)
    data = F.substring(frame, F.lit(8), size)
    whole = F.octet_length(frame) == size + 7 + 32
    same = F.lower(F.hex(F.substring(frame, size + 8, F.lit(32)))) == F.sha2(data, 256)
    return {"version": byte(1, 1), "compression": byte(2, 1), "encryption": byte(3, 1), "data": data, "valid": F.coalesce(whole & same, F.lit(False))}


def derived_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """A 256-bit key, derived once on the driver for a whole table."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(data: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_encrypt(data, key, F.lit(mode), F.lit("DEFAULT" if mode == "GCM" else "PKCS"))


def decrypted(data: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(data, key, F.lit(mode), F.lit("DEFAULT" if mode == "GCM" else "PKCS"))


def _sub_key(master: Column, salt: Column) -> Column:
    return F.unhex(F.sha2(F.concat(master, salt), 256))


def sealed(data: Column, master: Column) -> Column:
    """16 bytes of fresh salt, nonce, data and tag: each entry is encrypted with a key of its own, made from the master key and its salt."""
    salt = F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))
    entry = F.struct(salt.alias("salt"), data.alias("data"))
    # one salt for the key and the envelope
    return F.transform(F.array(entry), lambda e: F.concat(e["salt"], encrypted(e["data"], _sub_key(master, e["salt"]))))[0]


def opened(envelope: Column, master: Column) -> Column:
    salt = F.substring(envelope, 1, 16)
    return decrypted(F.substring(envelope, F.lit(17), F.octet_length(envelope) - 16), _sub_key(master, salt))


def reencrypted(data: Column, old: Column, new: Column, mode: str = "GCM") -> Column:
    """Key rotation is a projection."""
    return encrypted(decrypted(data, old, mode), new, mode)


def rotation_due(created: Column, now: Column, max_days: int) -> Column:
    """A key without a date is not due."""
    return F.coalesce(F.timestamp_diff("DAY", created, now) >= max_days, F.lit(False))


def rotations(log: DataFrame, order: str, size: str, max_count: int, max_bytes: int, by: str, piece: int = 100_000) -> DataFrame:
    """Rows of a write log after which a rotation is due, by count or by bytes since the start, per store (`by`).

    A store's log is counted in pieces, ranges of the numeric order, each on top of the totals of those before it.
    """
    cut = log.withColumn("__piece", F.floor(F.col(order) / piece))
    before = Window.partitionBy(by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(by, "__piece").agg(F.count("*").alias("__n"), F.sum(size).alias("__total"))
    starts = totals.select(F.col(by).alias("__by"), F.col("__piece").alias("__at"), *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("__n", "__total")))
    w = Window.partitionBy(by, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({"n": F.count("*").over(w), "total": F.sum(size).over(w)})
    met = inside.join(starts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__piece").eqNullSafe(F.col("__at")))
    marked = met.withColumns({"n": F.col("n") + F.col("__n"), "total": F.col("total") + F.col("__total")}).select(*log.columns, "n", "total")
    crossed = F.floor(F.col("total") / max_bytes) > F.floor((F.col("total") - F.col(size)) / max_bytes)
    return marked.filter((F.col("n") % max_count == 0) | crossed).withColumn("reason", F.when(F.col("n") % max_count == 0, "count").otherwise("bytes"))


PART_BYTES = 64 << 20


def archive(df: DataFrame, key: str, value: str, spread: int | None = None, secret: Column | None = None) -> DataFrame:
    """(part, archive): JSON maps of key to base64 payload, in `spread` parts by hash of the key, encrypted if there is a secret.

    One part holds all its records in memory; without `spread` there are as many as the payloads have PART_BYTES.
    """
    if spread is None:
        total = df.agg(F.sum(F.octet_length(F.col(value)) + F.octet_length(F.col(key).cast("string")))).first()[0]
        spread = 1 + (total or 0) // PART_BYTES
    part = F.pmod(F.hash(key), F.lit(spread)).alias("part")
    pair = F.struct(F.col(key).alias("key"), F.base64(F.col(value).cast("binary")).alias("value"))
    packed = df.groupBy(part).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pair)))).alias("archive"))
    return packed if secret is None else packed.withColumn("archive", encrypted(F.col("archive").cast("binary"), secret))


def unarchive(df: DataFrame, secret: Column | None = None) -> DataFrame:
    """(key, value) of archives."""
    text = F.col("archive") if secret is None else decrypted(F.col("archive"), secret).cast("string")
    return df.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "coded")).select("key", F.unbase64("coded").alias("value"))
