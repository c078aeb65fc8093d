"""Names, deterministic ids and hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Namespace of URLs (RFC 9562); fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
NAME_MOST, NAME_PREFIX = 43, 26


def uuid5(seed: Column) -> Column:
    """Version-5 UUID of UTF-8 text, in native functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(seed, "utf-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant.substr(nibble + 1, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fields(*parts: Column) -> Column:
    """Length-prefixed fields, so that no delimiter within one makes two seeds alike."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def router_id(prefix: str, router: Column, correlation: Column, source_event: Column, target: Column, occurrence: Column) -> Column:
    return uuid5(fields(F.lit(prefix), F.lit("router"), router, correlation, source_event, target, occurrence.cast("string")))


def manager_id(prefix: str, manager: Column, correlation: Column, source_event: Column, index: Column) -> Column:
    """Index -1 is the manager's own append."""
    return uuid5(F.concat_ws(":", F.lit(prefix), F.lit("process-manager"), manager, correlation, source_event, index.cast("string")))


def seed_moved(seed: Column) -> Column:
    """Whether the old one-byte encoding of a seed differs from UTF-8."""
    return seed.rlike(r"[^\x00-\x7F]")


def legacy_seed(text: str) -> bytes:
    return bytes(ord(c) % 256 for c in text)


def fnv1a64(data: bytes) -> str:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return f"{h:016x}"


def fnv1a64_points(text: str) -> str:
    """Over code points instead of bytes, as queue names take it."""
    h = FNV_OFFSET
    for c in text:
        h = (h ^ ord(c)) * FNV_PRIME % (1 << 64)
    return f"{h:016x}"


def _mapped(f: Callable[[str], str], text: Column) -> Column:
    """A text function over Arrow batches. It is wrapped here, at plan time: a worker that imports this module has
    no session to make it in."""

    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, T.StringType())(text)


def _fnv(units: Column) -> Column:
    """FNV-1a over an array of units, in halves of 32 bits so that no product leaves a long."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def step(h: Column, unit: Column) -> Column:
        # The prime is 2**40 + 435.
        mixed = h["lo"].bitwiseXOR(unit)
        product = mixed * 435
        high = h["hi"] * 435 + F.shiftright(product, 32) + low(F.call_function("shiftleft", mixed, F.lit(8)))
        return F.struct(low(high).alias("hi"), low(product).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))
    text = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(units, start, step, lambda h: F.concat(text(h["hi"]), text(h["lo"])))


def fnv(text: Column) -> Column:
    """Over the bytes of UTF-8."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    return _fnv(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long")))


def fnv_points(text: Column) -> Column:
    """Over code points, as queue names take it."""
    return _fnv(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), lambda x: F.ascii(x).cast("long")))


def canonical_json(value: object) -> str:
    """Canonical JSON for values without fractions: sorted keys (by UTF-16), no spaces, raw characters."""
    order = lambda x: x.encode("utf-16-be")
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=order)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float):
        return json.dumps(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def replay_digest(text: Column) -> Column:
    """SHA-256 of the canonical form of JSON text."""
    return _mapped(lambda x: hashlib.sha256(canonical_json(json.loads(x)).encode()).hexdigest(), text)


def preimage(tree: object) -> bytes:
    """Injective rendering of nested lists and strings, for fingerprints."""
    if isinstance(tree, str):
        raw = tree.encode()
        return b"s%d:" % len(raw) + raw
    return b"l%d:" % len(tree) + b"".join(map(preimage, tree))


def fingerprint(kind: str, tree: object) -> str:
    return f"{kind}:{hashlib.sha256(preimage([kind, tree])).hexdigest()}"


def sanitised(name: Column) -> Column:
    """Lower case, runs of illegal characters as one underscore, none at the ends, a letter first."""
    low = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), "_+", "_")
    low = F.regexp_replace(low, "^_|_$", "")
    return F.when(low == "", "q").when(low.rlike("^[a-z]"), low).otherwise(F.concat(F.lit("q"), low))


def queue_name(name: Column) -> Column:
    """Physical name: a long one, or one that looks like a dead-letter queue, is cut and gets a hash."""
    base = sanitised(name)
    cut = F.regexp_replace(F.substring(base, 1, NAME_PREFIX), "_+$", "")
    hashed = F.concat_ws("_", F.when(cut == "", "q").otherwise(cut), fnv_points(name))
    return F.when((F.length(base) <= NAME_MOST) & ~base.endswith("_dlq"), base).otherwise(hashed)


def type_id_ok(text: Column, prefix: str) -> Column:
    """Prefix, underscore, 26 characters of lower-case base 32 whose version nibble is 7 and variant RFC."""
    digits = "0123456789abcdefghjkmnpqrstvwxyz"
    body = F.substring(text, len(prefix) + 2 if prefix else 1, 26)
    value = lambda at: F.instr(F.lit(digits), F.substring(body, at, 1)) - 1
    # The 11th digit holds bits 48 to 52 of the UUID, the first four of which are the version; the 14th holds bits 63
    # to 67, of which 64 and 65 are the variant.
    version = F.shiftright(value(11).cast("int"), 1)
    variant = F.shiftright(value(14).cast("int"), 2) % 4
    head = f"{prefix}_" if prefix else ""
    return text.rlike(f"^{head}[0-7][{digits}]{{25}}$") & (version == 7) & (variant == 2)


def rejection_code_ok(code: Column, detail: Column, most: int = 1024) -> Column:
    return code.rlike("^[a-z][a-z0-9._-]{0,63}$") & (F.octet_length(detail) <= most)
