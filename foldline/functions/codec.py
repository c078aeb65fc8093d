"""Versioned payloads. Errors are columns; only a codec's own declaration raises."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION_KEY = "schemaVersion"


@dataclass(frozen=True)
class Codec:
    """version: the current one; types: the event types it knows; upcasters: from version k to k + 1."""

    version: int
    types: tuple[str, ...]
    upcasters: Mapping[int, Callable[[Column], Column]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.version < 1:
            raise ValueError("a version is at least 1")
        if len(set(self.types)) < len(self.types):
            raise ValueError("an event type comes twice")
        if any(not 1 <= k < self.version for k in self.upcasters):
            raise ValueError("an upcaster starts outside the versions")
        if missing := set(range(1, self.version)) - set(self.upcasters):
            raise ValueError(f"no upcaster from {sorted(missing)}")

    def encode(self, event_type: Column, metadata: Column) -> tuple[Column, Column]:
        """(metadata with the version, error)."""
        known = event_type.isin(*self.types)
        is_object = metadata.isNull() | metadata.rlike(r"^\s*\{")
        merged = F.to_json(F.map_concat(F.map_filter(F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != VERSION_KEY), F.create_map(F.lit(VERSION_KEY), F.lit(str(self.version)))))
        error = F.when(~known, "unknown-type").when(~is_object, "metadata-not-object")
        return F.when(error.isNull(), merged), error

    def found_version(self, metadata: Column) -> tuple[Column, Column]:
        """(version, error): absent is 1, malformed an error."""
        raw = F.get_json_object(metadata, f"$.{VERSION_KEY}")
        value = raw.try_cast("int")
        return F.coalesce(value, F.when(raw.isNull(), 1)), F.when(raw.isNotNull() & value.isNull(), "malformed-version")

    def migrate(self, version: Column, payload: Column) -> tuple[Column, Column]:
        """(payload at the current version, error)."""
        out = payload
        for k in sorted(self.upcasters):
            out = F.when(version <= k, self.upcasters[k](out)).otherwise(out)
        error = F.when(version > self.version, "version-ahead").when(version < 1, "unknown-version")
        return F.when(error.isNull(), out), error

    def decode(self, df: DataFrame, schema: str, event_type: str = "event_type", metadata: str = "metadata", payload: str = "payload", relevant_only: bool = False) -> DataFrame:
        """Adds ``decoded`` and ``error``. With relevant_only an unknown type is skipped (``outcome`` irrelevant)
        instead of failing.

        Each step is a projection of its own, so that a version is read, a payload lifted and JSON parsed once a row.
        """
        raw = F.get_json_object(F.col(metadata), f"$.{VERSION_KEY}")
        rows = df.select("*", raw.alias("_version_text"), F.col(payload).alias("_payload_now"))
        rows = rows.withColumn("_version", F.coalesce(F.col("_version_text").try_cast("int"), F.when(F.col("_version_text").isNull(), 1)))
        for k in sorted(self.upcasters):
            rows = rows.withColumn("_payload_now", F.when(F.col("_version") <= k, self.upcasters[k](F.col("_payload_now"))).otherwise(F.col("_payload_now")))
        options = {"columnNameOfCorruptRecord": "_corrupt"}
        rows = rows.withColumn("_value", F.from_json(F.when(F.col("_version").between(1, self.version), F.col("_payload_now")), f"{schema}, _corrupt string", options))
        version, known = F.col("_version"), F.col(event_type).isin(*self.types)
        moved = F.when(version.isNull(), "malformed-version").when(version > self.version, "version-ahead").when(version < 1, "unknown-version")
        bad_payload = F.when(F.col("_value").isNull() | F.col("_value._corrupt").isNotNull(), "malformed-payload")
        error = F.when(~known, F.lit("unknown-type")).otherwise(F.coalesce(moved, bad_payload))
        outcome = F.when(~known, "irrelevant" if relevant_only else "failed").when(error.isNotNull(), "failed").otherwise("relevant" if relevant_only else "decoded")
        decoded = F.when(error.isNull(), F.col("_value").dropFields("_corrupt"))
        return rows.select(*df.columns, decoded.alias("decoded"), error.alias("error"), outcome.alias("outcome"))


#: Required headers of an inbound record, in the order of their checks, below the prefix of the sender.
REQUIRED = ("source", "destination", "event-type", "schema-version", "content-type", "message-id")


def kafka_decode(records: DataFrame, prefix: str = "x") -> DataFrame:
    """Envelope columns and the first error of records with a header map: required headers in order, then the
    optional ones; the time defaults to when the record came; a trace state counts only with a trace parent."""
    name = lambda h: h if h in ("content-type", "traceparent", "tracestate") else f"{prefix}-{h}"
    get = lambda h: F.try_element_at("headers", F.lit(name(h)))
    cast = lambda h, kind: get(h).try_cast(kind)
    bad = lambda h, kind: F.when(get(h).isNotNull() & cast(h, kind).isNull(), F.concat_ws(":", F.lit(f"invalid-{kind}"), F.lit(h)))
    uuid_ok = lambda h: get(h).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    bad_uuid = lambda h: F.when(get(h).isNotNull() & ~uuid_ok(h), F.lit(f"invalid-uuid:{h}"))
    checks = []
    for h in REQUIRED:
        checks.append(F.when(get(h).isNull(), F.lit(f"missing:{h}")))
        if h == "schema-version":
            checks.append(bad(h, "int"))
    checks += [bad_uuid("source-event-id"), bad("source-global-position", "bigint"), bad_uuid("causation-id"), bad_uuid("correlation-id"), bad("occurred-at", "timestamp_ntz")]
    error = F.coalesce(*checks)
    return records.select(
        "topic", "partition", "offset", "key", *[get(h).alias(h.replace("-", "_")) for h in REQUIRED if h != "schema-version"], cast("schema-version", "int").alias("schema_version"),
        F.coalesce(cast("occurred-at", "timestamp_ntz"), F.col("received_at")).alias("occurred_at"), get("traceparent").alias("traceparent"),
        F.when(get("traceparent").isNotNull(), get("tracestate")).alias("tracestate"), error.alias("error"),
    )


def kafka_encode(events: DataFrame, prefix: str = "x") -> DataFrame:
    """topic, key, value and headers of outgoing messages; a null header isn't sent."""
    name = lambda h: h if h in ("content-type", "traceparent", "tracestate") else f"{prefix}-{h}"
    heads = F.array(*[F.struct(F.lit(name(h)).alias("name"), F.col(h.replace("-", "_")).cast("string").alias("value")) for h in (*REQUIRED, "traceparent")])
    return events.select(F.col("destination").alias("topic"), "key", F.encode("payload", "utf-8").alias("value"), F.filter(heads, lambda x: x["value"].isNotNull()).alias("headers"))


@dataclass(frozen=True)
class Structural:
    """A struct of the domain and its shape on the wire: field -> (name on the wire, type). Total both ways: what can fail
    is only the parsing of the wire into the shape. A null field isn't written, and one that is missing is null."""

    fields: Mapping[str, tuple[str, str]]

    def __post_init__(self) -> None:
        if len({wire for wire, _ in self.fields.values()}) < len(self.fields):
            raise ValueError("two fields have one name on the wire")

    def to_shape(self, domain: Column) -> Column:
        return F.struct(*[domain[name].cast(kind).alias(wire) for name, (wire, kind) in self.fields.items()])

    def from_shape(self, shape: Column) -> Column:
        return F.struct(*[shape[wire].cast(kind).alias(name) for name, (wire, kind) in self.fields.items()])

    def encode(self, domain: Column) -> Column:
        return F.to_json(self.to_shape(domain))

    def decode(self, wire: Column) -> Column:
        """Null where the wire is no object of the shape."""
        schema = ", ".join(f"`{name}` {kind}" for name, kind in self.fields.values())
        shape = F.from_json(wire, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
        return F.when(shape.isNotNull() & shape["_broken"].isNull(), self.from_shape(shape))

    def law(self, domain: Column) -> Column:
        """Whether a value survives the way to the wire and back."""
        return self.decode(self.encode(domain)).eqNullSafe(self.from_shape(self.to_shape(domain)))


@dataclass(frozen=True)
class Nominal:
    """Names of the domain and what stands for them on the wire, one for one; a name outside of them is null."""

    names: Mapping[str, str]

    def __post_init__(self) -> None:
        if len(set(self.names.values())) < len(self.names):
            raise ValueError("two names have one representation")

    def encode(self, domain: Column) -> Column:
        return F.create_map(*[F.lit(x) for pair in self.names.items() for x in pair])[domain]

    def decode(self, wire: Column) -> Column:
        return F.create_map(*[F.lit(x) for name, stands in self.names.items() for x in (stands, name)])[wire]

    def law(self, domain: Column) -> Column:
        return self.decode(self.encode(domain)).eqNullSafe(domain)
