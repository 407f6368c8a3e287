"""Identities of generations, overlays, jobs and chunks as Column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank

MOST_FIELD, MOST_PAYLOAD = 256, 2048


def lines_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, one to a line; a null is an empty line."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def generation_id(fields: list[Column], semantic_version: Column) -> Column:
    """SHA-256 of the nine fields of a generation, one to a line; the semantic version is a tenth if it is above 0."""
    own = F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.sha2(F.when(semantic_version > 0, F.concat(own, F.lit("\n"), semantic_version.cast("string"))).otherwise(own), 256)


def overlay_id(generation: Column, base_tree: Column, target_tree: Column, commit: Column, kind: Column, content_hash: Column) -> Column:
    return lines_hash(generation, base_tree, target_tree, commit, kind, content_hash)


def query_key(prefix: str, model: Column, commit: Column, prompt: Column) -> Column:
    """Key under which equal queries share a job."""
    return F.concat(F.lit(prefix), F.upper(F.sha2(F.concat_ws("\0", model, commit, prompt), 256)))


def batch_key(prefix: str, model: Column, inputs: Column) -> Column:
    """Key under which equal batches share a job: the model, then each input with a NUL."""
    return F.concat(F.lit(prefix), F.upper(F.sha2(F.concat(model, F.array_join(F.transform(inputs, lambda x: F.concat(x, F.lit("\0"))), "")), 256)))


def query_prompt(model: Column, query: Column, task: str) -> Column:
    """The query with an instruction before it, for models that were trained with one."""
    return F.when(F.lower(model).contains("qwen3-embedding"), F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)).otherwise(query)


def same_snapshot(left: list[Column], right: list[Column]) -> Column:
    """All identities are equal; nulls equal each other."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def ready(state: Column, own: list[Column], wanted: list[Column]) -> Column:
    return state.isin("Current", "DirtyCurrent") & same_snapshot(own, wanted)


# Chunk ids: "cs1." + base64url(payload) + "." + base64url(SHA-256 of the payload).


def _base64url(binary: Column) -> Column:
    return F.translate(F.base64(binary), "+/=\r\n", "-_")  # the last three go


def _byte(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def _hex_string(text: Column) -> Column:
    """The bytes of a text after their number (seven bits a byte, low bits first), in hex."""
    n = F.octet_length(text)
    return F.concat(F.when(n < 128, _byte(n)).otherwise(F.concat(_byte(n % 128 + 128), _byte((n / 128).cast("int")))), F.hex(F.encode(text, "UTF-8")))


def chunk_id(repository: Column, generation: Column, tree: Column, dirty: Column, ordinal: Column) -> Column:
    """Null where a field is blank or too long or the ordinal is negative."""
    number = F.lpad(F.hex(ordinal.cast("int")), 8, "0")
    little = F.concat(*[F.substring(number, k, 2) for k in (7, 5, 3, 1)])
    payload = F.unhex(F.concat(F.lit("01"), *map(_hex_string, (repository, generation, tree)), F.when(dirty.isNull(), "00").otherwise(F.concat(F.lit("01"), _hex_string(F.coalesce(dirty, F.lit(""))))), little))
    good = (ordinal >= 0) & (F.coalesce(F.length(dirty), F.lit(0)) <= MOST_FIELD)
    for field in (repository, generation, tree):
        good = good & ~blank(field) & (F.length(field) <= MOST_FIELD)
    written = lambda p: F.when(F.octet_length(p) <= MOST_PAYLOAD, F.concat(F.lit("cs1."), _base64url(p), F.lit("."), _base64url(F.unhex(F.sha2(p, 256)))))
    return F.when(good, F.get(F.transform(F.array(payload), written), F.lit(0)))  # the payload is made once


def _field(data: bytes, at: int) -> tuple[str | None, int]:
    """The text at a place, after the number of its bytes (``_hex_string``), and the place behind it; no text where the bytes end before."""
    size, shift = 0, 0
    while at < len(data) and shift < 14:
        size |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 128:
            return (data[at : at + size].decode("utf-8", "replace"), at + size) if at + size <= len(data) else (None, at)
    return None, at


def _decoded(data: bytes) -> tuple | None:
    """repository, generation, tree, dirty and ordinal of a payload that is whole."""
    fields, at = [], 1
    if data[:1] != b"\x01":
        return None
    for name in ("repository", "generation", "tree", "dirty"):
        if name == "dirty":
            flag, at = data[at : at + 1], at + 1
            if flag == b"\0":
                fields.append(None)
                continue
            if flag != b"\x01":
                return None
        text, at = _field(data, at)
        if text is None:
            return None
        fields.append(text)
    return (*fields, int.from_bytes(data[at:], "little", signed=True)) if len(data) == at + 4 else None


def parsed_chunk_ids(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``problem`` (chunk_id_malformed, chunk_id_tampered or null) and, without one, repository, generation, tree, dirty and ordinal of the chunk id.

    Bytes, digests and lengths are compared JVM-side in one projection; only payloads that are sound and genuine are read, in Arrow batches.
    """
    part = F.split(F.col(column), r"\.")
    plain = lambda c: F.expr(f"try_to_binary(rpad(translate({c}, '-_', '+/'), cast(ceil(length({c}) / 4.0) * 4 as int), '='), 'base64')")
    shape = F.col(column).rlike(r"^cs1\.[A-Za-z0-9_-]{1,2731}\.[A-Za-z0-9_-]{43}$")
    kind = "repository string, generation string, tree string, dirty string, ordinal bigint"

    @F.arrow_udf(f"struct<{kind.replace(' string', ':string').replace(' bigint', ':bigint')}>")
    def decoded(payload: pa.Array) -> pa.Array:
        return pa.array([None if g is None else dict(zip(("repository", "generation", "tree", "dirty", "ordinal"), g, strict=True)) for g in (None if p is None else _decoded(p) for p in payload.to_pylist())], pa.struct([("repository", pa.string()), ("generation", pa.string()), ("tree", pa.string()), ("dirty", pa.string()), ("ordinal", pa.int64())]))

    got = rows.withColumn("_p", F.when(shape, F.get(part, F.lit(1)))).withColumn("_d", F.when(shape, F.get(part, F.lit(2))))
    got = got.withColumn("_payload", plain("_p")).withColumn("_digest", plain("_d"))
    canonical = (_base64url(F.col("_payload")) == F.col("_p")) & (_base64url(F.col("_digest")) == F.col("_d")) & (F.octet_length("_payload") <= MOST_PAYLOAD)
    genuine = F.coalesce(F.unhex(F.sha2("_payload", 256)) == F.col("_digest"), F.lit(False))
    told = F.when(~F.coalesce(canonical, F.lit(False)), "chunk_id_malformed").when(~genuine, "chunk_id_tampered")
    got = got.withColumn("problem", told).withColumn("_payload", F.when(F.col("problem").isNull(), F.col("_payload"))).withColumn("_fields", decoded("_payload"))
    names = ("repository", "generation", "tree", "dirty", "ordinal")
    got = got.withColumns({n: F.col(f"_fields.{n}") for n in names})
    return got.withColumn("problem", F.coalesce("problem", F.when(F.col("_fields").isNull(), "chunk_id_malformed"))).drop("_p", "_d", "_payload", "_digest", "_fields")


def chunk_mismatch(actual: dict[str, Column], ordinal: Column, chunks: Column) -> Column:
    """The first way in which a parsed chunk id differs from the snapshot that answers; null if it doesn't."""
    out = None
    for name, code in (("repository", "wrong_repository"), ("generation", "stale_generation"), ("tree", "stale_worktree"), ("dirty", "stale_overlay")):
        differs = ~F.col(name).eqNullSafe(actual[name])
        out = F.when(differs, code) if out is None else out.when(differs, code)
    return out.when((ordinal < 0) | (ordinal >= chunks), "chunk_out_of_range")
