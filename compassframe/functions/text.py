"""Text normalisers, hashes and feature columns.

Unicode normalisation and case folding have no JVM-side function, so they run as Arrow UDFs.
Rows that are pure ASCII never need them: the UDF sees NULL for those and the text itself stays
in the JVM.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compassframe.functions.barrier import settle
from compassframe.functions.lexicon import SPACE

NON_ASCII = r"[^\x00-\x7f]"
#: Texts a Python worker holds as strings at a time.
UDF_ROWS = 200
WORD_TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)?"  # fixed value


def _by_slices(texts: pa.Array, form) -> pa.Array:
    """form of each text. Only UDF_ROWS texts and results at a time are Python strings, however long the batch."""
    done = [
        pa.array([None if v is None else form(v) for v in texts.slice(i, UDF_ROWS).to_pylist()], pa.string())
        for i in range(0, len(texts), UDF_ROWS)
    ]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return _by_slices(s, lambda v: unicodedata.normalize("NFC", v))


@F.arrow_udf(T.StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    return _by_slices(s, lambda v: unicodedata.normalize("NFKC", v))


@F.arrow_udf(T.StringType())
def _nfkc_casefold(s: pa.Array) -> pa.Array:
    return _by_slices(s, lambda v: unicodedata.normalize("NFKC", v).casefold())


def _only_non_ascii(udf, text: Column, ascii_form: Column) -> Column:
    return F.coalesce(udf(F.when(text.rlike(NON_ASCII), text)), ascii_form)


def nfkc(text: Column) -> Column:
    return _only_non_ascii(_nfkc, text, text)


def nfc(text: Column) -> Column:
    return _only_non_ascii(_nfc, text, text)


def nfkc_casefold(text: Column) -> Column:
    return _only_non_ascii(_nfkc_casefold, text, F.lower(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_nfc(text: Column) -> Column:
    """Prompt as stored: NFC, LF line ends, outer whitespace removed."""
    return strip(F.replace(nfc(text), F.lit("\r\n"), F.lit("\n")))


def fingerprint(text: Column) -> Column:
    """SHA-256 over the visible characters only; equal for texts that differ in spacing."""
    return F.sha2(F.regexp_replace(nfc(text), rf"[{SPACE}\p{{C}}]+", ""), 256)


def canonical(text: Column) -> Column:
    """Form used for duplicate detection: NFKC, case-folded, controls and runs of space to one space."""
    return F.trim(F.regexp_replace(nfkc_casefold(text), rf"[{SPACE}\p{{C}}]+", " "))


def with_battle_prompt(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Prompt of a preference row: a JSON list of strings or of {content}, else the text itself.

    Stages are settled so that a text is parsed and normalised once.
    """
    parsed = settle(df.withColumn("_json", F.try_parse_json(F.col(raw))), ["_json"])
    items = F.try_variant_get("_json", "$", "array<variant>")
    part = F.transform(
        items,
        lambda v: F.coalesce(F.try_variant_get(v, "$.content", "string"), v.cast("string")),
    )
    is_list = F.coalesce(F.schema_of_variant("_json").startswith("ARRAY"), F.lit(False))
    text = F.when(is_list, F.array_join(part, "\n")).otherwise(
        F.coalesce(F.try_variant_get("_json", "$", "string"), F.col(raw))
    )
    joined = settle(parsed.withColumn("_text", text), ["_text"])
    lines = F.regexp_replace(nfc(F.col("_text")), r"\r\n|[\x{2028}\x{2029}]", "\n")
    return joined.withColumn(out, strip(lines)).drop("_json", "_text")


def word_tokens(canonical_text: Column, limit: int | None = None) -> Column:
    """The tokens of the whole text, or its first ``limit`` if a caller wants no more."""
    tokens = F.regexp_extract_all(canonical_text, F.lit(WORD_TOKEN), F.lit(0))
    return tokens if limit is None else F.slice(tokens, 1, limit)


def trigram_hashes(tokens: Column) -> Column:
    """Distinct 64-bit hashes of three-token windows; empty below three tokens."""
    at = lambda i: F.get(tokens, i)
    windows = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - 3),
        lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)),
    )
    return F.when(F.size(tokens) >= 3, F.array_distinct(windows)).otherwise(
        F.array().cast("array<bigint>")
    )


def length_band(length: Column) -> Column:
    return (
        F.when(length < 128, "lt_128")
        .when(length < 512, "128_511")
        .when(length < 2048, "512_2047")
        .otherwise("gte_2048")
    )


def hex_fraction(hex_digest: Column) -> Column:
    """First 64 bits of a hex digest as a fraction of 2**64."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def hash60(text: Column) -> Column:
    """60-bit non-negative hash from md5, reproducible in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def stable_split(key: Column, salt: str, names: tuple[str, str, str]) -> Column:
    """60/20/20 split that depends on the salted key alone."""
    x = hex_fraction(F.sha2(F.concat(F.lit(salt), key), 256))
    return F.when(x < 0.6, names[0]).when(x < 0.8, names[1]).otherwise(names[2])


def seeded_index(key: Column, seed: int, size: int) -> Column:
    """Unsigned 64-bit digest of seed and key, modulo the pool size."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), key), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(size)).cast("int")


def row_key(dataset: str, revision: str, row_id: Column, text_digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(dataset), F.lit(revision), row_id.cast("string"), text_digest), 256)


def round8(x: Column) -> Column:
    """Half-even rounding to eight digits, for the edge of a report."""
    return F.bround(x, 8)
