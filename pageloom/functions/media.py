"""Data URIs and image types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _let

# Leading bytes (hex, as LIKE patterns) by type.
SIGNATURES = (
    ("89504E470D0A1A0A%", "image/png"),
    ("FFD8FF%", "image/jpeg"),
    ("474946383761%", "image/gif"),
    ("474946383961%", "image/gif"),
    ("52494646________574542505650%", "image/webp"),
    ("424D%", "image/bmp"),
    ("00000100%", "image/x-icon"),
    ("00000200%", "image/x-icon"),
    ("255044462D%", "application/pdf"),
    ("504B0304%", "application/zip"),
    ("1F8B08%", "application/x-gzip"),
)


def encode_base64(data: Column) -> Column:
    """One unbroken line; the built-in wraps every 76 characters."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def encode_data_uri(data: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), encode_base64(data))


def decode_data_uri(uri: Column) -> Column:
    """``struct(data, mime, error)``; exactly one of data and error is set."""

    def parts(p: Column) -> Column:
        header, payload = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        packed = F.regexp_replace(payload, r"[\r\n]", "")
        strict = packed.rlike(r"^[A-Za-z0-9+/]*+={0,2}\z") & (F.length(packed) % 4 == 0)
        data = F.when(strict, F.try_to_binary(packed, F.lit("base64")))
        error = (
            F.when(~uri.startswith("data:"), F.lit("not a data URI"))
            .when(payload.isNull(), F.lit("invalid data URI format"))
            .when(data.isNull(), F.lit("base64 decode failed"))
        )
        mime = F.regexp_replace(F.regexp_replace(header, "^data:", ""), r";base64\z", "")
        return F.struct(
            F.when(error.isNull(), data).alias("data"),
            F.when(error.isNull(), mime).alias("mime"),
            error.alias("error"),
        )

    return _let(F.split(uri, ",", 2), parts)


def sniff_mime(content: Column) -> Column:
    """Type by leading bytes; text unless a binary control byte shows up."""

    def by_signature(head: Column) -> Column:
        out = F.when(head == "", F.lit("text/plain; charset=utf-8"))
        for pattern, mime in SIGNATURES:
            out = out.when(head.like(pattern), F.lit(mime))
        binary = head.rlike(r"^(?:..)*?(?:0[0-8BEF]|1[0-9CDEF]|1A)")
        return out.when(binary, F.lit("application/octet-stream")).otherwise(
            F.lit("text/plain; charset=utf-8")
        )

    return _let(F.hex(F.substring(content, 1, 512)), by_signature)


def image_mime(content_type: Column, content: Column) -> Column:
    """An ``image/`` header is believed, anything else is sniffed; parameters
    are cut off."""
    kind = F.when(F.coalesce(content_type, F.lit("")).startswith("image/"), content_type).otherwise(
        sniff_mime(content)
    )
    return _let(kind, lambda k: F.when(k.contains(";"), F.trim(F.split_part(k, F.lit(";"), F.lit(1)))).otherwise(k))
