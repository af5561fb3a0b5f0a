"""Labels: source and provider names, type tags, cloud classes, and the small parts of an output line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.fixed_values import (
    CENSYS_TLS_PORTS, CLEAN_TAGS, FORM_TYPES, PASSIVE_PREFIX, PROVIDER_LABELS, SHOWN_TYPES, SOURCE_LABELS,
    SUBDOMAIN_TYPES, URL_TYPES,
)
from webloom.functions.urls import bare_ext


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, NULL when absent."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def source_label(source: Column, kind: Column) -> Column:
    """Display name of a source; a passive record is named after its provider."""
    shown = F.when(kind.startswith(PASSIVE_PREFIX), F.replace(kind, F.lit(PASSIVE_PREFIX), F.lit(""))).otherwise(source)
    return F.coalesce(lookup(SOURCE_LABELS, shown), F.upper(shown))


def provider_label(provider: Column) -> Column:
    capitalised = F.concat(F.upper(F.left(provider, F.lit(1))), F.lower(F.substr(provider, F.lit(2))))
    return F.coalesce(lookup(PROVIDER_LABELS, provider), capitalised)


def type_label(kind: Column) -> Column:
    """Upper-case type, for the types that a standard line shows; NULL for the others."""
    return F.when(kind.isin(SHOWN_TYPES), F.upper(F.replace(kind, F.lit("-"), F.lit("_"))))


def clean_tag(kind: Column, url: Column) -> Column:
    """Tag of a clean line: cloud names first, then file kind of a script record, then the type's own tag."""
    low = F.lower(url)
    bucket = low.contains("s3.amazonaws.com") | low.contains("s3-website") | (
        low.contains("s3-") & low.contains(".amazonaws.com")
    )
    ext = bare_ext(url)
    return (
        F.when(bucket, "AWS S3")
        .when(low.contains(".cloudfront.net"), "AWS CloudFront")
        .when((kind == "javascript") & (ext == "css"), "CSS")
        .when((kind == "javascript") & ext.isin("txt", "text"), "TEXT")
        .when((kind == "javascript") & ext.isin("html", "htm"), "HTML")
        .otherwise(F.coalesce(lookup(CLEAN_TAGS, kind), F.lit("URL")))
    )


def aws_class(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("s3.amazonaws.com"), "aws_s3").when(low.contains(".cloudfront.net"), "aws_cloudfront")


def format_length(length: Column) -> Column:
    return F.concat(F.lit("["), F.format_number(length, 0), F.lit(" bytes]"))


def from_tag(origin: Column, width: int | None = None) -> Column:
    """Where a record is from; with ``width``, longer origins are cut and marked."""
    shown = origin if width is None else F.when(
        F.length(origin) > width, F.concat(F.left(origin, F.lit(width)), F.lit("..."))).otherwise(origin)
    return F.when(origin != "", F.concat(F.lit("[from: "), shown, F.lit("]")))


def service_url(host: Column, port: Column, hidden_ports: list[int], tls_ports: list[int]) -> Column:
    """URL of a service: https on a TLS port, the port left out when it is one of ``hidden_ports``."""
    scheme = F.when(port.isin(tls_ports), "https://").otherwise("http://")
    shown = F.when(port.isin(hidden_ports), "") if hidden_ports else F.when(F.lit(False), "")
    return F.concat(scheme, host, shown.otherwise(F.concat(F.lit(":"), port.cast("string"))))


def certificate_url(host: Column, port: Column) -> Column:
    return service_url(host, port, CENSYS_TLS_PORTS, CENSYS_TLS_PORTS)


def bucket_url(path: Column, bucket: Column) -> Column:
    """Full URL of a stored file; a complete URL, or a path without a bucket, is left alone."""
    low = F.lower(bucket)
    place = F.when(low.contains("s3") | low.contains("amazonaws"), bucket).otherwise(
        F.concat(bucket, F.lit(".s3.amazonaws.com"))
    )
    complete = path.startswith("http://") | path.startswith("https://")
    return F.when(complete | bucket.isNull() | (bucket == ""), path).otherwise(
        F.concat(F.lit("https://"), place, F.lit("/"), F.ltrim(path, F.lit("/")))
    )


def is_url_record(kind: Column) -> Column:
    return kind.isin(URL_TYPES) | kind.startswith(PASSIVE_PREFIX)


def is_subdomain_record(kind: Column) -> Column:
    return kind.isin(SUBDOMAIN_TYPES)


def is_form_record(kind: Column) -> Column:
    return kind.isin(FORM_TYPES)
