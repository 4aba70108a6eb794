"""Text functions as Column expressions; but for ``line_groups`` nothing here leaves the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def strip_html(html: Column) -> Column:
    """Tags to spaces, white space collapsed, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def clean_lines(text: Column, cap: int = 20_000) -> Column:
    """Lines trimmed, blank ones dropped, at most ``cap`` characters."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 1, cap)


def compact_constraints(text: Column) -> Column:
    """Bullets taken off each line; what is left joined by spaces."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[-* \t]+|[-* \t]+$", "")), lambda x: x != ""), " ")


#: Code point ranges read as Chinese, Korean or Japanese.
CJK_RANGES = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{AC00}-\x{D7AF}\x{3040}-\x{30FF}"


def detect_language(text: Column, share: float = 0.30) -> Column:
    """zh where more than ``share`` of the characters are in these ranges, else en; empty and null texts are en."""
    n = F.length(text)
    return F.when((n > 0) & (F.length(F.regexp_replace(text, f"[^{CJK_RANGES}]", "")) / F.greatest(n, F.lit(1)) > share), "zh").otherwise("en")


def looks_binary(text: Column, sample: int = 1024, share: float = 0.3) -> Column:
    """More than ``share`` of the first ``sample`` characters are control or replacement characters."""
    head = F.substring(text, 1, sample)
    odd = F.length(F.regexp_replace(head, r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]", ""))
    return F.coalesce((F.length(head) > 0) & (odd / F.greatest(F.length(head), F.lit(1)) > share), F.lit(False))


def pdf_text_is_sparse(text: Column, size_bytes: Column) -> Column:
    """Fewer characters, white space and punctuation apart, than max(500, 500 per 50,000 bytes); always for null or empty text."""
    kept = F.length(F.regexp_replace(text, r"""[\s'".,;:!?\-–—()\[\]{}|/]""", ""))
    return F.coalesce(kept, F.lit(0)) < F.greatest(F.lit(500), F.floor(size_bytes / 50_000) * 500)


def statement(subject: Column, predicate: Column, obj: Column) -> Column:
    """Trimmed non-empty parts joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in (subject, predicate, obj)])


def contains_folded(text: Column, part: Column) -> Column:
    """Whether ``part`` occurs in ``text``, letter case apart; never for empty ``part``."""
    return F.coalesce((F.length(part) > 0) & F.contains(F.lower(text), F.lower(part)), F.lit(False))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """${name} replaced; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def json_span(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_dot(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def source_links(urls: Column) -> Column:
    """[Source i](url) for each non-blank url, numbered by its place among all."""
    each = F.transform(urls, lambda u, i: F.when(F.trim(u) != "", F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]("), u, F.lit(")"))))
    return F.array_join(F.filter(each, lambda x: x.isNotNull()), ", ")


#: Names of model providers.
PROVIDERS = {"openai-compatible": "openai", "openai_compatible": "openai", "siliconflow": "openai", "online": "openai"}


def provider(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("ollama"))))
    out = low
    for alias, value in PROVIDERS.items():
        out = F.when(low == alias, value).otherwise(out)
    return out


#: Parts of messages of errors that stay, of errors that pass, of size limits, of connections, of quotas.
PERMANENT = "404|403|401|invalid url|net::err_name_not_resolved|net::err_aborted"
TRANSIENT = "timeout|timed out|connection reset|connection refused|dns|network|eof occurred|broken pipe|temporarily unavailable|429|503"
TOO_LARGE = "exceed|context length|input length"
CONNECTION = "refused|10061|timeout|timed out|connection reset"
QUOTA = "quota|rate.?limit|daily.?limit|limit.?exceeded|too.?many.?request|429"


def error_class(message: Column) -> Column:
    """permanent, transient or other; a permanent word outweighs a transient one."""
    low = F.lower(message)
    return F.when(low.rlike(PERMANENT), "permanent").when(low.rlike(TRANSIENT), "transient").otherwise("other")


def index_error_class(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike(TOO_LARGE), "size").when(low.rlike(CONNECTION), "connection").otherwise("other")


def quota_error(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(QUOTA), F.lit(False))


def traffic_light(percent: Column) -> Column:
    return F.when(percent < 60, "green").when(percent < 85, "yellow").otherwise("red")


def shards(text: Column, size: int) -> Column:
    """Slices of exactly ``size`` characters, the last one shorter; one empty slice for empty text."""
    last = F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def token_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` white-space tokens, each starting ``size - overlap`` after the last."""
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - overlap, F.lit(1)), F.lit(step))
    return F.transform(starts, lambda s: F.array_join(F.slice(tokens, s, F.lit(size)), " "))


@F.pandas_udf(ArrayType(StringType()))
def _packed(texts: pd.Series, limits: pd.Series) -> pd.Series:
    out = []
    for text, limit in zip(texts, limits):
        parts: list[list[str]] = []
        size = 0
        for line in re.split("(?<=\n)", text) if text is not None else ():
            if parts and (not size or size + len(line) <= limit):
                parts[-1].append(line)
                size += len(line)
            elif line:
                parts.append([line])
                size = len(line)
        out.append(None if text is None else ["".join(p) for p in parts])
    return pd.Series(out)


def line_groups(text: Column, limit: int) -> Column:
    """Lines packed greedily into parts of at most ``limit`` characters (line feeds included); longer lines stay whole.

    In time linear in the text, over Arrow batches; empty text has no part.
    """
    return _packed(text, F.lit(limit))
