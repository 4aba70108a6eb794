"""Stable identifiers: a prefix and the first 16 hex digits of a SHA-1 over joined parts. Null parts make a null id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_id(prefix: str, *parts: Column, sep: str = "::", length: int = 16) -> Column:
    joined = parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.lit(sep), p)][1:])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, length))


def triplet_id(subject: Column, predicate: Column, obj: Column, document: Column) -> Column:
    return digest_id("trip_", subject, predicate, obj, document)


def contradiction_id(subject: Column, claim_a: Column, claim_b: Column) -> Column:
    """Depends on the order of the claims."""
    return digest_id("con_", subject, claim_a, claim_b)


def gap_id(question: Column) -> Column:
    return digest_id("gap_", question)


def web_document_id(query: Column, url: Column) -> Column:
    return digest_id("doc_", query, url)


def resource_document_id(path: Column, modified: Column) -> Column:
    return digest_id("doc_res_", path, modified)


def answer_document_id(method: Column, question: Column) -> Column:
    # prefix and form are fixed by the data
    return digest_id("graphrag-", F.concat(F.lit("graphrag:"), method, F.lit(":"), question))


def stable_filename(path: Column) -> Column:
    """Stem with unsafe characters as "_", at most 60, then 12 hex digits of the path's SHA-1, then .txt."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    safe = F.substring(F.regexp_replace(stem, r"(?U)[^\w\-.]", "_"), 1, 60)
    return F.concat(safe, F.lit("_"), F.substring(F.sha1(path), 1, 12), F.lit(".txt"))


def slug(text: Column, length: int = 60, default: str = "research-run") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, length), r"-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))
