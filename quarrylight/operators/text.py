"""Row-wise text operators on documents and queries, and the filter by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylight.functions.text import java_pattern, transform_text, word_count
from quarrylight.schemas import require


def _present(df: DataFrame, content: str, key: str) -> DataFrame:
    return require(df, F.col(content).isNotNull(), F.concat(F.lit("null content of "), F.coalesce(F.col(key).cast("string"), F.lit("a row without id"))))


def preprocess(df: DataFrame, content: str = "content", key: str = "id", nulls: str = "error", **options) -> DataFrame:
    """Documents or queries with their content transformed; all other columns as they were.

    ``options`` are those of :func:`quarrylight.functions.text.transform_text`. ``nulls``:
    ``error`` raises on reading a null content, ``keep`` leaves it null. An empty content
    becomes prefix and suffix.
    """
    if nulls not in ("error", "keep"):
        raise ValueError("nulls must be 'error' or 'keep'")
    checked = _present(df, content, key) if nulls == "error" else df
    return checked.withColumn(content, transform_text(F.col(content), **options))


def repeat_query(df: DataFrame, separator: str = " ", content: str = "content") -> DataFrame:
    """Queries whose content stands twice with a separator; a null content stays null."""
    return df.withColumn(content, F.concat(F.col(content), F.lit(separator), F.col(content)))


def identity_parse(df: DataFrame, content: str = "content", key: str = "id") -> DataFrame:
    """Documents unchanged; a null content raises and names the document."""
    return _present(df, content, key)


def query_text(df: DataFrame, content: str = "content", key: str = "id") -> DataFrame:
    """The contents of queries as a column ``text``; a null content raises."""
    return _present(df, content, key).select(F.col(content).alias("text"))


def accepts(content: Column, include_regex: str | None = None, exclude_regex: str | None = None, min_words: int | None = None, max_words: int | None = None, flags: str = "") -> Column:
    """Whether a content has the wanted number of words and matches the patterns; null for null.

    Bounds are inclusive. A pattern is searched anywhere; an empty one counts as none.
    ``flags`` are inline ones such as ``im``.
    """
    ok = content.isNotNull()
    n = word_count(content)
    lead = f"(?{flags})" if flags else ""
    if min_words is not None:
        ok &= n >= min_words
    if max_words is not None:
        ok &= n <= max_words
    if include_regex:
        ok &= content.rlike(lead + java_pattern(include_regex))
    if exclude_regex:
        ok &= ~content.rlike(lead + java_pattern(exclude_regex))
    return F.when(content.isNotNull(), ok)


def filter_by_content(df: DataFrame, content: str = "content", key: str = "id", nulls: str = "error", **options) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) documents by :func:`accepts`; both read the source once each.

    ``nulls``: ``error`` raises on a null content, ``reject`` puts its row among the rejected.
    """
    if nulls not in ("error", "reject"):
        raise ValueError("nulls must be 'error' or 'reject'")
    checked = _present(df, content, key) if nulls == "error" else df
    ok = F.coalesce(accepts(F.col(content), **options), F.lit(False))
    return checked.where(ok), checked.where(~ok)
