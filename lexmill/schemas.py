"""Table schemas and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_S, _L = T.StringType(), T.LongType()

BOOKS = _table(("category", _S, True), ("book", _S, True), ("text", _S, True))
BOOK_WORDS = _table(("category", _S, True), ("book", _S, True), ("word", _S, False), ("cnt", _L, False))
DELETED_WORDS = _table(("category", _S, True), ("book", _S, True), ("deleted_word", _S, False), ("cnt", _L, False), ("merged_to", _S, False))
CATEGORY_WORDS = _table(("category", _S, True), ("word", _S, False), ("cnt", _L, False))
TRANSLATIONS = _table(("word", _S, False), ("cnt", _L, False), ("translation", _S, False))
CACHE = _table(("word", _S, False), ("translation", _S, False))
LEDGER = _table(("book_path", _S, False), ("processed_at", T.TimestampType(), True), ("word_count", _L, True), ("hash", _S, True))
TABLES = {"book_words": BOOK_WORDS, "deleted_words": DELETED_WORDS, "word_intersection": CATEGORY_WORDS, "global_union": CATEGORY_WORDS, "translations": TRANSLATIONS, "translations_cache": CACHE, "processed_books": LEDGER}


@dataclass(frozen=True)
class Settings:
    """Defaults are the values in effect."""

    shortest: int = 3
    longest: int = 17
    #: Words of this length and more are merged if they share a beginning and are spelled alike.
    merge_from: int = 5
    prefix: int = 4
    edits: int = 2
    edit_share: float = 0.25
    length_gap: int = 1
    coverage: float = 0.6
    min_ratio: float = 0.05
    max_ratio: float = 0.4
    min_count: int = 5
    translate_batch: int = 800
    require_both_stop_lists: bool = True


DEFAULT = Settings()
