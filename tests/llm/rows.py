"""Small document tables with the cases every operator must handle."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string"

#: Nulls, empty and blank texts, a very long one, ties and repeated rows, columns with clashing names.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60, 0.1, "x"),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60, 0.1, "x"),
    (2, "The quick brown fox jumps over the lazy dog again and again.", "en", "b", 60, None, None),
    (3, "", "en", "a", 0, 0.2, "y"),
    (4, None, None, None, None, None, None),
    (5, " \t\n ", "de", "a", 4, 0.3, "z"),
    (6, "word " * 60_000, "en", "a", 300_000, 0.4, "z"),
    (7, "x" * 100_000, "fr", "a", 100_000, 0.5, "z"),
    (None, "Ein Text ohne Nummer, mit Umlauten: äöü ÄÖÜ ß.", "de", "a", 45, 0.6, "z"),
    (8, "Same id, first text.", "en", "a", 20, 0.7, "z"),
    (8, "Same id, second text.", "en", "a", 21, 0.7, "z"),
    (9, "emoji \U0001f600 and İ and \x01\x02 control", "en", "a", 30, 0.8, "z"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
