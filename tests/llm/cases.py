"""Rows that every operator on documents must stand: nulls, empty and long texts, repeats, clashing columns."""

import random

CLASHING = "size string, shard string, slot string, bucket int, score string, class string, taken int, target string, key int, part int, rep int, id int, a int, start int, cell int, h int, skey int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    base = [
        (1, words(40, 1), "en", "s1"),
        (2, words(40, 1), "en", "s1"),
        (3, words(40, 1) + " end", "en", "s2"),
        (4, "", "de", "s2"),
        (5, None, "de", None),
        (6, " \t\n ", None, "s3"),
        (7, "one", "fr", "s3"),
        (8, words(20000, 2), "fr", "s1"),
        (9, "é ü ß 日本 \U0001f600 \x00 ▁ x", None, ""),
        (10, words(30, 3), None, None),
        (10, words(30, 3), None, None),
        (None, words(30, 4), "en", "s1"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "x", "y", None, 1, "z", "c", 7, "t", 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t, lang, source in base]


def frame(spark, empty=False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)
