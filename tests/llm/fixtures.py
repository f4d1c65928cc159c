"""Small tables that hold the hard cases, and brute-force helpers."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(pattern, text, fold=True):
    return pattern.findall(lower(text) if fold else (text or ""))


def prose(seed, n):
    """Words that don't repeat much, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("bcdfghklmnprstvz"[(x >> s) & 15] + "aeiou"[(x >> s + 2) % 5] for s in (3, 9, 15)))
    return out


def docs(spark, rows):
    """documents of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Texts that every operator takes: null, empty, blank, no letters, one word, beyond ASCII, very long, repeated rows.
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "!!! 123 ..."), (5, "word"), (6, "Ünïcödé ﬁ 漢字 \U0001F600 a\x00b"), (7, " ".join(prose(3, 30_000))), (8, "same text here"), (8, "same text here"), (9, "same text here"), (None, "no id"),
]
