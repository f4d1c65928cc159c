"""Text functions as Column expressions: they stay in the JVM and need no Python worker.

Offsets and lengths are in code points. Null in gives null out unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the quality score: weights, the share of vowels aimed at, the length of a long word, the sample.
JUNK_WEIGHT, SHORT_WEIGHT, LONG_WEIGHT, MIXED_WEIGHT, VOWEL_WEIGHT = 200.0, 80.0, 100.0, 150.0, 100.0
VOWEL_TARGET, LONG_WORD, SAMPLE = 0.40, 18, 4000


def normalize(text: Column) -> Column:
    """The search form: no leading byte-order mark, line feeds only, NFC, no control characters but line feed and tab."""
    lines = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    composed = F.when(lines.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), lines, F.lit(False)))
    return F.regexp_replace(composed, r"[\p{Cc}&&[^\n\t]]", "")


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\p{L}\p{M}\p{N}]+"), F.lit(0))


def folded_tokens(text: Column) -> Column:
    """Analyzer tokens: case folded, decomposed for compatibility, marks dropped."""
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))
    flat = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), folded, F.lit(True))
    return F.when(text.isNotNull(), F.regexp_extract_all(F.regexp_replace(flat, r"\p{M}", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


#: Fixed values of word breaking: what joins letters, what joins digits, and scripts written without blanks.
_JOINS = r".\u2018\u2019\u2024\uFE52\uFF07\uFF0E'"
JOIN_LETTERS = rf"[:\u00B7\u0387\u055F\u05F4\u2027\uFE13\uFE55\uFF1A{_JOINS}]"
JOIN_DIGITS = rf"[,;\u037E\u0589\u060C\u060D\u066C\u07F8\u2044\uFE10\uFE14\uFE50\uFE54\uFF0C\uFF1B{_JOINS}]"
_SINGLE, _KANA, _RUNS = r"\p{IsHan}\p{IsHiragana}", r"\p{IsKatakana}\u30FC", r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_MORE = r"(?:\p{M}|(?!\u200B)\p{Cf})*"
_LETTER = rf"(?![{_SINGLE}{_KANA}{_RUNS}])[\p{{L}}\p{{Nl}}]{_MORE}"
#: A word by the standard's word breaks: letters, digits and connectors in a row, also over one mark that joins letters or digits; an ideograph by itself; katakana and scripts without blanks as runs.
WORD_BREAKS = (
    rf"[{_SINGLE}]{_MORE}|(?:[{_KANA}]{_MORE})+|(?:[{_RUNS}]{_MORE})+|(?:{_LETTER}(?:{JOIN_LETTERS}{_MORE}{_LETTER})*|\p{{Nd}}{_MORE}(?:{JOIN_DIGITS}{_MORE}\p{{Nd}}{_MORE})*|\p{{Pc}}{_MORE})+"
)
_MORE_JAVA = r"[\p{M}\p{Cf}&&[^\u200B]]*"
#: Latin letters come first in a class: they are most of what is asked, and scripts are slow to look up.
_LATIN = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_LETTER_JAVA = rf"[{_LATIN}[\p{{L}}\p{{Nl}}&&[^{_SINGLE}{_KANA}{_RUNS}]]]{_MORE_JAVA}"
#: The same words by a pattern that only Java reads, and reads faster.
WORD_BREAKS_JAVA = (
    rf"(?=[^\x00-\u024F])(?:[{_SINGLE}]{_MORE_JAVA}|(?:[{_KANA}]{_MORE_JAVA})+|(?:[{_RUNS}]{_MORE_JAVA})+)|(?:{_LETTER_JAVA}(?:{JOIN_LETTERS}{_MORE_JAVA}{_LETTER_JAVA})*|\p{{Nd}}{_MORE_JAVA}(?:{JOIN_DIGITS}{_MORE_JAVA}\p{{Nd}}{_MORE_JAVA})*|\p{{Pc}}{_MORE_JAVA})+"
)
#: Letters with a stroke, which have no decomposition, and what they fold to.
STROKES = {"đ": "d", "ħ": "h", "ł": "l", "ø": "o", "ŧ": "t", "ƀ": "b", "ɨ": "i", "ƶ": "z", "ɇ": "e", "ǥ": "g", "ɉ": "j", "ɍ": "r", "ɏ": "y", "ʉ": "u", "ı": "i"}


def native_digits() -> dict[str, str]:
    """Decimal digits of all scripts with their ASCII ones."""
    each = ((chr(c), unicodedata.decimal(chr(c), None)) for c in range(0x80, 0x20000))
    return {c: str(d) for c, d in each if d is not None}


def standard_tokens(text: Column) -> Column:
    """Analyzer tokens: words by the standard's word breaks, then folded: case, compatibility forms, accents, strokes and digits of all scripts."""
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD_BREAKS_JAVA), F.lit(0)), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    joined = F.array_join(words, "\x1f")  # folded all at once
    cased = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), joined, F.lit(True))
    flat = F.regexp_replace(F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), cased, F.lit(True)), r"\p{M}", "")
    plain = STROKES | native_digits()
    folded = lambda x: F.lower(F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, "".join(plain), "".join(plain.values()))).otherwise(x))
    return F.when(text.isNotNull(), F.filter(F.split(F.transform(F.array(flat), folded)[0], "\x1f"), lambda w: w != ""))  # as an array's element it is computed once


def searchable(text: Column) -> Column:
    """A letter or digit is there, and the text isn't the lone artefact of a doubled encoding."""
    return F.coalesce(text.rlike(r"[\p{L}\p{Nd}]") & (F.regexp_replace(text, r"\s", "") != "Â"), F.lit(False))


def carries_meaning(text: Column) -> Column:
    """Two letters or digits in a row (marks between them don't count), or one character that is a word by itself."""
    return F.coalesce(text.rlike(r"[\p{L}\p{Nd}]\p{M}*[\p{L}\p{Nd}]") | text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"), F.lit(False))


def _half_up(x: Column) -> Column:
    """One decimal, halves upwards."""
    return F.floor(x * 10 + 0.5) / 10.0


def quality_score(text: Column) -> Column:
    """0 to 100 by junk characters, very short and very long words, digits inside words and the share of vowels; null when blank."""
    sample = F.substring(text, 1, SAMPLE)
    chars = F.length(sample)
    words = F.regexp_extract_all(sample, F.lit(r"[A-Za-zÅÄÖåäö\-]+"), F.lit(0))
    tokens = F.regexp_extract_all(sample, F.lit(r"\S+"), F.lit(0))
    count = lambda pattern: F.regexp_count(sample, F.lit(pattern))
    share = lambda items, test: F.size(F.filter(items, test)) / F.greatest(F.size(items), F.lit(1))
    junk = count(r"[^\p{L}\p{Nd}\s.,;:!?\"'()\-—–…/\\\[\]{}<>]")
    letters = count(r"\p{L}")
    vowel = F.when(letters > 0, F.abs(count("[aeiouyåäöAEIOUYÅÄÖ]") / letters - VOWEL_TARGET) * VOWEL_WEIGHT).otherwise(F.lit(0.0))
    score = (
        F.lit(100.0)
        - junk / chars * JUNK_WEIGHT
        - share(words, lambda w: F.length(w) <= 2) * SHORT_WEIGHT
        - share(words, lambda w: F.length(w) >= LONG_WORD) * LONG_WEIGHT
        - share(tokens, lambda t: t.rlike(r"\p{Nd}") & t.rlike("[A-Za-zÅÄÖåäö]")) * MIXED_WEIGHT
        - vowel
    )
    return F.when(sample.rlike(r"\S"), _half_up(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))))


def mean_quality(text: Column, score: Column | None = None) -> Column:
    """Aggregate: mean of the units' scores (a column that has them, so that each is computed once) weighted by sampled length; null when none was scored. Units are added as they come; where their order counts, see quality_sums()."""
    score = quality_score(text) if score is None else score
    chars = F.when(score.isNotNull(), F.least(F.length(text), F.lit(SAMPLE)))
    return _half_up(F.sum(score * chars) / F.sum(chars))


def quality_sums(texts: Column) -> Column:
    """Struct (weighted, chars) of an array of units, as they stand: the sum of scores by sampled length, and of the lengths that were scored.

    A sum of doubles depends on its order, and with it where a mean of exactly half a tenth is rounded to; here it is the units' own.
    """
    scored = F.transform(texts, lambda t: F.struct(quality_score(t).alias("score"), F.least(F.length(t), F.lit(SAMPLE)).alias("chars")))
    empty = F.struct(F.lit(0.0).alias("weighted"), F.lit(0).cast("long").alias("chars"))
    add = lambda s, u: F.struct((s["weighted"] + u["score"] * u["chars"]).alias("weighted"), (s["chars"] + u["chars"]).alias("chars"))
    return F.aggregate(scored, empty, lambda s, u: F.when(u["score"].isNotNull(), add(s, u)).otherwise(s))


def mean_of_sums(sums: Column) -> Column:
    """Aggregate: mean of units' scores out of their quality_sums(); null when none was scored."""
    return _half_up(F.sum(sums["weighted"]) / F.nullif(F.sum(sums["chars"]), F.lit(0)))


def alnum_ratio(text: Column) -> Column:
    """Letters and digits among visible characters; 0 when nothing is visible."""
    visible = F.regexp_count(text, F.lit(r"\S"))
    return F.when(visible > 0, F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]")) / visible).otherwise(F.lit(0.0))


def needs_ocr(text: Column, least: int = 40, ratio: float = 0.5) -> Column:
    """Too few letters and digits to trust a page's own text."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]")) < least) | (alnum_ratio(text) < ratio)


def page_policy(text: Column, coverage: Column, readable: Column, good: float = 75.0, covered: float = 0.25) -> Column:
    """Whether a page is read again: unreadable and text-poor pages are; well-scored ones aren't; else by image coverage."""
    return F.when(~readable, True).when(needs_ocr(text), True).when(quality_score(text) >= good, False).otherwise(coverage >= covered)


def near_dup_words(text: Column) -> Column:
    """The distinct lower-cased words that near-duplicates are judged by."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def is_near_duplicate(a: Column, b: Column, least: float = 0.9) -> Column:
    """Shared words over the larger word set; empty sets are never duplicates."""
    larger = F.greatest(F.size(a), F.size(b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) >= least * larger)


def escape_evidence(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def citations(answer: Column) -> Column:
    """Distinct evidence ids cited as [S1], in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def extension(name: Column) -> Column:
    """The last extension in lower case; empty for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def text_digest(stored: Column, text: Column) -> Column:
    """A stored digest, or the text's own."""
    return F.coalesce(stored, F.sha2(text, 256))


def fingerprint(**settings: Column) -> Column:
    """SHA-256 of ordered key=value lines."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in settings.items()]), 256)


def describe_location(kind: Column, first: Column, last: Column, name: Column) -> Column:
    """A reader's label for a place in a document."""
    span = lambda one, many: F.when(first == last, F.concat(F.lit(one + " "), first.cast("string"))).otherwise(F.concat(F.lit(many + " "), first.cast("string"), F.lit("–"), last.cast("string")))
    return (
        F.when(kind == "pdf_page", F.concat(F.lit("Page "), first.cast("string")))
        .when(kind == "slide", F.concat(F.lit("Slide "), first.cast("string")))
        .when(kind == "text_lines", span("Line", "Lines"))
        .when(kind == "word_section", F.coalesce(name, span("Paragraph", "Paragraphs")))
        .when(kind == "spreadsheet_range", F.concat(name, F.lit(" rows "), first.cast("string"), F.lit("–"), last.cast("string")))
        .when(kind.isin("html_section", "ebook_section"), F.coalesce(name, F.lit("Document")))
        .otherwise(F.lit("Image"))
    )


def like_pattern(user_text: str) -> str:
    """A LIKE pattern that finds the user's text anywhere, its own wildcards taken literally."""
    for c in "\\%_":
        user_text = user_text.replace(c, "\\" + c)
    return f"%{user_text}%"


def column_letter(number: Column) -> Column:
    """A spreadsheet column's letters for a number from 1 (up to three letters). Beyond ZZZ, which no sheet has, the first character counts on by code points."""
    n = number - 1
    letter = lambda k: F.decode(F.unhex(F.lpad(F.hex(F.lit(65) + k), 8, "0")), "UTF-32")  # noqa: E731 (char() takes its number modulo 256)
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(n / 26) - 1), letter(n % 26)))
        .otherwise(F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26) % 26), letter((n - 702) % 26)))
    )


def map_offset(offset: Column, edits: Column, end: bool = False) -> Column:
    """An offset before edits (array of start, end, replacement, in order) as one after them.

    Inside an edit a start goes to the edit's start and an end to the edit's end.
    """
    moved = F.aggregate(
        edits, F.lit(0), lambda d, e: d + F.when(e["end"] <= offset, F.length(e["replacement"]) - (e["end"] - e["start"])).otherwise(F.lit(0))
    )
    inside = F.filter(edits, lambda e: (e["start"] < offset) & (offset < e["end"]))
    at = inside[0]
    held = at["start"] + moved + (F.length(at["replacement"]) if end else F.lit(0))
    return F.when(F.size(inside) > 0, held).otherwise(offset + moved)
