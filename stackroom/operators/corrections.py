"""Find-and-replace rules over texts: whole words, longest match first, never twice over one place."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar} ]+")
_WORD = r"[\p{L}\p{M}\p{Nd}]"
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType()), T.StructField("rule", T.StringType())]))


@dataclass(frozen=True)
class Rule:
    id: str
    find: str
    replace: str
    exact: bool = False

    def normalized(self) -> Rule:
        clean = lambda s: " ".join(unicodedata.normalize("NFC", s).split())
        if not clean(self.find):
            raise ValueError("a rule finds something")
        return Rule(self.id, clean(self.find), clean(self.replace), self.exact)


def list_fingerprint(rules: list[Rule]) -> str:
    """The same for the same rules in any order."""
    lines = sorted("\t".join((r.find, r.replace, str(int(r.exact)))) for r in map(Rule.normalized, rules))
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    replacement: str
    rule: str


class Matcher:
    """Applies rules in one pass; the result doesn't depend on their order."""

    def __init__(self, rules: list[Rule]):
        self.rules = []
        for r in map(Rule.normalized, rules):
            words = [regex.escape(w, special_only=True) for w in r.find.split(" ")]
            body = r"\s+".join(words)
            if not _SPACELESS.fullmatch(r.find):
                body = f"(?<!{_WORD})(?={_WORD}){body}(?!{_WORD})"
            self.rules.append((r, regex.compile(body, regex.V1 | (0 if r.exact else regex.IGNORECASE | regex.FULLCASE))))

    def edits(self, text: str) -> list[Edit]:
        view, places = _composed(text)
        found = []
        for r, pattern in self.rules:
            for m in pattern.finditer(view, overlapped=True):
                found.append((m.start(), -(m.end() - m.start()), not r.exact, r.id, r, m[0]))
        out, at = [], 0
        for start, size, _, _, rule, matched in sorted(found, key=lambda x: x[:4]):
            if start < at:
                continue
            a, b = (places[start], places[start - size]) if places else (start, start - size)
            if a < 0 or b < 0:
                continue
            at = start - size
            new = _written(rule, matched)
            if new != text[a:b]:
                out.append(Edit(a, b, new, rule.id))
        return out

    def apply(self, text: str) -> tuple[str, list[Edit]]:
        edits = self.edits(text)
        out, at = [], 0
        for e in edits:
            out += [text[at : e.start], e.replacement]
            at = e.end
        return "".join([*out, text[at:]]), edits


def _composed(text: str) -> tuple[str, list[int] | None]:
    """The text in NFC, and for each of its places the one in the text (-1 inside a composition); None if it was NFC."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    view, places, first = "", [], 0
    for i in range(1, len(text) + 1):
        if i < len(text) and (unicodedata.combining(text[i]) or 0x1161 <= ord(text[i]) <= 0x11C2):
            continue
        part = unicodedata.normalize("NFC", text[first:i])
        places += [first] + [-1] * (len(part) - 1)
        view += part
        first = i
    return view, [*places, len(text)]


def _written(rule: Rule, matched: str) -> str:
    """The replacement in the matched text's case and with its white space."""
    new = rule.replace if rule.exact else _cased(rule.replace, matched)
    words = new.split(" ")
    gaps = regex.findall(r"\s+", matched)
    if len(rule.find.split(" ")) < 2 or len(words) != len(gaps) + 1:
        return new
    return "".join(w + g for w, g in zip(words, [*gaps, ""], strict=True))


def _cased(new: str, matched: str) -> str:
    cased = [c for c in matched if c.lower() != c.upper()]
    if cased and all(c.isupper() for c in cased):
        return new.upper()
    if any(c.isupper() or c.istitle() for c in new):
        return new
    if cased and cased[0].isupper() and not any(c.isupper() for c in cased[1:]) and new:
        return new[0].title() + new[1:]
    return new


def correct(units: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """All columns with corrected (text) and edits. Rules are few and travel with the code."""
    schema = T.StructType([*units.schema.fields, T.StructField("corrected", T.StringType()), T.StructField("edits", EDITS)])
    rules = list(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(rules)
        for pdf in batches:
            done = [(None, None) if t is None else matcher.apply(t) for t in pdf[text_col]]
            yield pdf.assign(corrected=[t for t, _ in done], edits=[None if e is None else [(x.start, x.end, x.replacement, x.rule) for x in e] for _, e in done])

    return units.mapInPandas(run, schema)


def counts_by_rule(corrected: DataFrame) -> DataFrame:
    """How many places each rule rewrote."""
    return corrected.select(F.explode("edits").alias("e")).groupBy(F.col("e.rule").alias("rule")).agg(F.count("*").alias("n"))


def preview(corrected: DataFrame, key: str = "doc_id", text_col: str = "text", examples: int = 5, around: int = 60) -> tuple[DataFrame, DataFrame]:
    """(matches, changed documents), and the first examples with their surroundings."""
    hits = corrected.select(key, F.col(text_col).alias("_t"), F.explode("edits").alias("e"))
    totals = hits.agg(F.count("*").alias("matches"), F.countDistinct(key).alias("documents"))
    first = hits.orderBy(key, "e.start").limit(examples)
    begin = F.greatest(F.col("e.start") - around, F.lit(0))
    shown = first.select(key, F.col("e.start").alias("start"), F.substring("_t", begin + 1, F.col("e.start") - begin).alias("before"), F.substring("_t", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("found"), F.col("e.replacement").alias("replacement"), F.substring("_t", F.col("e.end") + 1, F.lit(around)).alias("after"))
    return totals, shown


def changed_only(units: DataFrame, corrected_before: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """Units whose stored fingerprint of rules isn't the present list's: only they are corrected anew."""
    done = corrected_before.filter(F.col("rules_fingerprint") == list_fingerprint(rules)).select(key)
    return units.join(done, key, "left_anti")
