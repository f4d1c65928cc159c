"""Fill-in-the-middle arrangements of texts, in Spark SQL functions only.

regexp_extract_all cuts a text into units (code points unless another pattern is given). Two
numbers of the id's SHA-256, taken modulo n + 1, are the cuts between prefix, middle and suffix; two
others choose the form: plain, prefix-suffix-middle (psm) or suffix-prefix-middle (spm). Slices of
the unit array, joined again, are the three parts; sentinels mark where each begins. restore()
reads the text back from the arranged text and its form.

An array of single code points takes some sixty bytes for each, so units are matched in runs of RUN:
a unit's place is that of its run and that within the run, and only a run that a cut goes through
is cut into units. A row at work holds its text a few times, however long that is.

Defined cases: null and empty texts have no units and stay plain, as do texts that hold a
sentinel; a null id counts as no digits; rows are independent, so repeated rows get equal results; an
empty table gives none. Other columns are kept; those named like an output column are replaced. A
unit pattern must match every part of a text, as the defaults do, or what it skips is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm.quality_rules import free, let

#: Patterns for units: each matches some of any text that isn't empty.
CODE_POINT, WORD, LINE = ".", r"(?:\s*\S+|\s+)", r"(?:[^\n]*\n|[^\n]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units matched at once.
RUN = 256
#: Of a hundred texts, how many are arranged at all, and of a hundred of those how many with the suffix first.
RATE, SPM = 90, 20


def draw(id_: Column, group: int, seed: int = 1) -> Column:
    """The hexadecimal group (from 1) of eight digits of the SHA-256 of `seed:id`, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, spm: int = SPM, unit: str = CODE_POINT) -> DataFrame:
    """All columns with n (units), form, prefix_chars and middle_chars (code points; null if plain) and output."""
    own = free("_fim", docs)
    id_ = F.col(id_col)
    units = lambda text: F.regexp_extract_all(text, F.lit(f"(?s){unit}"), F.lit(0))
    runs = lambda text: F.regexp_extract_all(text, F.lit(f"(?s)(?:{unit}){{1,{RUN}}}"), F.lit(0))
    count = lambda r: F.when(F.size(r) > 0, (F.size(r).cast("long") - 1) * RUN + F.size(units(F.element_at(r, -1)))).otherwise(F.lit(0)).cast("long")
    cuts = lambda n: F.array_sort(F.array(*[F.pmod(draw(id_, g, seed), n + 1) for g in (1, 2)]))

    def form(text: Column) -> Column:
        marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
        plain = (text == "") | marked | (draw(id_, 3, seed) % 100 >= rate)
        return F.when(plain, "plain").otherwise(F.when(draw(id_, 4, seed) % 100 < spm, "spm").otherwise("psm"))

    def parts(text: Column, r: Column, n: Column) -> Column:
        whole = lambda c: F.transform(c, lambda x: F.floor(x / RUN).cast("int"))  # noqa: E731  runs before each cut
        left = lambda c: F.transform(c, lambda x: (x % RUN).cast("int"))  # noqa: E731  units of the next run before it
        through = lambda w: F.transform(w, lambda k: units(F.coalesce(F.get(r, k), F.lit(""))))
        cut = let(cuts(n), lambda c: let(whole(c), lambda w: let(through(w), lambda u: _pieces(r, w, left(c), u))))
        return F.struct(n.alias("n"), form(text).alias("form"), cut.alias("cut"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(own, let(text, lambda t: let(runs(t), lambda r: let(count(r), lambda n: parts(t, r, n)))))
    part = lambda name: F.when(F.col(own)["form"] != "plain", F.col(own)["cut"][name])
    output = (
        F.when(F.col(own)["form"] == "psm", F.concat(F.lit(PREFIX), part("prefix"), F.lit(SUFFIX), part("suffix"), F.lit(MIDDLE), part("middle")))
        .when(F.col(own)["form"] == "spm", F.concat(F.lit(SUFFIX), part("suffix"), F.lit(PREFIX), part("prefix"), F.lit(MIDDLE), part("middle"))).otherwise(text)
    )
    found = {"n": F.col(own)["n"], "form": F.col(own)["form"], "prefix_chars": F.char_length(part("prefix")).cast("long"), "middle_chars": F.char_length(part("middle")).cast("long"), "output": output}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in found]
    return rows.select(*kept, *[v.alias(k) for k, v in found.items()])


def _pieces(runs: Column, whole: Column, left: Column, through: Column) -> Column:
    """prefix, middle and suffix: runs that lie in one, and slices of the two runs that the cuts go through."""
    joined = lambda x: F.array_join(x, "")
    units = lambda k, first, n=F.lit(RUN): joined(F.slice(through[k], first, n))
    between = lambda first, n: joined(F.slice(runs, first, F.greatest(n, F.lit(0))))
    prefix = F.concat(between(F.lit(1), whole[0]), units(0, F.lit(1), left[0]))
    middle = F.when(whole[0] == whole[1], units(0, left[0] + 1, left[1] - left[0])).otherwise(F.concat(units(0, left[0] + 1), between(whole[0] + 2, whole[1] - whole[0] - 1), units(1, F.lit(1), left[1])))
    suffix = F.concat(units(1, left[1] + 1), between(whole[1] + 2, F.size(runs) - whole[1] - 1))
    return F.struct(prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """All columns with restored: the text, from the output's sentinels and the form alone."""
    out, form = F.col(output_col), F.col(form_col)
    order = F.when(form == "psm", F.array(*map(F.lit, (1, 3, 2)))).otherwise(F.array(*map(F.lit, (2, 3, 1))))
    text = let(F.split(out, "<[PSM]>"), lambda parts: F.array_join(F.transform(order, lambda i: F.get(parts, i)), ""))
    return rows.withColumn("restored", F.when(form == "plain", out).otherwise(text))
