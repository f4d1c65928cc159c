"""Word tables of an OCR engine as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the table, and the level of a word's row.
COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
WORD = 5


def read_words(rows: DataFrame, content: str = "value", key: str = "page") -> DataFrame:
    """Words of lines of tab-separated fields: rows of another level, with too few fields or without text go."""
    f = F.split(content, "\t")
    words = rows.filter((F.size(f) >= 12) & (F.expr("try_cast(trim(split({0}, '\\t')[0]) AS int)".format(content)) == WORD))
    number = lambda k: F.coalesce(F.expr(f"try_cast(trim(split({content}, '\\t')[{k}]) AS int)"), F.lit(0))
    out = words.select(key, *[number(k).alias(c) for k, c in enumerate(COLUMNS) if k not in (10, 11)], F.expr(f"try_cast(trim(split({content}, '\\t')[10]) AS double)").alias("conf"), F.trim(f[11]).alias("text"))
    return out.filter("text <> ''")


def reading(words: DataFrame, key: str = "page") -> DataFrame:
    """Each page's text in lines and the mean confidence (0 to 1) of the words that have one."""
    place = ["page_num", "block_num", "par_num", "line_num"]
    lines = words.groupBy(key, *place).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_num", "left", "text"))), lambda x: x["text"]), " ").alias("line"), F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("c"), F.count(F.when(F.col("conf") >= 0, 1)).alias("n"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, "line"))), lambda x: x["line"]), "\n").alias("text"), (F.sum("c") / F.sum("n") / 100).alias("confidence"))


def paragraphs(words: DataFrame, key: str = "page") -> DataFrame:
    """Boxes of paragraphs: the union of their words' boxes that have an area."""
    some = F.col("width").cast("int").__gt__(0) & (F.col("height") > 0)
    pick = lambda c: F.when(some, c)
    return words.groupBy(key, "page_num", "block_num", "par_num").agg(F.min(pick(F.col("left"))).alias("x1"), F.min(pick(F.col("top"))).alias("y1"), F.max(pick(F.col("left") + F.col("width"))).alias("x2"), F.max(pick(F.col("top") + F.col("height"))).alias("y2"), F.count("*").alias("n_words"))
