"""Evidence for answers: choosing hits under a budget, bounding results, comparing texts, reading payloads."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.functions.text import is_near_duplicate, near_dup_words

MOST_EVIDENCE, RESULT_BYTES, MARGIN = 12, 2048, 1024


def pack_context(hits: DataFrame, budget: int, query: str = "query_id", document: str = "doc_id", most: int = MOST_EVIDENCE, per_query: int = 30, base: int = 0, each: int = 0) -> DataFrame:
    """(query, evidence, document, rank): the ranked hits (query, rank, document, text) that become evidence S1, S2 ... of a request.

    Blank hits and those like an earlier kept one go. A document's first hit comes before all
    second hits, each by rank; so many are taken as fit: the request has `base` bytes, and a hit its
    UTF-8 bytes and `each` more; one that doesn't fit makes way for the next. A query's array has per_query hits at most.
    """
    hit = F.struct("rank", F.col(document).alias("document"), near_dup_words(F.coalesce("text", F.lit(""))).alias("words"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " ")) == "").alias("blank"))
    lists = hits.filter(F.col("rank") <= per_query).groupBy(query).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    none = F.filter("hits", lambda _: F.lit(False))

    lists = lists.withColumn("kept", F.aggregate("hits", none, lambda kept, h: F.when(h["blank"] | F.exists(kept, lambda k: is_near_duplicate(k["words"], h["words"])), kept).otherwise(F.concat(kept, F.array(h)))))
    again = lambda h, i: F.exists(F.slice("kept", F.lit(1), i), lambda k: k["document"].eqNullSafe(h["document"]))
    lists = lists.withColumn("kept", F.array_sort(F.transform("kept", lambda h, i: F.struct(again(h, i).alias("again"), h["rank"].alias("rank"), h["document"].alias("document"), (h["bytes"] + each).alias("bytes")))))
    total = lambda taken: F.aggregate(taken, F.lit(base).cast("long"), lambda n, x: n + x["bytes"])
    fits = lambda taken, h: (F.size(taken) < most) & (total(taken) + h["bytes"] <= budget)
    taken = F.aggregate("kept", F.filter("kept", lambda _: F.lit(False)), lambda taken, h: F.when(fits(taken, h), F.concat(taken, F.array(h))).otherwise(taken))
    each_taken = lists.select(query, F.posexplode(taken).alias("place", "x"))
    return each_taken.select(query, F.concat(F.lit("S"), F.col("place") + 1).alias("evidence"), F.col("x.document").alias(document), F.col("x.rank").alias("rank"))


def byte_prefix(text: str, most: int) -> str:
    """The longest prefix within so many UTF-8 bytes, moved back to the last line feed or blank when one is there."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    cut = raw[: max(most, 0)].decode("utf-8", "ignore")
    at = max(cut.rfind("\n"), cut.rfind(" "))
    return cut[:at] if at > 0 else cut


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _shortened(item: dict, room: int) -> dict | None:
    """The item with its text cut at a blank so that its JSON takes `room` bytes; None if nothing of the text is left."""
    rest = room - len(_json({**item, "text": "", "truncated": True}).encode())
    ends = accumulate(len(_json(c).encode()) - 2 for c in item["text"])  # bytes of the text up to each character, escaped
    raw = len(item["text"][: bisect_right(list(ends), rest)].encode())
    text = byte_prefix(item["text"], raw) if rest > 0 else ""
    return {**item, "text": text, "truncated": True} if text.strip() else None


def bounded(items: list[dict], drop, most: int = RESULT_BYTES) -> list[dict]:
    """Items whose JSON fits: the largest text gives up the bytes that are too many; where it can't, items are dropped first."""
    for left in range(len(items), 0, -1):
        over = len(_json(items).encode()) - most
        if over <= 0:
            return items
        k = max(range(left), key=lambda i: len(items[i]["text"].encode()))
        short = _shortened(items[k], len(_json(items[k]).encode()) - over)
        if short:
            return [*items[:k], short, *items[k + 1 :]]
        gone = drop(items)
        items = [x for i, x in enumerate(items) if i != gone % left]
    return []


def canonical_json(raw: str) -> str:
    """Keys in order at every depth; what isn't JSON stays as it is."""
    try:
        return json.dumps(json.loads(raw), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return raw


def evidence_ids(payload: str) -> list[str]:
    """Text values under the key evidenceId at any depth, in order."""
    try:
        todo = [json.loads(payload)]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("evidenceId"), str):
                out.append(x["evidenceId"])
            todo += [v for v in reversed(x.values()) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            todo += [v for v in reversed(x) if isinstance(v, (dict, list))]
    return out


def _split(a: list, b: list) -> tuple[int, int]:
    """A point on a shortest way from (0, 0) to the ends of a and b, half of its edits before it: ways from both ends meet.

    a and b aren't empty, and neither begin nor end alike.
    """
    n, m = len(a), len(b)
    ahead, back = {1: 0}, {1: 0}  # how far a way with so many edits gets on each diagonal
    for edits in range((n + m + 1) // 2 + 1):
        for way, mine, other in ((1, ahead, back), (-1, back, ahead)):
            for k in range(-edits, edits + 1, 2):
                down = k == -edits or k != edits and mine[k - 1] < mine[k + 1]
                x = mine[k + 1] if down else mine[k - 1] + 1
                while x < n and x - k < m and (a[x] == b[x - k] if way == 1 else a[n - 1 - x] == b[m - 1 - x + k]):
                    x += 1
                mine[k] = x
                facing = n - m - k
                if (n - m) % 2 == (way == 1) and abs(facing) <= edits - (way == 1) and facing in other and x + other[facing] >= n:
                    return (x, x - k) if way == 1 else (n - x, m - x + k)
    raise AssertionError("two ways always meet")


def _edits(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    """same, removed and added tokens of a shortest edit, in memory of the tokens' number."""
    todo: list[tuple[str, list[str], list[str]]] = [("edit", a, b)]
    while todo:
        kind, a, b = todo.pop()
        if kind == "same":
            yield from (("same", x) for x in a)
            continue
        head = len(commonprefix([a, b]))
        tail = len(commonprefix([a[head:][::-1], b[head:][::-1]]))
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        yield from (("same", t) for t in a[:head])
        if tail:
            todo.append(("same", a[-tail:], []))
        if x and y:
            i, j = _split(x, y)
            todo += [("edit", x[i:], y[j:]), ("edit", x[:i], y[:j])]
        else:
            yield from [("removed", t) for t in x] + [("added", t) for t in y]


def text_diff(before: str, after: str, most_cells: int = 2_500_000) -> list[tuple[str, str]] | None:
    """(same, removed or added; text): a shortest edit of words and gaps, or of lines where the changed parts are too long for words; None where also for lines.

    Of a change the removed text comes first; changes with only white space between them are one.
    """
    for tokens in (re.compile(r"\s+|\S+"), re.compile(r"[^\n]*\n|[^\n]+")):
        a, b = tokens.findall(before), tokens.findall(after)
        head = len(commonprefix([a, b]))
        tail = len(commonprefix([a[head:][::-1], b[head:][::-1]]))
        if (len(a) - head - tail) * (len(b) - head - tail) <= most_cells:
            break
    else:
        return None
    runs = [(same, list(own)) for same, own in groupby(_edits(a, b), key=lambda part: part[0] == "same")]
    gap = [same and 0 < i < len(runs) - 1 and not any(t.strip() for _, t in own) for i, (same, own) in enumerate(runs)]
    out: list[tuple[str, str]] = []
    for changed, some in groupby(range(len(runs)), key=lambda i: gap[i] or not runs[i][0]):
        parts = [p for i in some for p in runs[i][1]]
        if changed:
            texts = [(kind, "".join(t for k, t in parts if k in ("same", kind))) for kind in ("removed", "added")]
            out += [(kind, t) for kind, t in texts if t]
        else:
            out.append(("same", "".join(t for _, t in parts)))
    return out


def mapped(df: DataFrame, column: str, function, kind: str, name: str) -> DataFrame:
    """A column made from another by one of this module's functions, in Arrow batches; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    return df.withColumn(name, run(column))


def synonym_block(groups: list[list[str]], most_groups: int = 40, most_units: int = 1500) -> str:
    """Synonym groups for a prompt, a line each, control characters as blanks, as far as the caps reach."""
    out, used = [], 0
    for g in groups[:most_groups]:
        line = " = ".join("".join(" " if ord(c) < 32 else c for c in t) for t in g)
        if used + len(line) + 1 > most_units:
            break
        out.append(line)
        used += len(line) + 1
    return "\n".join(out)


def turns_from_events(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(event, data) of a server-sent stream's lines; a blank line ends an event."""
    event, data = "message", []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if data:
                yield event, "\n".join(data)
            event, data = "message", []
        elif not line.startswith(":"):
            key, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if key == "event":
                event = value
            elif key == "data":
                data.append(value)
    if data:
        yield event, "\n".join(data)
