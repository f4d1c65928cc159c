"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a model and their scores form a lattice over a text (a blank is written as `▁`, and
one stands before the text). A forward Viterbi pass finds the best score up to each character;
backward A* search uses those scores as exact heuristics, so complete paths come off its queue in
order of score: the first N are the N best. No piece reaches over the end of a word (checked when
the model is read), so a text's lattice is a chain of its words' lattices: each distinct word is
searched once per task while its cache holds it, and the text's N best come from the words' by
a second best-first search over the sums. The forward pass also gives what a word's second path
costs (the least loss of leaving the best path at one of its own ends), so only the N - 1 words
with the least of these costs are searched for more than their best path.

Characters without a piece become their UTF-8 bytes' pieces, at a cost below any piece's score.
Decoding joins pieces and bytes and takes the first blank away; it gives back the text exactly,
but for characters that can't be written in UTF-8.

Defined cases: a null or empty text has no pieces; texts that
hold `▁` themselves decode it as a blank, as the piece alphabet can't tell them apart; ties between
paths go to the one whose pieces are longer from the end backwards; rows are independent. Other
columns are kept; those named like an output column are replaced.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stackroom.llm.arrow_text import list_array, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: How far a byte of a character without a piece lies below the lowest score of a piece.
BYTE_COST = 10.0
#: Words kept with their best paths in each of two generations of a task's cache (about 300 bytes each), and their characters.
CACHED, CACHED_CHARS = 80_000, 1_000_000

Path = tuple[float, tuple[int, ...]]


def _cuts(pieces: Iterable[str]) -> str:
    """A pattern for stretches of text that no piece reaches over.

    Stretches end where a blank follows another character, if no piece has that, and line feeds
    stand apart, if no piece has them.
    """
    if any(b == BLANK != a for n in pieces for a, b in zip(n, n[1:], strict=False)):
        return ".+"
    return f"{BLANK}*[^{BLANK}]+|{BLANK}+" if any("\n" in n for n in pieces) else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n"


@dataclass
class Pieces:
    """Pieces with scores. cut: a pattern for stretches of text that no piece reaches over."""

    names: list[str]
    score: dict[str, tuple[int, float]]
    byte: list[int]
    floor: float
    cut: str
    _trie: dict = field(default_factory=dict, repr=False)
    _ends: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def of(names: list[str], scores: list[float], special: set[int]) -> Pieces:
        bytes_ = {int(n[3:5], 16): i for i, n in enumerate(names) if re.fullmatch(r"<0x[0-9A-F]{2}>", n)}
        special = special | set(bytes_.values())
        usual = [s for i, s in enumerate(scores) if i not in special and s > -1e8]
        floor = min(usual, default=0.0) - 1
        score = {n: (i, max(s, floor)) for i, (n, s) in enumerate(zip(names, scores, strict=True)) if i not in special}
        return Pieces(names, score, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], floor - BYTE_COST, _cuts(score))

    @staticmethod
    def read(path: str = MODEL) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        return Pieces.of([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], {i for i in ids if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_trie": {}, "_ends": {}}

    def trie(self) -> dict:
        """Nested by character; a piece's id and score stand under the empty string."""
        if not self._trie:
            for name, entry in self.score.items():
                node = self._trie
                for c in name:
                    node = node.setdefault(c, {})
                node[""] = entry
        return self._trie

    def _reversed(self) -> dict:
        """As trie(), from each piece's last character to its first."""
        if not self._ends:
            for name, entry in self.score.items():
                node = self._ends
                for c in reversed(name):
                    node = node.setdefault(c, {})
                node[""] = entry
        return self._ends

    def _spelled(self, c: str) -> tuple[tuple[int, ...], float]:
        raw = c.encode("utf-8", "replace")
        return (tuple(self.byte[b] for b in raw) if self.byte else (0,)), self.floor * len(raw)

    def viterbi(self, word: str) -> tuple[list[float], float, tuple[int, ...], float]:
        """Best score up to each character, the whole word's best score and ids, and what its second path costs (infinite without one)."""
        n = len(word)
        low = -math.inf
        best, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        root = self.trie()
        for i in range(n):
            so_far, node, single = best[i], root, False
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    if j == i:
                        single = True
                    total = so_far + found[1]
                    if total >= best[j + 1]:
                        second[j + 1] = best[j + 1]
                        best[j + 1], back[j + 1] = total, (i, found[0])
                    elif total > second[j + 1]:
                        second[j + 1] = total
            if not single:
                own, cost = self._spelled(word[i])
                total = so_far + cost
                if total >= best[i + 1]:
                    second[i + 1] = best[i + 1]
                    best[i + 1], back[i + 1] = total, (i, own)
                elif total > second[i + 1]:
                    second[i + 1] = total
        ids: list[int] = []
        gap, j = math.inf, n
        while j:
            gap = min(gap, best[j] - second[j])
            j, own = back[j]
            if isinstance(own, tuple):
                ids += own[::-1]
            else:
                ids.append(own)
        return best, best[n], tuple(ids[::-1]), gap

    def best_paths(self, words: list[str]) -> Iterator[tuple[tuple[int, ...], float, float]]:
        """viterbi()'s ids, score and gap of many words; what a word's beginning shares with the word before it is kept, so they come sorted."""
        low, root = -math.inf, self._reversed()
        best, second, back, own = [0.0], [low], [0], [None]
        before = ""
        for word in words:
            k, n = 0, len(word)
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                k += 1
            del best[k + 1 :], second[k + 1 :], back[k + 1 :], own[k + 1 :]
            for j in range(k + 1, n + 1):
                i = frm = j - 1
                node = root.get(word[i])
                found = None if node is None else node.get("")
                next_ = low
                if found is None:
                    piece, cost = self._spelled(word[i])
                    top = best[i] + cost
                else:
                    top, piece = best[i] + found[1], found[0]
                while node is not None and i:
                    i -= 1
                    node = node.get(word[i])
                    if node is None:
                        break
                    found = node.get("")
                    if found is not None:
                        total = best[i] + found[1]
                        if total > top:
                            next_, top, frm, piece = top, total, i, found[0]
                        elif total > next_:
                            next_ = total
                best.append(top)
                second.append(next_)
                back.append(frm)
                own.append(piece)
            path: list[int] = []
            gap, j = math.inf, n
            while j:
                d = best[j] - second[j]
                if d < gap:
                    gap = d
                piece = own[j]
                if isinstance(piece, tuple):
                    path += piece[::-1]
                else:
                    path.append(piece)
                j = back[j]
            before = word
            yield tuple(path[::-1]), best[n], gap

    def ending(self, word: str, j: int) -> list[tuple[int, tuple[int, ...] | int, float]]:
        """The pieces that end at j, the longest first: where they begin, their ids, their score."""
        out: list[tuple[int, tuple[int, ...] | int, float]] = []
        node, i = self._reversed(), j
        while i and (node := node.get(word[i - 1])) is not None:
            i -= 1
            if found := node.get(""):
                out.append((i, *found))
        if not out or out[0][0] != j - 1:
            out.insert(0, (j - 1, *self._spelled(word[j - 1])))
        return out[::-1]

    def nbest(self, word: str, n: int) -> list[Path]:
        """The n best segmentations with their scores, best first: A* from the end, guided by the forward scores.

        A path is a chain of back-pointers, spelled out once it is complete. A place's arcs come in
        order of the estimate, and an arc is only queued once the one before it was taken, so that
        a step adds two entries of fixed size, whatever the word's length.
        """
        best, total, ids, gap = self.viterbi(word)
        if n == 1 or gap == math.inf:
            return [(total, ids)]
        # steps taken: the step behind (nearer to the end), the piece, where it begins, the score from there to the end
        behind, piece, begin, score = [-1], [-1], [len(word)], [0.0]
        queue: list[tuple[float, int, int, list, int]] = []
        out: list[Path] = []
        arrived = 0

        def offer(step: int, arcs: list, k: int) -> None:
            """Queue a step's k-th arc by the estimate of the best whole path over it, ties by arrival."""
            nonlocal arrived
            if k < len(arcs):
                arrived += 1
                heapq.heappush(queue, (-(best[arcs[k][0]] + score[step] + arcs[k][2]), arrived, step, arcs, k))

        def ordered(j: int) -> list:
            arcs = self.ending(word, j)
            return arcs if len(arcs) == 1 else sorted(arcs, key=lambda a: -(best[a[0]] + a[2]))

        offer(0, ordered(len(word)), 0)
        while queue and len(out) < n:
            _, _, step, arcs, k = heapq.heappop(queue)
            i, own, s = arcs[k]
            offer(step, arcs, k + 1)
            behind.append(step)
            piece.append(own)
            begin.append(i)
            score.append(score[step] + s)
            last = len(behind) - 1
            if i:
                offer(last, ordered(i), 0)
                continue
            path: list[int] = []
            at = last
            while at:
                path += piece[at] if isinstance(piece[at], tuple) else (piece[at],)
                at = behind[at]
            out.append((score[last], tuple(path)))
        # among equal paths, the first is the one that the forward pass found
        return [(total, ids), *[p for p in out if p[1] != ids]][:n]

    def words(self, text: str) -> list[str]:
        """The text in its lattice's alphabet, cut where no piece reaches over."""
        return re.findall(self.cut, BLANK + text.replace(" ", BLANK), re.S)

    def decode(self, ids) -> str:
        raw = b"".join(map(self._bytes().__getitem__, ids))
        return raw.decode("utf-8", "replace").replace(BLANK, " ")[1:]

    def _bytes(self) -> list[bytes]:
        if not hasattr(self, "_raw"):
            self._raw = [n.encode() for n in self.names]
            for b, i in enumerate(self.byte):
                self._raw[i] = bytes([b])
        return self._raw


def combine(total: float, gaps: list[float], paths_of, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n best choices of one path for each word: the score, and which words don't take their best one (word, path).

    gaps: what each word's second path costs; paths_of(k) gives word k's n best. Best first over
    the sums: a choice is followed by taking the next path of its last word, by another word as
    well, or by another word instead.
    """
    out = [(total, [])]
    left, loss = list(gaps), []
    while len(loss) < n - 1 and (least := min(left, default=math.inf)) < math.inf:
        k = left.index(least)
        loss.append((least, k))
        left[k] = math.inf
    if not loss:
        return out
    words = {k: paths_of(k) for _, k in loss}
    queue = [(loss[0][0], ((0, 1),))]
    while queue and len(out) < n:
        lost, chosen = heapq.heappop(queue)
        out.append((total - lost, [(loss[k][1], p) for k, p in chosen]))
        k, p = chosen[-1]
        own = words[loss[k][1]]
        if p + 1 < len(own):
            heapq.heappush(queue, (lost + own[p][0] - own[p + 1][0], (*chosen[:-1], (k, p + 1))))
        if k + 1 < len(loss):
            heapq.heappush(queue, (lost + loss[k + 1][0], (*chosen, (k + 1, 1))))
            if p == 1:
                heapq.heappush(queue, (lost - loss[k][0] + loss[k + 1][0], (*chosen[:-1], (k + 1, 1))))
    return out


class _Cache(dict):
    """value(word), kept for the words of late: when one generation is full, the one before it goes."""

    def __init__(self, value):
        super().__init__()
        self.value, self.old, self.chars = value, {}, 0

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.value(word)
        self[word] = found
        self.chars += len(word)
        return found

    def fill(self, words: Iterable[str], values: Callable[[list[str]], Iterable]) -> None:
        """Work out the words that aren't kept, all at once and in order."""
        new = set(words).difference(self)
        self.chars += sum(map(len, new))
        known = new & self.old.keys()
        self.update((w, self.old[w]) for w in known)
        new = sorted(new - known)
        self.update(zip(new, values(new), strict=True))

    def turn(self) -> None:
        if len(self) > CACHED or self.chars > CACHED_CHARS:
            self.old = dict(self) if self.chars <= 2 * CACHED_CHARS else {}
            self.clear()
            self.chars = 0


def _caches(pieces: Pieces, n: int) -> tuple[_Cache, _Cache]:
    """A task's caches of best paths (ids, score, gap) and of n best paths."""
    return _Cache(lambda w: (lambda v: (v[2], v[1], v[3]))(pieces.viterbi(w))), _Cache(lambda w: pieces.nbest(w, n))


def encode(docs: DataFrame, pieces: Pieces | None = None, text_col: str = "text", nbest: int = 4, path: str = MODEL, with_ids: bool = True) -> DataFrame:
    """All columns with ids (of the best path), n_pieces, scores (of the N best), alternatives and round_trip.

    alternatives: for each of the N best but the first, which words differ (word, path). round_trip:
    the ids decode to the text. ids are left out unless with_ids; ids_sha256 stands for them.
    """
    import hashlib

    pieces = pieces or Pieces.read(path)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    made = [("ids", T.ArrayType(T.IntegerType()))] * with_ids + [("ids_sha256", T.StringType()), ("n_pieces", T.LongType()), ("scores", T.ArrayType(T.DoubleType())), ("alternatives", T.StringType()), ("round_trip", T.BooleanType())]
    names = dict(made)
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(a, b) for a, b in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        one, several = _caches(p, nbest)
        gc.disable()  # the caches' many tuples hold no cycles; looking for some takes an eighth of the time
        try:
            for b in slices(batches, text_col, 1 << 20):
                ids, rows, out = [], [0], []
                one.turn()
                several.turn()
                texts = b.column(text_col).to_pylist()
                split = [p.words(t) if t else [] for t in texts]
                one.fill(chain.from_iterable(split), p.best_paths)
                for text, words in zip(texts, split, strict=True):
                    if not text:
                        got: list[int] = []
                        out.append((hashlib.sha256(b"").hexdigest(), 0, [0.0] if text == "" else [], "", True))
                    else:
                        own, scores, gaps = zip(*map(one.__getitem__, words), strict=True)
                        got = list(chain.from_iterable(own))
                        best = combine(sum(scores), gaps, lambda k, words=words: several[words[k]], nbest)
                        digest = hashlib.sha256(np.array(got, "<i4").tobytes()).hexdigest()
                        out.append((digest, len(got), [s for s, _ in best], ";".join(" ".join(f"{k}:{i}" for k, i in c) for _, c in best[1:]), p.decode(got) == text))
                    if with_ids:
                        ids.append(np.array(got, np.int32))
                        rows.append(rows[-1] + len(got))
                scores = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])])
                columns = [b.column(f.name) for f in kept]
                if with_ids:
                    columns.append(list_array(pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.array(rows)))
                columns += [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), list_array(pa.array([y for x in out for y in x[2]], pa.float64()), scores), pa.array([x[3] for x in out], pa.string()), pa.array([x[4] for x in out], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        finally:
            gc.enable()

    return docs.select(*[f.name for f in kept], *([text_col] if text_col in names else [])).mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces | None = None, ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """All columns with decoded (null where the ids are null)."""
    pieces = pieces or Pieces.read(path)
    sent = encoded.sparkSession.sparkContext.broadcast(pieces)
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else sent.value.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*[f.name for f in kept]).mapInArrow(run, schema)
