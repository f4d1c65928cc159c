import numpy as np
import pyarrow as pa

from stackroom.llm import arrow_text as A
from tests.llm.fixtures import ALNUM, HARD, SPACED, prose, words


def test_tokens_are_those_of_the_patterns():
    texts = [t for _, t in HARD] + ["A b c", "x" * 10, "Z\x7fz"]
    for table, pattern in ((A.ALNUM_LOWER, ALNUM), (A.SPACED_LOWER, SPACED)):
        tok = A.tokenize(pa.array(texts, pa.string()), table)
        for i, t in enumerate(texts):
            got = [bytes(table[np.frombuffer(tok.word(k), np.uint8)]).decode() for k in range(tok.rows[i], tok.rows[i + 1])]
            assert got == words(pattern, t)


def test_equal_words_have_equal_hashes_anywhere():
    tok = A.tokenize(pa.array(["ab cd ab", None, "cd ab"]), A.SPACED_LOWER)
    h = tok.hash
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    assert (A.word_hashes([b"ab", b"cd"]) == h[:2]).all()


def test_shingles_stay_within_texts_and_short_texts_count_whole():
    tok = A.tokenize(pa.array(["a b c d e f", "", "a b", "b c d e f"]), A.SPACED_LOWER)
    values, rows = A.shingles(tok, 5, True)
    assert np.diff(rows).tolist() == [2, 0, 1, 1] and values[1] == values[3]
    values, rows = A.shingles(tok, 5, False)
    assert np.diff(rows).tolist() == [2, 0, 0, 1]


def test_slices_keep_all_rows_in_order():
    texts = [" ".join(prose(i, 40)) for i in range(50)] + [None, "", "y" * 5000]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(A.slices(iter([batch]), "text", 1000))
    assert len(parts) > 5 and [t for p in parts for t in p.column("text").to_pylist()] == texts
