import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probitas.llm.common import BASE, BASE_INV, checkpoint_dir, cut, mix, pieces, powers, prefix_sums, solid_bytes, span_hashes, table, with_row_key, words
from probitas.llm.line_dedup import _half

TEXT = st.text(alphabet=st.sampled_from("abZÉé ßñ\n\t.,-–“”·09_語"), max_size=40)


def plain(text):
    """Words by a regular expression: letters and digits, in lower case; other signs part them."""
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 30))
def test_words_are_those_of_a_regular_expression(texts, limit):
    seen = {}
    for i, j, piece in pieces(pa.array(texts, pa.string()), limit):
        found = words(piece)
        for k, text in enumerate(texts[i:j]):
            a, b = found.offsets[k], found.offsets[k + 1]
            expected = plain(text)
            assert b - a == len(expected)
            for w, h in zip(expected, found.hash[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
            data = text.encode()
            o = int(piece.offsets[k])
            assert [data[s - o : e - o].decode().lower() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)] == expected
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 20), st.integers(0, 3))
def test_pieces_cover_all_rows_in_order(texts, limit, skip):
    array = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    out = []
    for i, j, piece in pieces(array, limit):
        assert i == len(out) and (j - i == 1 or len(piece.data) <= limit)
        out += [piece.data[a:b].tobytes().decode() for a, b in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)]
    assert out == [t or "" for t in array.to_pylist()]


def test_span_hashes_do_not_depend_on_the_place():
    x = mix(np.arange(50, dtype=np.uint64))
    twice = np.concatenate([x, x])
    sums = prefix_sums(twice)
    at = np.arange(40)
    assert np.array_equal(span_hashes(sums, at, at + 9), span_hashes(sums, at + 50, at + 59))
    assert len(set(span_hashes(sums, at, at + 9).tolist())) == 40
    assert (int(BASE) * int(BASE_INV)) % (1 << 64) == 1 and int(powers(BASE, 4)[3]) == pow(int(BASE), 3, 1 << 64)
    assert solid_bytes(np.frombuffer(b"a \t\n\r\x0b\x0cb", np.uint8)).tolist() == [True] + [False] * 6 + [True]


def test_halves_fit_into_the_shorter_line():
    n = np.arange(2, 5000)
    assert (2 * _half(n) <= n).all() and (_half(n) >= n // 2 * 4 // 5 - 1).all() and (np.diff(_half(n)) >= 0).all()


def test_cut_and_table(spark, make):
    df = make([(1, "a"), (2, "b")])
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    for made in (cut(df), cut(df, free=True)):
        assert made.columns == df.columns and made.count() == 2
        assert "Scan ExistingRDD" in made._jdf.queryExecution().executedPlan().toString()
    made, remove = table(df)
    assert made.exceptAll(df).isEmpty() and made.inputFiles()[0].replace("file:///", "file:/").startswith(checkpoint_dir(spark))
    assert remove() and not remove()


def test_row_keys(make):
    keys = {(r.doc_id, r.row_key) for r in with_row_key(make([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None)])).collect()}
    assert len(keys) == 2 and {d for d, _ in keys} == {1}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="share"):
        checkpoint_dir(Session())
