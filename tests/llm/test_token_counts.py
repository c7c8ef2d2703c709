from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probitas.llm import token_counts as T
from probitas.llm.common import pieces

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="no vocabulary here")


def test_counts_equal_encoding_whole_texts(make, prose):
    ranks = T.load_ranks(Path(T.VOCABULARY).read_bytes())
    encoding = T._encoding(ranks, T.PATTERN)
    texts = ["", " ", "Hello world", "don't  stop\n\n now ", "naïve café 日本語 👩‍👩‍👧  x y", "<|endoftext|>", "a" * 3000, "1234567890 3.14", "\t\tif x==1:\n", prose(20_000, 1), "ñandú ÉÈ ß", "\x00\x01 z​"]
    found = {r.doc_id: r for r in T.token_counts(make(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        assert found[k].tokens == len(encoding.encode_ordinary(text)), text[:40]
        assert found[k].whole_tokens <= found[k].pretokens <= found[k].tokens


ODD = "  \n\t'strevmdlSTRE’a1.9 　é́٣中\U0001f600\x1c\x85​"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_splitting_all_rows_together_is_splitting_each(texts):
    import regex

    parts = []
    for _, _, piece in pieces(pa.array(texts, pa.string())):
        text, points, offsets = T.code_points(piece)
        if len(points):
            start = T.split_points(points, offsets).tolist()
            parts += [text[a:b] for a, b in zip(start, [*start[1:], len(text)], strict=True)]
    assert parts == [x for t in texts for x in regex.findall(T.PATTERN, t)]


def test_other_patterns(make, prose):
    same = T.PATTERN.replace("'s|", "(?:'s)|")
    df = make(list(enumerate([prose(200, 3), "don't 12 y'all  \n", "中文 é"])))
    assert sorted(map(tuple, T.token_counts(df, pattern=same).collect())) == sorted(map(tuple, T.token_counts(df).collect()))


def test_whole_tokens_are_proved_and_merging_is_right():
    ranks = T.load_ranks(Path(T.VOCABULARY).read_bytes())
    encoding = T._encoding(ranks, T.PATTERN)
    whole = T.whole_tokens(ranks)
    assert len(whole) > 40_000
    assert all(encoding.encode_ordinary(w) == [ranks[w.encode()]] for w in whole)
    single = {t.decode() for t in ranks if _text(t) and len(encoding.encode_ordinary(t.decode())) == 1}
    assert single == whole
    for word in (" tokenization", "unbelievable", "éèê", " zzzzqqq", "x"):
        assert T.merge(ranks, word.encode()) == encoding.encode_ordinary(word)


def _text(token):
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    ranks = T.load_ranks(Path(T.VOCABULARY).read_bytes())
    counter = T.Counter(frozenset(["the"]), T._encoding(ranks, T.PATTERN))
    words = [f" w{k}x{k}" for k in range(200)]
    first = [counter[w] for w in words]
    assert len(counter) <= 12 and [counter[w] for w in words] == first and counter["the"] == 1


def test_edge_cases(make):
    df = make([(None, "a b"), (1, None), (2, ""), (3, "same"), (3, "same")], clash=True)
    assert sorted((str(r.doc_id), r.pretokens) for r in T.token_counts(df).collect()) == [("2", 0), ("3", 1), ("3", 1), ("None", 2)]
    assert T.token_counts(make([])).collect() == []
