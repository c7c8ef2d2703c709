import hashlib
import re
from collections import Counter, defaultdict

from probitas.llm.mixing import mixture


def sainte_lague(blocks, weights, seats):
    """Seat after seat to the highest quotient among the sources that still have a block."""
    won = Counter()
    for _ in range(seats):
        open_ = [s for s in blocks if won[s] < blocks[s] and weights.get(s, 0) > 0]
        if not open_:
            break
        won[min(open_, key=lambda s: (-weights[s] / (2 * won[s] + 1), s))] += 1
    return won


def spans(df, **kw):
    return [(r.shard, r.source, r.block, r.doc_id, r.first_token, r.end_token) for r in mixture(df, **kw).collect()]


def rows_of(sources, docs, size):
    return [(k * 100 + j, " ".join(["t"] * (size + (j * 7) % 5)), s) for k, s in enumerate(sources) for j in range(docs[k])]


def test_quotas_are_sainte_lagues(make):
    rows = rows_of("abc", (40, 12, 5), 10)
    weights = {"a": 1.0, "b": 2.0, "c": 3.5}
    df = make(rows)
    got = spans(df, weights=weights, share=0.4, block=8)
    tokens = Counter()
    for _, text, s in rows:
        tokens[s] += len(text.split())
    blocks = {s: n // 8 for s, n in tokens.items()}
    picked = Counter(s for s, b in {(s, b) for _, s, b, *_ in got})
    assert picked == sainte_lague(blocks, weights, int(sum(blocks.values()) * 0.4))


def test_blocks_are_equal_and_disjoint(make):
    df = make(rows_of("ab", (30, 30), 25))
    got = spans(df, block=16, shard_tokens=300, share=0.7)
    assert len({s for s, *_ in got}) > 1
    size = Counter()
    used = defaultdict(list)
    for shard, source, block, doc, a, b in got:
        size[shard, source, block] += b - a
        used[doc].append((a, b))
    assert set(size.values()) == {16}
    assert all(x[1] <= y[0] for parts in used.values() for x, y in zip(sorted(parts), sorted(parts)[1:], strict=False))
    assert sorted(got) == sorted(spans(df, block=16, shard_tokens=300, share=0.7))
    assert sorted(got) != sorted(spans(df, block=16, shard_tokens=300, share=0.7, seed=5))


def test_blocks_can_be_rebuilt_from_the_result_alone(make):
    rows = [(1, "\u00a0a b\n\n  c d ", "x"), (1, "w x\ty z\n", "x"), (2, " \u00e9t\u00e9 \x0b long  line\r\n" + " ".join(f"w{k}" for k in range(40)), "x"), (3, "p q r s t", "y"), (3, "p q r s t", "y"), (4, "one", "y")]
    got = mixture(make(rows), block=4, share=1.0).collect()
    tokens = re.compile(r"[^ \t\n\r\f]+")
    blocks = defaultdict(list)
    for r in got:
        assert len(tokens.findall(r.text)) == r.end_token - r.first_token
        blocks[r.source, r.block].append(r)
    assert all(sum(r.end_token - r.first_token for r in b) == 4 for b in blocks.values())
    texts = {(d, hashlib.md5(t.encode()).hexdigest()): t for d, t, _ in rows}
    assert len({r.row_key for r in got if r.doc_id == 1}) == 2
    for key, text in texts.items():
        parts = sorted((r.first_token, r.end_token, r.text) for r in got if (r.doc_id, r.row_key) == key)
        assert all(tokens.findall(text)[a:b] == tokens.findall(t) and t in text for a, b, t in parts)
        whole = list(dict.fromkeys(parts))
        if whole and whole[0][0] == 0 and whole[-1][1] == len(tokens.findall(text)) and all(x[1] == y[0] for x, y in zip(whole, whole[1:], strict=False)):
            assert "".join(t for *_, t in whole) == text


def test_edge_cases(make):
    long = " ".join(["w"] * 50_000)
    rows = [(None, "a b c", "x"), (1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "a b c d", None), (5, "a b c d", "x"), (5, "a b c d", "x"), (6, long, "y")]
    assert Counter(r.text for r in mixture(make(rows), block=4, share=1.0).collect())["a b c d"] == 3
    got = spans(make(rows, clash=True), block=4, share=1.0)
    assert sum(b - a for *_, a, b in got) == 50_000 + 12
    assert Counter(s for _, s, *_ in got) == {None: 1, "x": 2, "y": 12_500}
    assert spans(make(rows), block=4, share=1.0, weights={"x": 1.0}) and {s for _, s, *_ in spans(make(rows), block=4, share=1.0, weights={"x": 1.0})} == {"x"}
    assert spans(make(rows), weights={}) == [] and spans(make([])) == []


def test_ties_go_to_the_smaller_name(make):
    rows = [(k, "a b c d", s) for k, s in enumerate("ba")]
    assert {s for _, s, *_ in spans(make(rows), block=4, share=0.5)} == {"a"}
