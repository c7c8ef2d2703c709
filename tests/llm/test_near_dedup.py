import random

import numpy as np
import pyarrow as pa
import pytest

from probitas.llm import near_dedup as N
from probitas.llm.common import pieces, words
from probitas.llm.components import components
from probitas.llm.near_dedup import THRESHOLD, allowed_edits, banded_distance, drop_near_duplicates, near_duplicates, text_sketches


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_is_exact():
    rnd = random.Random(2)
    for _ in range(1500):
        a = [rnd.randrange(rnd.choice((2, 6, 40))) for _ in range(rnd.randint(0, 30))]
        b = list(a)
        for _ in range(rnd.randint(0, 10)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = [rnd.randrange(40)] * rnd.randint(0, 1)
        bound = rnd.randint(0, 12)
        assert banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), bound) == min(distance(a, b), bound + 1)


def groups(df):
    return {r.doc_id: r.kept_doc_id for r in near_duplicates(df).collect()}


def changed(text, rate, rnd):
    words = text.split()
    out = []
    for w in words:
        x = rnd.random()
        if x < rate / 3:
            continue
        out.append(f"n{rnd.randrange(1000)}" if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append(f"n{rnd.randrange(1000)}")
    return " ".join(out)


def test_recall_against_brute_force(make, prose):
    rnd = random.Random(8)
    rows = []
    for k in range(40):
        base = prose(rnd.randint(15, 200), k)
        rows.append((len(rows), base))
        for _ in range(rnd.randint(0, 3)):
            rows.append((len(rows), changed(base, rnd.choice((0.03, 0.08, 0.15, 0.3)), rnd)))
    words = [t.split() for _, t in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if distance(words[i], words[j]) <= allowed_edits(max(len(words[i]), len(words[j])), THRESHOLD)]
    found = groups(make(rows))
    root = lambda x: found.get(x, x)
    assert len(close) > 30
    assert sum(root(i) == root(j) for i, j in close) >= 0.95 * len(close)
    # everything found is linked by close pairs
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in close:
        parent[max(top(i), top(j))] = min(top(i), top(j))
    assert all(top(a) == top(b) for a, b in found.items())


@pytest.mark.parametrize("rate, least", [(0.1, 0.999), (0.2, 0.95), (0.25, 0.92)])
@pytest.mark.parametrize("n", [4, 8, 9, 12, 30, 41, 60, 200, 1000])
def test_share_of_pairs_that_collide(n, rate, least):
    rnd = random.Random(n)
    texts = []
    for _ in range(300):
        a = [f"v{rnd.randrange(5000)}" for _ in range(n)]
        b = list(a)
        for i in sorted(rnd.sample(range(n), int(rate * n)), reverse=True):
            what = rnd.random()
            if what < 0.8:
                b[i] = f"x{rnd.randrange(99999)}"
            elif what < 0.9:
                del b[i]
            else:
                b.insert(i, f"x{rnd.randrange(99999)}")
        texts += [" ".join(a), " ".join(b)]  # as many edits as the bound allows, or fewer
    [(_, _, piece)] = pieces(pa.array(texts), 1 << 24)
    values, number = text_sketches(words(piece))
    lists = [set(x) for x in np.split(values, np.cumsum(number)[:-1])]
    together = [bool(x & y) for x, y in zip(lists[::2], lists[1::2], strict=True)]
    assert len(together) == 300 and sum(together) >= least * 300


def test_short_texts_agree_with_brute_force(make):
    rnd = random.Random(12)
    rows = [(k, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9)))) for k in range(120)]
    words_ = [t.split() for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if distance(words_[i], words_[j]) <= allowed_edits(max(len(words_[i]), len(words_[j])), THRESHOLD):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    found = groups(make(rows))
    assert sum(found.get(k, k) == top(k) for k in range(len(rows))) >= 0.97 * len(rows)


def test_order_matters(make, prose):
    text = prose(120, 1).split()
    shuffled = sorted(text)
    assert groups(make([(1, " ".join(text)), (2, " ".join(shuffled))])) == {}


def test_edge_cases(make, prose):
    text = prose(50, 3)
    long = prose(30_000, 4)
    rows = [(None, text), (1, None), (2, ""), (3, " .,! "), (4, text), (5, text.upper() + "!"), (5, text.upper() + "!"), (6, "one"), (7, "One."), (8, "one two"), (9, long), (10, long + " end"), (8, prose(40, 9))]
    df = make(rows, clash=True)
    assert groups(df) == {5: 4, 7: 6, 10: 9}
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "6", "8", "8", "9"])


def test_large_group_and_empty_table(make, prose):
    rnd = random.Random(1)
    base = prose(80, 5)
    rows = [(k, changed(base, 0.05, rnd)) for k in range(300)]
    found = groups(make(rows))
    assert len(found) >= 299 * 0.99 and set(found.values()) == {0}
    assert near_duplicates(make([])).collect() == []


def test_passage_in_many_documents(make, prose):
    rnd = random.Random(4)
    passage = prose(70, 1)
    rows = []
    for k in range(150):
        own = " ".join(f"w{rnd.randrange(2000)}" for _ in range(30))
        rows += [(len(rows), f"{passage} {own}"), (len(rows) + 1, f"{passage} {changed(own, 0.2, rnd)}")]
    rnd.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    words = [t.split() for _, t in rows]
    bound = lambda i, j: allowed_edits(max(len(words[i]), len(words[j])), THRESHOLD)
    # all but the passage decides
    close = [(i, j) for i in range(len(rows)) for j in range(i) if distance(words[i][70:], words[j][70:]) <= bound(i, j)]
    found = groups(make(rows))
    assert len(close) >= 150
    assert sum(found.get(i, i) == found.get(j, j) for i, j in close) >= 0.99 * len(close)
    assert len(found) <= 160


@pytest.mark.parametrize("few", [0, 1000])
def test_word_arrays_of_few_texts_are_not_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        arrays = N.cut(spark.range(50).selectExpr("named_struct('doc_id', id, 'row_key', id) as at", "cast('abcd' as binary) as words"))
        found = N._of(arrays, arrays.where("at.doc_id % 5 = 0").select("at").union(arrays.select("at").limit(0)))
        assert sorted(r.at.doc_id for r in found.collect()) == list(range(0, 50, 5))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (few > 0) and ("Exchange hashpartitioning" in plan) == (few == 0)
        rare = N._rarest(arrays, THRESHOLD)
        assert rare._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bits", [2, 20])
def test_rarest_words_are_shared_within_the_bound(spark, bits):
    """Also where most words share a counter."""
    rnd = random.Random(9)
    lists = []
    for _ in range(60):
        base = [rnd.randrange(rnd.choice((5, 3000))) for _ in range(rnd.randint(1, 60))]
        lists += [base, [rnd.randrange(3000) if rnd.random() < 0.2 else w for w in base]]
    rows = [((k, k), np.array(x, "<u4").tobytes()) for k, x in enumerate(lists)]
    arrays = spark.createDataFrame(rows, "at struct<doc_id: bigint, row_key: bigint>, words binary")
    rare = {r.at.doc_id: r.tokens for r in N._rarest(arrays, THRESHOLD, bits).collect()}
    assert all(len(rare[k]) == allowed_edits(len(x), THRESHOLD) + 1 for k, x in enumerate(lists))
    close = [(i, j) for i in range(120) for j in range(i) if distance(lists[i], lists[j]) <= allowed_edits(max(len(lists[i]), len(lists[j])), THRESHOLD)]
    assert len(close) > 30 and all(set(rare[i]) & set(rare[j]) for i, j in close)


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
