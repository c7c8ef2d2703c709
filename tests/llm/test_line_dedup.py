import itertools
import random
import re

from probitas.llm import line_dedup
from probitas.llm.line_dedup import NEAR_WORDS, drop_repeated_lines, repeated_lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """(doc, line) to (doc, line) that stays and the steps to it, by comparing all pairs of lines."""
    word = re.compile("[\u0e00-\u0e7f\u3000-\u9fff]|[^ \\t\\r\\f\\v\u0e00-\u0e7f\u3000-\u9fff]+")
    occurring = [((d, k), tuple(word.findall(line.lower()))) for d, t in rows for k, line in enumerate(t.split("\n"))]
    occurring = [(at, w) for at, w in occurring if w]
    first = {}
    for at, w in sorted(occurring):
        first.setdefault(w, at)
    match = {}
    for v, w in itertools.permutations(first, 2):
        if min(len(v), len(w)) >= NEAR_WORDS and abs(len(v) - len(w)) <= 1 and first[w] < first[v] and edits(v, w) <= 1:
            match[first[v]] = min(match.get(first[v], first[w]), first[w])
    out = {}
    for at, w in occurring:
        kept, steps = first[w], 0
        while kept in match:
            kept, steps = match[kept], steps + 1
        if kept != at:
            out[at] = (kept, steps)
    return out


def found(df):
    return {(r.doc_id, r.line_no): ((r.kept_doc_id, r.kept_line_no), r.edits) for r in repeated_lines(df).collect()}


def test_agrees_with_brute_force(make):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(6)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(2, 14))] for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(6):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                k = rnd.randrange(len(line) + 1)
                what = rnd.random()
                if what < 0.3:
                    line.insert(k, rnd.choice(words))
                elif line:
                    k = min(k, len(line) - 1)
                    line[k : k + 1] = [] if what < 0.6 else [rnd.choice(words)]
            lines.append(rnd.choice((" ", "  ")).join(line).title() if rnd.random() < 0.2 else " ".join(line))
        rows.append((d, "\n".join(lines)))
    expected = brute(rows)
    assert sum(e for _, e in expected.values()) > 20
    assert found(make(rows)) == expected


def test_every_single_edit_is_found(make):
    line = " ".join(f"word{k}" for k in range(11))
    words = line.split()
    variants = [words[:k] + words[k + 1 :] for k in range(11)] + [words[:k] + ["new"] + words[k:] for k in range(12)] + [words[:k] + ["new"] + words[k + 1 :] for k in range(11)]
    rows = [(0, line)] + [(k + 1, " ".join(v)) for k, v in enumerate(variants)]
    result = found(make(rows))
    assert all(result[k + 1, 0] == ((0, 0), 1) for k in range(len(variants)))


def test_two_edits_and_edits_of_short_lines_stay(make):
    rows = [(1, "a b c d e f g h i j"), (2, "a X c d e f g Y i j"), (3, "a b c d e"), (4, "a b c d X"), (5, "a b"), (6, "b a")]
    assert found(make(rows)) == {}
    assert {(r.doc_id, r.kept_doc_id) for r in repeated_lines(make(rows), near_words=5).collect()} == {(4, 3)}


def test_short_lines_go_where_they_are_repeated(make):
    rows = [(1, "}\nYes"), (2, "a b\n\n  }"), (3, "yes\nA  b\n \n"), (4, "Yes")]
    assert found(make(rows)) == {(2, 2): ((1, 0), 0), (3, 0): ((1, 1), 0), (3, 1): ((2, 0), 0), (4, 0): ((1, 1), 0)}
    assert {r.doc_id: r.text for r in drop_repeated_lines(make(rows)).collect()} == {1: "}\nYes", 2: "a b\n", 3: " \n"}


def test_chains_end_at_a_line_that_stays(make):
    base = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join([f"x{j}" if j < k else w for j, w in enumerate(base)])) for k in range(9)]
    result = found(make(rows))
    assert result == brute(rows) == {(k, 0): ((0, 0), k) for k in range(1, 9)}


def test_scripts_without_spaces(make):
    rows = [(1, "\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u6563\u6b65"), (2, "\u6211\u4eec\u660e\u5929\u53bb\u516c\u56ed\u6563\u6b65"), (3, "\u6211 \u4eec\u4eca\u5929\u53bb\u516c\u56ed\u6563\u6b65"), (4, "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28"), (5, "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35"), (6, "abc\u6211\u4eecdef")]
    rows += [(7, rows[3][1] + "\u0e14"), (8, "\u00e9\u00e9 \u20ac \U0001f600 \ud55c\uad6d")]
    assert found(make(rows)) == brute(rows)
    assert set(found(make(rows))) == {(2, 0), (3, 0), (7, 0)}


def test_edge_cases(make):
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(None, "one two three four"), (1, None), (2, ""), (3, "\n\n"), (4, "one two three four"), (5, "one two three four"), (5, "one two three four"), (6, long), (7, long + " more")]
    df = make(rows, clash=True)
    assert found(df) == {(5, 0): ((4, 0), 0), (7, 0): ((6, 0), 1)}
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text is not None) == [(0, "one two three four"), (2, ""), (3, "\n\n"), (4, "one two three four"), (6, long)]
    assert kept.where("text is null").count() == 1


def test_rewritten_texts_and_same_id(make):
    rows = [(1, "first line of words\nsecond line of words"), (2, "own line of words\nsecond line of words\nlast"), (2, "second line of words")]
    kept = {(r.doc_id, r.text): r.n_chars for r in drop_repeated_lines(make(rows)).collect()}
    assert kept == {(1, rows[0][1]): len(rows[0][1]), (2, "own line of words\nlast"): len("own line of words\nlast")}


def test_empty_table(make):
    assert repeated_lines(make([])).collect() == [] and drop_repeated_lines(make([])).collect() == []


def test_hot_template_links_stay_linear(make):
    rows = [(k, f"posted by user number {k} on the main board") for k in range(300)]
    result = found(make(rows))
    assert len(result) == 299 and all(kept == ((0, 0), 1) for kept in result.values())
    assert line_dedup.NEAR_WORDS == 8
