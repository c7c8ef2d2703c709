import random
import re
from collections import defaultdict

import pytest

from probitas.llm import decontamination as D
from probitas.llm.decontamination import contaminated, drop_contaminated

ITEM = "On Monday morning Tom bought 12 apples for 3.50 dollars and gave 4 apples to Anna because Anna had walked 5 km to the small market behind the old bridge"
PLAIN, NUMBERS, UNITS, NAMES = (set(x) for x in (D.PLAIN, D.NUMBERS, D.UNITS, D.NAMES))


@pytest.fixture()
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id bigint, text string, doc_id string, window string")


# A version in plain Python, for ASCII texts, that shares nothing with the operator but the lists of words.


def parts(text):
    """(word in lower case, number, unit, capital, opens a sentence, what stands before it) of each word."""
    out, end = [], 0
    for m in re.finditer(r"[A-Za-z]*[0-9]+|[A-Za-z]+", text):
        w, gap = m[0], text[end : m.start()]
        number = w.isdigit() or w.lower() in NUMBERS
        unit = bool(out) and out[-1][1] and not number and w.lower() in UNITS
        capital = len(w) > 1 and w[0].isupper() and not any(c.isupper() for c in w[1:])
        out.append((w.lower(), number, unit, capital, not out or bool(re.search(r"[\n!.:?]", gap)), gap))
        end = m.end()
    return out


def common_words(items):
    return {w for t in items for w, number, unit, capital, *_ in parts(t) if not number and not unit and (not capital or w in PLAIN)}


def template(text, reading, common):
    """(kind, value) of each word or slot."""
    out = []
    for w, number, unit, capital, opens, gap in parts(text):
        if reading == "plain":
            out.append(("literal", w))
            continue
        if reading == "capitals":
            name = capital and not number and (not opens or w in NAMES) and w not in PLAIN
        else:
            name = not number and not unit and w not in common
        kind = "number" if number else "unit" if unit else "name" if name else "literal"
        last = out[-1][0] if out else None
        if kind == last == "number" and gap in (".", ",") and w[0].isdigit() or kind == last == "name" and not (opens and reading == "capitals"):
            out[-1] = (kind, (*out[-1][1], w))
        else:
            out.append((kind, (w,)))
    return out


def windows(t, size):
    for k in range(len(t) - size + 1):
        yield k, tuple(v if kind == "literal" else kind for kind, v in t[k : k + size]), t[k : k + size]


def brute(docs, items):
    """{(doc_id, item_id): coverage} by all pairs of texts and items."""
    common, found = common_words(items.values()), {}
    for (d, text), (i, item) in ((x, y) for x in docs.items() for y in items.items()):
        for reading in ("plain", "capitals", "vocabulary"):
            a, b = template(item, reading, common), template(text, reading, common)
            size = min(len(a), 8)
            if size < (1 if reading == "plain" else 4):
                continue
            literal = lambda w: sum(kind == "literal" for kind, _ in w)
            usable = [x for x in windows(a, size) if 2 * literal(x[2]) >= size and (reading != "vocabulary" or literal(x[2]) >= 4 or all(k != "name" for k, _ in x[2]))]
            if size < 4:
                if any([w for w, *_ in parts(line)] == [v for _, v in a] for line in text.split("\n")):
                    found[d, i] = 1.0
                continue
            diagonals = defaultdict(list)
            for k, key, w in usable:
                for at, other, v in windows(b, size):
                    if key == other:
                        diagonals[at - k].append((k, w, v))
            good = {}
            for g, hits in diagonals.items():
                slots = {(x[0], x[1], y[1]) for _, w, v in hits for x, y in zip(w, v, strict=True) if x[0] != "literal"}
                if len(slots) == len({s[:2] for s in slots}) == len({(s[0], s[2]) for s in slots}):
                    good[g] = {k for k, *_ in hits}
            cells = defaultdict(set)
            for g, at in good.items():
                cells[0, g // 64] |= at
                cells[1, (g + 32) // 64] |= at
            share = max((len(at) / len(usable) for at in cells.values()), default=0)
            if share >= 0.4:
                found[d, i] = max(found.get((d, i), 0), round(share, 6))
    return found


def pairs(df, bench, **kw):
    return {(r.doc_id, r.item_id): (r.coverage, r.verbatim) for r in contaminated(df, bench, **kw).collect()}


def agree(make, items, docs, bench):
    found = pairs(make(docs), items(bench))
    assert {k: c for k, (c, _) in found.items()} == brute(dict(docs), dict(bench))
    return found


def test_agrees_with_a_version_in_plain_python(make, items, prose):
    rnd = random.Random(5)
    names = "Abel Bodo Cora Dina Egon Fritz Greta Hugo Ivo Jutta Will Rose".split()

    def question(seed, who, numbers):
        r = random.Random(seed)
        words = prose(26, seed).split()
        for _ in range(3):
            words.insert(r.randrange(len(words)), who[r.randrange(2)])
        for k in range(3):
            words.insert(r.randrange(len(words)), f"{numbers[k]} {('km', 'apples', 'dollars')[k]}")
        text = " ".join(words)
        return text[0].upper() + text[1:] + "."

    bench = [(k, question(k, rnd.sample(names, 2), rnd.sample(range(2, 99), 3))) for k in range(12)]
    bench += [(50, "12 + 7 * 3 = ? 5 - 2 = ? 9 / 3 = ?"), (51, "Will Rose"), (52, "it will be what rose is"), (53, "Zbigniew bought 12 pears and 7 plums at the corner shop")]
    docs = []
    for k in range(12):
        again = question(k, rnd.sample(names, 2), rnd.sample(range(2, 9999), 3))
        for change in (str, str.upper, str.lower, str.title, lambda t: "\n".join(t.split())):
            docs.append((len(docs), prose(20, 900 + k) + ". " + change(again) + " " + prose(20, 950 + k)))
        docs.append((len(docs), change(dict(bench)[k])))
    docs += [(200 + k, prose(300, 700 + k)) for k in range(5)]
    docs += [(300, "so 12 + 7 * 3 = ? 5 - 2 = ? 9 / 3 = ?"), (301, "say\n will  ROSE!\nand"), (302, "she will rose"), (303, "12 + 8 * 3 = ? 5 - 2 = ? 9 / 4 = ?")]
    docs += [(304, "Fatima bought 30 pears and 4 plums at the corner shop"), (305, "fatima bought 30 pears and 4 plums at the corner shop"), (306, "ZBIGNIEW BOUGHT 12 PEARS AND 7 PLUMS AT THE CORNER SHOP")]
    found = agree(make, items, docs, bench)
    assert len([k for k in found if k[0] < 100 and k[0] // 6 == k[1]]) > 60
    assert {(300, 50), (301, 51), (304, 53), (305, 53), (306, 53)} <= set(found) and not {(302, 51), (303, 50)} & set(found)
    assert not any(200 <= d < 300 for d, _ in found)


def test_copies_and_new_parameters(make, items, prose):
    new = ITEM.replace("Tom", "Oleg").replace("Anna", "Berta").replace("12", "99").replace("3.50", "1,200.75").replace("4 apples", "7 apples").replace("5 km", "8 miles").replace("Monday", "Friday")
    twisted = new.replace("because Berta", "because Oleg")
    half = " ".join(ITEM.split()[:12])
    rows = [(1, prose(60, 1) + " " + ITEM + " " + prose(50, 2)), (2, prose(30, 3) + ". " + new + ". " + prose(30, 4)), (3, twisted), (4, half + " " + prose(60, 5)), (5, prose(300, 6)), (6, new.upper()), (7, new.lower()), (8, new.title())]
    found = agree(make, items, rows, [(7, ITEM), (8, prose(40, 77))])
    assert found[1, 7] == (1.0, True)
    assert {k: found[k, 7] for k in (2, 6, 7, 8)} == dict.fromkeys((2, 6, 7, 8), (1.0, False))
    # one name stands for two of the item, so the alignment isn't consistent
    assert set(found) == {(k, 7) for k in (1, 2, 6, 7, 8)}


def test_copies_in_other_case_and_wrapping(make, items):
    rows = [(1, ITEM.upper()), (2, ITEM.replace(" ", "\n").upper()), (3, ITEM.lower()), (4, ITEM.title())]
    assert pairs(make(rows), items([(7, ITEM)])) == {(k, 7): (1.0, True) for k in (1, 2, 3, 4)}


def test_scattered_windows_are_no_copy(make, items, prose):
    ws = prose(40, 3).split()
    bits = [" ".join(ws[k : k + 8]) for k in range(0, 33, 8)]
    assert pairs(make([(1, (" " + prose(90, 4) + " ").join(bits * 5))]), items([(1, " ".join(ws))])) == {}


def test_items_without_literal_words(make, items):
    sums, names = "12 plus 35 minus 7", "Anna Berta Carla Dora Emil Franz Gustav Hanna Ida Jakob"
    rows = [(1, "say " + sums), (2, "with " + names + " there"), (3, "12 plus 36 minus 7")]
    assert {k for k in pairs(make(rows), items([(1, sums), (2, names)])) if k != (3, 1)} == {(1, 1), (2, 2)}


def test_edge_cases(make, items, prose):
    short = "what is seven plus nine"
    long = prose(40_000, 8) + " " + ITEM
    df = make([(None, ITEM), (1, None), (2, ""), (3, ITEM), (3, ITEM), (4, long), (5, "say " + short), (6, "two words"), (3, "another text"), (7, "of two words")], clash=True)
    bench = items([(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, ""), (4, "two words"), (5, short), (1, prose(20, 1))])
    assert set(pairs(df, bench)) == {(3, 1), (4, 1), (5, 5), (6, 4)}
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "")[:7]) for r in kept.collect()) == sorted([("None", ITEM[:7]), ("1", ""), ("2", ""), ("7", "of two "), ("3", "another")])


def test_filters_have_no_false_negative(spark):
    for n in (0, 1, 70_000):
        keys = spark.range(n).selectExpr("xxhash64(id) as k")
        filter_ = D._filter(keys)
        values = keys.toArrow()["k"].to_numpy().view("u8")
        assert filter_.has(values).all() and filter_.has(~values).mean() < 0.01 if n else not filter_.marks.any()


def test_empty_tables(make, items):
    assert pairs(make([]), items([(1, ITEM)])) == {} and pairs(make([(1, ITEM)]), items([])) == {}
