import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_decontamination import brute as brute_items
from test_line_dedup import brute as brute_lines
from test_mixing import sainte_lague
from test_near_dedup import changed

import corpus_pipeline as P
from probitas.llm import quality_rules as R
from probitas.llm.common import pieces, words
from probitas.llm.mixing import BLOCK, SEED, SHARE
from probitas.llm.near_dedup import THRESHOLD, allowed_edits, banded_distance

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """A folder with documents, labels and a benchmark that give every stage something to do."""
    rnd = random.Random(12)
    hot = "this very line stands in many of the documents"
    bench = [(k, prose(40, 500 + k) + ".") for k in range(6)]
    rows, labels = [], []
    for k in range(90):
        own = prose(rnd.randint(60, 500), k).split()
        lines = [" ".join(own[i : i + 20]).capitalize() + "." for i in range(0, len(own), 20)]
        kind = k % 9
        if kind == 0:
            lines = [" ".join(f"{w}%%% ###" for w in own)]
        elif kind == 1:
            lines.insert(1, hot if k % 2 else hot.replace("many", "some"))
        elif kind == 2:
            lines.insert(1, bench[k % 6][1])
        rows.append((len(rows), "\n".join(lines), "en", f"src{k % 4}"))
        labels.append((rows[-1][0], int(kind != 0), 0))
        if kind == 3:
            copy = changed(rows[-1][1].replace("\n", " "), 0.06, rnd)
            rows.append((len(rows), copy, "en", f"src{k % 3}"))
        if kind == 4:
            rows.append((len(rows), rows[-1][1], "en", "src1"))
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def piece(text):
    return next(pieces(pa.array([text])))[2]


def by_hand(spark, folder):
    """The ids that each of the first four stages keeps, the texts after the second, and the last stage's rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    kept = []
    field = R.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {}
    for d, (text, source) in rows.items():
        features, n, _, _ = R.line_features(piece(text))
        marks = np.array(field.decode(field.scores(features)), dtype=bool)
        if n[marks].sum() / max(1, n.sum()) >= R.CONTENT_SHARE:
            good[d] = (text, source)
    kept.append(set(good))
    gone = brute_lines([(d, t) for d, (t, _) in good.items()])
    left = {}
    for d, (text, source) in good.items():
        lines = [line for k, line in enumerate(text.split("\n")) if (d, k) not in gone]
        if lines:
            left[d] = ("\n".join(lines), source)
    kept.append(set(left))
    arrays = {d: words(piece(t)).hash for d, (t, _) in left.items()}
    parent = {d: d for d in left}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in left:
        for b in left:
            bound = allowed_edits(max(len(arrays[a]), len(arrays[b])), THRESHOLD)
            if a < b and len(arrays[a]) and banded_distance(arrays[a], arrays[b], bound) <= bound:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    single = {d: v for d, v in left.items() if top(d) == d}
    kept.append(set(single))

    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    dirty = {d for d, _ in brute_items({d: t for d, (t, _) in single.items()}, items)}
    clean = {d: v for d, v in single.items() if d not in dirty}
    kept.append(set(clean))
    streams = defaultdict(list)
    for d, (text, source) in clean.items():
        streams[source].append((hashlib.md5(f"{SEED}:{d}".encode()).hexdigest(), d, len(text.split())))
    blocks, spans = {}, []
    for source, parts in streams.items():
        at = 0
        for _, d, n in sorted(parts):
            for b in range(at // BLOCK, (at + n - 1) // BLOCK + 1):
                spans.append((source, b, d, max(at, b * BLOCK) - at, min(at + n, (b + 1) * BLOCK) - at))
            at += n
        blocks[source] = at // BLOCK
    quotas = sainte_lague(blocks, dict.fromkeys(blocks, 1.0), int(sum(blocks.values()) * SHARE))
    chosen = set()
    for source, n in blocks.items():
        order = sorted(range(n), key=lambda b: hashlib.md5(f"{SEED}:0:{b}:{source}".encode()).hexdigest())
        chosen |= {(source, b) for b in order[: quotas[source]]}
    return kept, left, Counter(s for s in spans if s[:2] in chosen)


def test_stages_and_run_agree_with_brute_force(spark, corpus):
    kept, texts, mixture = by_hand(spark, corpus)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    sizes = [docs.count()]
    for (name, stage), expected in zip(P.STAGES[:-1], kept, strict=True):
        docs = stage(spark, docs, corpus).cache()
        assert docs.columns == COLUMNS, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} == expected, name
        sizes.append(docs.count())
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in docs.collect()} == {d: t for d, (t, _) in texts.items()}
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    result = P.run(spark, corpus).collect()
    rows = Counter((r.source, r.block, r.doc_id, r.first_token, r.end_token) for r in result)
    assert rows == mixture and sum(rows.values()) > 5
    # the mixture can be written from the result alone
    assert all(r.text.split() == texts[r.doc_id][0].split()[r.first_token : r.end_token] for r in result)
    sizes = Counter()
    for r in result:
        sizes[r.source, r.block] += len(r.text.split())
    assert set(sizes.values()) == {BLOCK}


def test_stages_are_named_and_survive_empty_tables(spark, corpus, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_stages_handle_nulls_and_extra_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    odd = spark.createDataFrame([(None, "Some words of a text.", None, None, None), (1000, None, None, None, None), (1001, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "'x' as row", "'y' as gone", "1 as n", "2 as found", "3 as at")
    for _, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, corpus)
        assert docs.columns == columns
    assert docs.where("doc_id is null").count() == 1 and docs.where("text is null or text = ''").count() == 0
    assert P.STAGES[-1][1](spark, docs, corpus).count() > 5
