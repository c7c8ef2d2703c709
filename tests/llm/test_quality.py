import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from probitas.llm import quality_classifier as C
from probitas.llm import quality_rules as R
from probitas.llm.common import pieces

JUNK = ["%%% {}### {}$$$ {}&&&", "{}!! {}!! {}!!", "{} {} {} {} {} {}", "{} | {} | {} |"]


def corpus(prose, n, seed=1):
    """(doc_id, text), (doc_id, quality, toxic): clean, junk and toxic texts in turn."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = prose(rnd.randint(30, 120), seed * 1000 + k).split()
        lines = [" ".join(words[i : i + 15]).capitalize() + "." for i in range(0, len(words), 15)]
        kind = k % 5
        if kind == 0:
            form = rnd.choice(JUNK)
            body = " ".join(form.format(*([w] * 6)).upper() if "!!" in form else form.format(*([w] * 6)) for w in words)
            lines = [lines[0], body, lines[-1]]
        elif kind == 1:
            spoiled = words[:]
            for _ in range(max(2, len(words) // 25)):
                spoiled.insert(rnd.randrange(len(spoiled)), rnd.choice(("vileword", "nastyterm", "grimly" + rnd.choice("abcdefgh"))))
            lines = [" ".join(spoiled[i : i + 15]).capitalize() + "." for i in range(0, len(spoiled), 15)]
        docs.append((k, "\n".join(lines)))
        labels.append((k, int(kind != 0), int(kind == 1)))
    return docs, labels


def tables(spark, make, docs, labels):
    return make(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(0)
    for _ in range(60):
        field = R.Field(transition=rng.normal(size=(2, 2)))
        scores = rng.normal(size=rng.integers(1, 8)) * 2
        value = lambda y: sum(s * l for s, l in zip(scores, y, strict=True)) + sum(field.transition[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731, E741
        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert np.isclose(value(field.decode(scores)), value(best))


def test_gradient_reaches_the_likelihood_of_all_labellings():
    """The fit beats random weights in exact likelihood, computed by enumeration."""
    rng = np.random.default_rng(1)
    sequences = []
    for _ in range(40):
        y = (rng.random(5) < 0.5).astype(int)
        x = np.full((5, 2), R.FEATURES)
        x[:, 0] = np.where(rng.random(5) < 0.9, y, 1 - y)
        sequences.append((x, y))

    def likelihood(f):
        total = 0.0
        for x, y in sequences:
            s = f.scores(x)
            score = lambda z: (s * np.array(z)).sum() + sum(f.transition[a, b] for a, b in itertools.pairwise(z))  # noqa: B023, E731
            total += score(y) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=5)])
        return total

    fitted = R.Field().fit(sequences)
    best = likelihood(fitted)
    for _ in range(20):
        noise = R.Field(fitted.emission + rng.normal(size=fitted.emission.shape) * 0.3, fitted.transition + rng.normal(size=(2, 2)) * 0.3)
        assert likelihood(noise) <= best + 1e-2


def test_rules_on_held_out_documents(spark, make, prose):
    docs, labels = corpus(prose, 400)
    field = R.train(*tables(spark, make, docs, labels))
    new, truth = corpus(prose, 200, seed=9)
    kept = {r.doc_id for r in R.content_documents(make(new), field).collect()}
    good = [d for d, q, _ in truth if q]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d, q, _ in truth if not q) <= 0.1 * (len(truth) - len(good))


def test_classifier_on_held_out_documents(spark, make, prose):
    docs, labels = corpus(prose, 900)
    model = C.train(*tables(spark, make, docs, labels))
    new, truth = corpus(prose, 300, seed=9)
    kept = {r.doc_id for r in C.good_documents(make(new), model).collect()}
    good = [d for d, q, t in truth if q and not t]
    bad = [d for d, q, t in truth if not q or t]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d in kept for d in bad) <= 0.15 * len(bad)


def test_all_texts_together_are_decoded_like_each(monkeypatch):
    rng = np.random.default_rng(4)
    for together in (1, 3, 24):
        monkeypatch.setattr(R, "_TOGETHER", together)
        for _ in range(20):
            field = R.Field(transition=rng.normal(size=(2, 2)))
            n = rng.choice([0, 1, 2, 5, 9, 60], size=40)
            heads = np.concatenate([[0], np.cumsum(n)])
            scores = np.round(rng.normal(size=heads[-1]), 1)
            got = field.decode_all(scores, heads)
            assert [got[a:b].astype(int).tolist() for a, b in itertools.pairwise(heads)] == [field.decode(scores[a:b]) for a, b in itertools.pairwise(heads)]
    assert not len(field.decode_all(np.zeros(0), np.zeros(1, np.int64)))


def sample(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array(texts)], names=["doc_id", "preferred", "text"])
    return C._sample(pa.Table.from_batches(list(C._row_features(iter([batch])))))


def test_threshold_is_the_quantile(spark, make, prose):
    docs, labels = corpus(prose, 300)
    model = C.train(*tables(spark, make, docs, labels), most=200, held_out=100)
    open_ = model._replace(threshold=-np.inf)
    scores = {r.doc_id: r.score for r in C.good_documents(make(docs), open_).collect()}
    from pyspark.sql import functions as F

    order = [r.doc_id for r in spark.createDataFrame(labels, "doc_id bigint, q int, t int").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    held_out = sorted(scores[d] for d in order[200:] if labels[d][1] and not labels[d][2])
    assert len(held_out) > 40 and model.threshold == held_out[int(C.REJECTED * (len(held_out) - 1))]
    strict = C.train(*tables(spark, make, docs, labels), most=200, held_out=100, rejected=0.5)
    assert strict.threshold == held_out[int(0.5 * (len(held_out) - 1))]
    kept = {r.doc_id for r in C.good_documents(make(docs), strict).collect()}
    assert kept == {d for d, s in scores.items() if s >= strict.threshold}


def test_fit_agrees_with_a_version_in_plain_python():
    """Adam on the logistic loss of pairs, a feature at a time, in dictionaries."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab" if k % 2 else "bc") + str(rnd.randrange(4)) for _ in range(12)) + "." * (k % 3) for k in range(30)]
    preferred = np.arange(30) % 2 == 1
    data = sample(texts)
    model = C.fit(data, preferred, steps=20)
    rng = np.random.default_rng(3)
    bad, good = [k for k in range(30) if not preferred[k]], [k for k in range(30) if preferred[k]]
    losers = [k for k in bad for _ in range(C.PARTNERS)]
    winners = [int(x) for x in rng.choice(np.array(good), len(losers))]
    mean = [sum(col) / 30 for col in zip(*data.shape.tolist(), strict=True)]
    scale = [math.sqrt(sum((x - m) ** 2 for x in col) / 30) + 1e-6 for col, m in zip(zip(*data.shape.tolist(), strict=True), mean, strict=True)]
    rows = [{("shape", j): max(-8.0, min(8.0, (x - mean[j]) / scale[j])) for j, x in enumerate(row)} for row in data.shape.tolist()]
    seen = Counter(data.buckets.tolist())
    for bucket, weight, row in zip(data.buckets.tolist(), data.weights.tolist(), data.row.tolist(), strict=True):
        if seen[bucket] >= C.LEAST_DOCS:
            rows[row][bucket] = rows[row].get(bucket, 0.0) + weight * 8
    w = dict.fromkeys({f for r in rows for f in r}, 0.0)
    first, second = dict(w), dict(w)
    for step in range(1, 21):
        score = [sum(w[f] * x for f, x in r.items()) for r in rows]
        gradient = {f: -3e-4 * v for f, v in w.items()}
        for a, b in zip(winners, losers, strict=True):
            push = 1 / (1 + math.exp(score[a] - score[b])) / len(losers)
            for sign, r in ((1, rows[a]), (-1, rows[b])):
                for f, x in r.items():
                    gradient[f] += sign * push * x
        for f, g in gradient.items():
            first[f] = 0.9 * first[f] + 0.1 * g
            second[f] = 0.999 * second[f] + 0.001 * g * g
            w[f] += 0.05 * (first[f] / (1 - 0.9**step)) / (math.sqrt(second[f] / (1 - 0.999**step)) + 1e-8)
    expected = [sum(w[f] * x for f, x in r.items()) for r in rows]
    assert np.allclose(data.scores(model), expected, rtol=1e-4, atol=1e-4) and len(w) > len(C.SHAPES) + 10
    [(_, _, piece)] = pieces(pa.array(texts))
    assert np.allclose(model.scores(piece), expected, rtol=1e-4, atol=1e-4)
    assert min(np.array(expected)[preferred]) > max(np.array(expected)[~preferred])


def test_words_are_summed_like_their_features():
    """Against the matrix of rows and buckets: words of all lengths, repeated ones, rows without words and with none that counts."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abc", k=n)) for n in (1, 3, 4, 5, 6, 7, 12) for _ in range(4)]
    texts = ["", *(" ".join(rnd.choices(vocabulary, k=rnd.randrange(30))) for _ in range(40)), "onlyhere", ""]
    data = sample(texts)
    rng = np.random.default_rng(5)
    for least in (1, C.LEAST_DOCS, 1000):
        known = np.bincount(data.buckets, minlength=1 << C.BITS) >= least
        matrix = np.zeros((len(texts), 1 << C.BITS))
        np.add.at(matrix, (data.row, data.buckets), data.weights * 8)
        matrix[:, ~known] = 0
        terms = C._terms(data, known)
        assert np.array_equal(terms.used, np.flatnonzero(known))
        w, pull = rng.normal(size=len(terms.used)), rng.normal(size=len(texts))
        assert np.allclose(terms.scores(w), matrix[:, terms.used] @ w) and np.allclose(terms.gradient(pull), pull @ matrix[:, terms.used])
    together = C._text_sample(pa.array(texts))
    terms = C._terms(together, np.bincount(together.buckets, minlength=1 << C.BITS) > 0)
    assert len(terms.term) == sum(len(set(t.split())) for t in texts) and terms.columns.shape == (4, len({w for t in texts for w in t.split()}))


def test_beginnings_of_words_cost_no_step_in_each_row():
    """Fitting as many different words takes about as long whether they have beginnings or not; with a step for each feature of a row it is over twice as long."""
    rnd = random.Random(9)
    seconds = []
    for form in ("{:03x}", "{:03x}beginning"):
        data = sample([" ".join(form.format(k) for k in rnd.sample(range(4096), 300)) for _ in range(600)])
        times = []
        for _ in range(3):
            start = time.process_time()
            C.fit(data, np.arange(600) % 2 == 0, steps=60)
            times.append(time.process_time() - start)
        seconds.append(min(times))
    assert seconds[1] < 2 * seconds[0]


def test_documents_of_one_id_are_one_for_training(spark, make, prose):
    docs, labels = corpus(prose, 60)
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    many = [*docs, *[(3, docs[3][1])] * 500, (3, "~ larger text")]
    once, again = (R.train(make(d), labelled) for d in (docs, many))
    assert np.array_equal(once.emission, again.emission) and np.array_equal(once.transition, again.transition)
    assert np.array_equal(C.train(make(docs), labelled).word, C.train(make(many), labelled).word)


def test_pieces_do_not_change_results(prose):
    texts = [prose(n, n) for n in (1, 5, 300, 40)] + ["", "x"]
    one = next(pieces(pa.array(texts)))[2]
    together = R.line_features(one)
    apart = [R.line_features(p) for _, _, p in pieces(pa.array(texts), limit=1)]
    assert np.array_equal(together[0], np.concatenate([a[0] for a in apart])) and np.array_equal(together[1], np.concatenate([a[1] for a in apart]))
    whole = C.features(one)
    parts = [C.features(p) for _, _, p in pieces(pa.array(texts), limit=1)]
    assert np.allclose(whole[0], np.concatenate([p[0] for p in parts]))
    assert sorted(zip(whole[1], whole[2], strict=True)) == sorted(x for p in parts for x in zip(p[1], p[2], strict=True))


def test_edge_cases(spark, make, prose):
    docs, labels = corpus(prose, 150)
    long = "\n".join(prose(12, k).capitalize() + "." for k in range(5000))
    rows = [(None, docs[2][1]), (1, None), (2, ""), (3, " \n\t"), (4, long), (5, docs[3][1]), (5, docs[3][1])]
    odd = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    df = make(rows, clash=True)
    field = R.train(make(docs), odd)
    got = sorted(str(r.doc_id) for r in R.content_documents(df, field).collect())
    assert got == ["4", "5", "5", "None"]
    kept = R.keep_content_documents(df, field)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == got
    model = C.train(make(docs), odd)
    scored = C.good_documents(df, model._replace(threshold=-np.inf)).collect()
    assert len(scored) == len(rows) and scored[5].score == scored[6].score and scored[1].score == scored[2].score


def test_no_labels_and_no_documents(spark, make, prose):
    docs, labels = corpus(prose, 10)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = make(docs)
    assert R.content_documents(df, R.train(df, none)).count() == 10
    assert C.good_documents(df, C.train(df, none)).count() == 10
    assert R.content_documents(make([]), R.train(make([]), none)).collect() == []
    assert C.good_documents(make([]), C.train(make([]), none)).collect() == []


def by_place(spark, ids):
    from pyspark.sql import functions as F

    return [r.doc_id for r in spark.createDataFrame([(k,) for k in ids], "doc_id bigint").orderBy(F.xxhash64("doc_id")).collect()]


def test_all_labelled_documents_count(spark, make):
    """Of 12,000, a bad word is only in some of the last quarter of those that the weights are fitted to, and the held-out ones are 4,000."""
    rnd = random.Random(2)
    order = by_place(spark, range(12_000))
    late = set(order[6_000:8_000])
    docs, labels = [], []
    for k in range(12_000):
        words = [f"{a}{b}" for a, b in zip(rnd.choices("bdfgklmn", k=12), rnd.choices(["aro", "eli", "umo", "ina", "osu"], k=12), strict=True)]
        toxic = k % 8 == 0
        if toxic:
            words[rnd.randrange(12)] = "grimlate" if k in late else "vileword"
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    model = C.train(*tables(spark, make, docs, labels))
    plain = docs[1][1].split()
    kept = {r.doc_id for r in C.good_documents(make([(1, " ".join(plain)), (2, " ".join([*plain[:5], "grimlate", *plain[6:]])), (3, " ".join([*plain[:5], "vileword", *plain[6:]]))]), model).collect()}
    assert kept == {1}
    scores = {r.doc_id: r.score for r in C.good_documents(make(docs), model._replace(threshold=-np.inf)).collect()}
    held_out = sorted(scores[d] for d in order[8_000:] if d % 8)
    assert len(held_out) > 3_000 and model.threshold == held_out[int(C.REJECTED * (len(held_out) - 1))]


def test_weights_are_the_mean_of_blocks(spark, make, prose, monkeypatch):
    """Blocks are told by Spark's hash; what is done with them is done again in plain Python."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "BLOCK_SIDE", 1)
    docs, labels = corpus(prose, 240)
    model = C.train(*tables(spark, make, docs, labels), block=50)
    order = by_place(spark, range(240))[:160]
    places = spark.createDataFrame([(k,) for k in order], "doc_id bigint").select("doc_id", F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(4)).alias("block"))
    block = {r.doc_id: r.block for r in places.collect()}
    assert set(block.values()) == {0, 1, 2, 3}
    good = {k: bool(q and not t) for k, q, t in labels}
    everything = sample([docs[k][1] for k in order])
    seen = Counter(everything.buckets.tolist())
    known = np.array([seen[b] >= C.LEAST_DOCS for b in range(1 << C.BITS)])
    whole = C.Whole(everything.shape.mean(axis=0), everything.shape.std(axis=0) + 1e-6, known)
    total, times, shape = Counter(), Counter(), np.zeros(len(C.SHAPES))
    for b in range(4):
        mine = [k for k in order if block[k] == b]
        data = sample([docs[k][1] for k in mine])
        fitted = C.fit(data, np.array([good[k] for k in mine]), whole=whole)
        shape += fitted.shape * len(mine) / 160
        for bucket in data.buckets.tolist():
            total[bucket] += fitted.word[bucket]
            times[bucket] += 1
    expected = np.array([total[b] / times[b] if times[b] else 0.0 for b in range(1 << C.BITS)])
    assert np.count_nonzero(expected) > 100
    assert np.allclose(model.word, expected, atol=1e-3) and np.allclose(model.shape, shape, atol=1e-3)


def test_scarce_documents_are_in_every_block(spark, make, prose):
    """Four bad documents for eight blocks: all good ones are paired, so no word of theirs is without a weight, and scores are like those of the plain fit."""
    order = by_place(spark, range(240))
    bad = set(order[:160:40])
    docs = [(k, f"vileword {t} vileword" if k in bad else t) for k, t in ((k, prose(30, k)) for k in range(240))]
    tables_ = tables(spark, make, docs, [(k, int(k not in bad), 0) for k in range(240)])
    model, plain = (C.train(*tables_, block=n) for n in (20, 6000))
    data = sample([docs[k][1] for k in order[:160]])
    known = np.bincount(data.buckets, minlength=1 << C.BITS) >= C.LEAST_DOCS
    assert np.array_equal(model.word != 0, known)
    assert np.corrcoef(data.scores(model), data.scores(plain))[0, 1] > 0.95


def test_key_of_a_rank(spark):
    rnd = random.Random(6)
    for keys in ([rnd.randrange(-(1 << 63), 1 << 63) for _ in range(500)], [rnd.randrange(-300_000, 300_000) for _ in range(70_000)], [5] * 70_000 + [-1]):
        df = spark.createDataFrame([(k,) for k in keys], "key bigint")
        assert all(C._at_rank(df, r) == sorted(keys)[r] for r in (0, 1, 250, len(keys) - 1))
