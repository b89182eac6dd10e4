"""No cut, cap, switch or sample by id changes a result; fits against plain numerics and held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from onefold.llm import lang_id, toxicity
from onefold.llm.backoff import backoff_scores
from onefold.llm.bit_sliced import top_inner_products
from onefold.llm.decontaminate import contained_items
from onefold.llm.lang_id import fit_languages, predict_languages

SF = "/root/testdata/sf0.01"


def plain_scores(corpus, texts, order, alpha=0.4):
    counts = [Counter(tuple(w[i:i + n]) for t in corpus if t for w in [t.split()] for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = max(1, sum(counts[0].values()))
    out = []
    for text in texts:
        words, score, backed = (text or "").split(), 0.0, 0
        for i, word in enumerate(words):
            full = min(order, i + 1)
            for n in range(full, 0, -1):
                gram = tuple(words[i - n + 1:i + 1])
                if n == 1:
                    score += math.log(max(1, counts[0][(word,)]) / total) + (full - 1) * math.log(alpha)
                    backed += full > 1
                elif counts[n - 1][gram]:
                    score += math.log(counts[n - 1][gram] / counts[n - 2][gram[:-1]]) + (full - n) * math.log(alpha)
                    backed += n < full
                    break
        out.append((len(words), pytest.approx(score, abs=1e-8), backed))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_counts_of_other_texts(spark, order):
    draw = np.random.default_rng(order)
    corpus = [" ".join(draw.choice(list("abcdefg"), draw.integers(0, 12))) for _ in range(60)] + [None, "", "only here"]
    texts = [" ".join(draw.choice(list("abcdefgz"), draw.integers(0, 12))) for _ in range(40)] + [None, "", "z z", "never seen words"]
    asked = spark.createDataFrame([(i, t, True, 1) for i, t in enumerate(texts)], "doc_id long, text string, counted boolean, pack int")
    told = spark.createDataFrame([(i % 5, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["log_score"], r["n_backed_off"]) for r in backoff_scores(asked, order, counts_from=told).collect()}
    assert [got[i] for i in range(len(texts))] == plain_scores(corpus, texts, order)
    own = {r["doc_id"]: (r["n_words"], r["log_score"], r["n_backed_off"]) for r in backoff_scores(asked, order).collect()}
    assert [own[i] for i in range(len(texts))] == plain_scores(texts, texts, order)
    assert backoff_scores(asked.limit(0), counts_from=told).count() == 0
    assert backoff_scores(asked, counts_from=told.limit(0)).count() == len(texts)


@pytest.mark.parametrize("route", [500_000, 0])
def test_rows_and_items_of_one_id_stay_apart(spark, route):
    left, right = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    items = spark.createDataFrame([(1, left), (1, right), (1, right), (2, f"{left} {right}")], "item_id long, text string")
    docs = spark.createDataFrame([(7, left), (7, right), (8, f"{left} {right}"), (9, " ".join(left.split()[:12])), (9, " ".join(left.split()[12:]))],
                                 "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contained_items(docs, items, broadcast_shingles=route).collect())
    assert got == [(7, 1, 16, 16), (8, 1, 16, 16), (8, 2, 36, 36)]


def test_wide_components_take_part(spark):
    big = float(2**40)
    rows = [(0, [200000.0, 1.0]), (1, [1.0, 1.0]), (2, [-200000.0, 3.0]), (3, [big, 0.5]), (4, [-big, 2.0]), (5, [0.0, 0.0]), (6, [1e30, 0.0])]
    rows += [(10 + i, [float(i), float(-i)]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (65_536, 3):
        got = [tuple(r) for r in top_inner_products(frame, F.col("vec_id") < 6, k=30, block_rows=size, block_queries=2).collect()]
        ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if max(map(abs, v)) * 1024 < 2**61}
        want = []
        for q in range(6):
            score = {i: max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v, strict=True)))) for i, v in ints.items() if i != q}
            want += [(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))]
        assert sorted(got) == sorted(want)


def test_rows_of_one_id_are_drawn_like_others(spark):
    """Many rows of one language share a doc_id; each is drawn by itself, and the bound holds."""
    words = {"en": "the quick brown fox jumps over it", "de": "der schnelle braune fuchs springt weit", "xx": "zorg blip quon"}
    rows = [(5, words["en"], "en")] * 6000 + [(i, words["de"], "de") for i in range(3000)] + [(None, words["xx"], "xx")] * 2000
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = fit_languages(learn, lang_id.Settings(per_language=300))
    assert model.languages == ["de", "en", "xx"]
    asked = spark.createDataFrame(list(enumerate(words.values())), "doc_id long, text string")
    assert [r["lang_pred"] for r in sorted(predict_languages(asked, model).collect())] == ["en", "de", "xx"]


def test_toxic_rows_of_one_id(spark):
    rows = [(i % 5, f"you idiot moron {i % 7}") for i in range(3000)] + [(i, f"a calm sentence number {i % 50}") for i in range(10, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(i, 0) for i in range(10, 17)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, toxicity.Settings(toxic_rows=200, unlabelled_rows=600))
    asked = spark.createDataFrame([(1, "idiot moron"), (2, "a calm sentence"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(asked, model).collect()}
    assert got[1] > got[2] and got[1] > got[None]


def test_toxicity_against_held_out_labels(spark):
    """Labels of the held-out fold: most toxic texts are found and clean ones left alone."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = Counter()
    for r in entry.queries()["op6_pu_toxicity"](spark, sf_dir).collect():
        if r["held_out"] and labels.get(r["doc_id"]) is not None:
            found[labels[r["doc_id"]], r["predicted"]] += 1
    assert found[1, 1] >= 0.7 * (found[1, 0] + found[1, 1]) and found[0, 1] <= 0.01 * (found[0, 0] + found[0, 1])


def test_language_against_held_out_labels(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in entry.queries()["op9_language_id"](spark, SF).collect() if r["held_out"]]
    assert len(rows) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in lang)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.98 * len(rows)


def test_ftrl_steps_are_those_of_the_plain_algorithm():
    """One coordinate and one class at a time, in double precision."""
    draw = np.random.default_rng(0)
    s = lang_id.Settings(dims_bits=4, epochs=2, batch=4)
    rows, label = [], draw.integers(0, 3, 24)
    for y in label:
        places = np.unique(np.append(draw.integers(0, 16, 4), y))
        rows.append((places.astype(np.uint16), draw.random(len(places)).astype(np.float32)))
    z, n, w = np.zeros((17, 3)), np.zeros((17, 3)), np.zeros((17, 3))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(s.epochs):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), s.batch):
            grad = np.zeros((17, 3))
            for r in shuffled[at:at + s.batch]:
                x = np.zeros(17)
                x[rows[r][0]], x[16] = rows[r][1], 1
                e = np.exp(x @ w - (x @ w).max())
                grad += np.outer(x, e / e.sum() - np.eye(3)[label[r]])
            for i in range(17):
                for c in range(3):
                    sigma = (math.sqrt(n[i, c] + grad[i, c] ** 2) - math.sqrt(n[i, c])) / s.alpha
                    z[i, c] += grad[i, c] - sigma * w[i, c]
                    n[i, c] += grad[i, c] ** 2
                    l1, l2 = (0, 0) if i == 16 else (s.l1, s.l2)
                    w[i, c] = 0 if abs(z[i, c]) <= l1 else -(z[i, c] - math.copysign(l1, z[i, c])) / ((s.beta + math.sqrt(n[i, c])) / s.alpha + l2)
    got = lang_id.fit_ftrl(rows, label, 3, s)
    np.testing.assert_allclose(got, w, atol=2e-4)
    assert 0 < np.count_nonzero(got[:16]) < 48


def test_temperature_is_the_minimum_of_the_log_loss():
    draw = np.random.default_rng(1)
    logits, label = 4 * draw.normal(size=(400, 3)), draw.integers(0, 3, 400)
    label[:250] = logits[:250].argmax(1)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4000))
    loss = [-np.log(lang_id.softmax(logits / t)[np.arange(400), label]).mean() for t in grid]
    assert lang_id.temperature(logits, label) == pytest.approx(grid[int(np.argmin(loss))], rel=0.01)


def test_first_step_of_the_risk_follows_its_slope():
    """The fitted weights lower the non-negative risk, and a step against the numeric slope is what one step does."""
    draw = np.random.default_rng(3)
    toxic = (draw.random((60, 5)) < [0.9, 0.5, 0.1, 0.1, 0.1]).astype(np.float32)
    other = (draw.random((400, 5)) < [0.1, 0.15, 0.1, 0.1, 0.1]).astype(np.float32)
    prior, s = 0.1, toxicity.Settings(steps=1, l2=0.0)

    def risk(w):
        f = [toxicity.sigmoid(x @ w[:-1] + w[-1]) for x in (toxic, other)]
        clean = -np.log(1 - f[1]).mean() + prior * np.log(1 - f[0]).mean()
        return -prior * np.log(f[0]).mean() + max(0.0, clean)

    start = np.append(np.zeros(5), np.log(prior / (1 - prior)))
    slope = np.array([(risk(start + 1e-6 * e) - risk(start - 1e-6 * e)) / 2e-6 for e in np.eye(6)])
    w, b = toxicity.fit_nnpu(toxic, other, prior, s)
    steep = np.abs(slope) > 1e-3
    assert steep.sum() >= 4
    np.testing.assert_allclose((np.append(w, b) - start)[steep], -s.rate * np.sign(slope[steep]), atol=1e-3)
    w, b = toxicity.fit_nnpu(toxic, other, prior, toxicity.Settings(steps=300))
    assert risk(np.append(w, b)) < risk(start) and w[0] > 1 and w[0] > w[2]


def test_a_pack_of_the_substring_step_is_judged_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from onefold.llm import packs, substring_dedup

    rng, k = np.random.default_rng(0), packs.PACK_BYTES // 1800
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 20_000, 300)) for _ in range(k)]
    table = pa.table({"pack": pa.array([0] * k, pa.int64()), "doc_id": pa.array(range(k), pa.int64()), "text": texts, "rest": [{"none": None}] * k})
    substring_dedup._ask(table, 13, 6)  # tables that are kept are made here
    tracemalloc.start()
    substring_dedup._ask(table, 13, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80_000_000
