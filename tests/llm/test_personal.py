"""Personal data: patterns against plain regular expressions, the field against enumeration and held-out rows."""

import itertools
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from onefold.llm import crf
from onefold.llm.personal import KINDS, LABELS, allowed, fit_field, gold_labels, labelled_table, personal_data, sequence_features, spans_of

SF = "/root/testdata/sf0.01"


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain_spans(text):
    """The contract, word for word."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


@pytest.fixture(scope="module")
def model(spark):
    return fit_field(labelled_table(spark))


def found(model, text):
    return [(KINDS[k], text[a:b], fixed) for k, a, b, fixed in spans_of(pa.array([text]), model)[0]]


def test_query_holds_the_patterns_spans(spark):
    rows = {r["doc_id"]: r for r in entry.queries()["op12_personal_data"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(rows) == {d["doc_id"] for d in docs}
    some = 0
    for d in docs:
        want, r = plain_spans(d["text"] or ""), rows[d["doc_id"]]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert r["base_sha256"] == sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(","))
        some += len(want)
    assert some > 50


def test_patterns_on_drawn_texts(model):
    """Texts of the characters that matter, so that matches run into each other."""
    draw = np.random.default_rng(5)
    parts = ["1", "23", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "a", "é", "😀", "\n", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "a.b@c.de",
             "+1 (743) 555-3824", "%", "_", "..", "@@", "00004", "  "]
    texts = ["".join(draw.choice(parts, draw.integers(0, 40))) for _ in range(1500)] + [None, "", "@", "a@", "@b.c", "a@b.c@d.e", "9" * 4000 + ".1.2.3"]
    for text, spans in zip(texts, spans_of(pa.array(texts), model), strict=True):
        assert [(KINDS[k], a, b) for k, a, b, fixed in spans if fixed] == plain_spans(text or ""), text
        taken = [set(range(a, b)) for _, a, b, fixed in spans if fixed]
        for k, a, b, fixed in spans:
            assert fixed or not any(t & set(range(a, b)) for t in taken)


def test_field_adds_what_the_patterns_miss(model):
    cases = {
        "x 4465758382889437 4465758382889437 y": [("card", "4465758382889437")] * 2,
        "one +1 (826) 555-4081 190.137.223.204 two": [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")],
        "write to anna at mail dot com today": [("email", "anna at mail dot com")],
        "or anna [at] mail [dot] org, thanks": [("email", "anna [at] mail [dot] org")],
        "please call (743) 555-3824 soon": [("phone", "(743) 555-3824")],
        "é😀 mail: joe@x.com ok": [("email", "joe@x.com")],
    }
    for text, want in cases.items():
        assert [f[:2] for f in found(model, text)] == want
    clean = ["on 2024-05-17 at 14:30 we met", "total 1,299.00 for 12 items", "version 3.2.1 of 12.03.2021", "order 12345678 of page 312", "meet me at noon.\nThe end",
             "pi is 3.14159 and e 2.71828", "in 1999, 2004 and 2010", "chapter 4, verse 12", "a 16 digit 1234567890123456 number", ""]
    assert [found(model, t) for t in clean] == [[]] * len(clean)


def test_rows_of_every_kind(spark, model):
    schema = "doc_id long, text string, spans string, rest int, n_ip string, kind string"
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "1.2.3.4 é"), (2, None), (3, ""), (4, "x " * 100_000 + "+1 743 555 3824"), (5, "7" * 300_000)]
    got = personal_data(spark.createDataFrame([(*r, "s", 1, "n", "k") for r in rows], schema), model, redact=True).collect()
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got) == sorted(
        [("1", "email:0:6")] * 2 + [("None", "ip:0:7"), ("2", ""), ("3", ""), ("4", "phone:200000:200015"), ("5", "")])
    assert {r["redacted"] for r in got if r["doc_id"] in (1, None)} == {"[EMAIL]", "[IP] é"}
    assert all(r["rest"]["n_ip"] == "n" for r in got)
    assert personal_data(spark.createDataFrame([], schema), model).count() == 0


def test_viterbi_and_marginals_match_enumeration():
    draw = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 8])
    emission, transition, start = draw.normal(size=(8, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    best, total, p, pairs = [], 0.0, np.zeros((8, 3)), np.zeros((3, 3))
    for lo, hi in itertools.pairwise(first):
        if lo == hi:
            continue
        paths = list(itertools.product(range(3), repeat=hi - lo))
        score = np.array([start[x[0]] + sum(emission[lo + i, y] for i, y in enumerate(x)) + sum(transition[a, b] for a, b in itertools.pairwise(x)) for x in paths])
        best += paths[int(np.argmax(score))]
        z = np.log(np.exp(score).sum())
        total += z
        for x, w in zip(paths, np.exp(score - z), strict=True):
            for i, y in enumerate(x):
                p[lo + i, y] += w
            for a, b in itertools.pairwise(x):
                pairs[a, b] += w
    assert crf.viterbi(emission, first, transition, start).tolist() == best
    got = crf.marginals(emission, first, transition, start)
    assert np.isclose(got[0], total) and np.allclose(got[1], p) and np.allclose(got[2], pairs)
    assert len(crf.viterbi(emission[:0], np.array([0]), transition, start)) == 0


def test_fit_reaches_the_optimum():
    """At the end the penalised likelihood has no slope left, and labels that may not follow do not."""
    draw = np.random.default_rng(4)
    ids, gold, first = draw.integers(0, 6, (60, 2)), draw.integers(0, 2, 60), np.arange(0, 61, 5)
    may, starts = np.array([[True, False], [True, True]]), np.array([True, True])
    gold = np.array([0 if i % 5 and gold[i - i % 5:i].min() == 0 else g for i, g in enumerate(gold)])
    w, t, s = crf.fit(ids, 6, gold, first, may, starts, l2=0.5, steps=2000, rate=0.02)
    assert t[0, 1] == crf.FORBIDDEN
    full = np.vstack([w, np.zeros(2)])

    def value(x):
        weight, tr, st = x[:6], x[6:8], x[8]
        tr = np.where(may, tr, crf.FORBIDDEN)
        em = np.vstack([weight, np.zeros(2)])[ids].sum(axis=1)
        total = crf.marginals(em, first, tr, st)[0]
        inner = [i for i in range(60) if i % 5]
        path = em[np.arange(60), gold].sum() + sum(tr[gold[i - 1], gold[i]] for i in inner) + st[gold[::5]].sum()
        return path - total - 0.25 * (x[:8][..., :] ** 2).sum() - 0.25 * (st**2).sum()

    x = np.vstack([full[:6], np.where(may, t, 0.0), s])
    for at in [(0, 0), (3, 1), (6, 0), (7, 1), (8, 0)]:
        step = np.zeros_like(x)
        step[at] = 1e-4
        assert abs(value(x + step) - value(x - step)) / 2e-4 < 5e-3


def test_held_out_rows_of_the_labelled_table(spark):
    """Trained on three quarters of the labelled rows, the field labels the words of the rest."""
    table = labelled_table(spark).withColumn("part", F.crc32("text") % 4)
    model = fit_field(table.where("part <> 0"))
    right = total = false = 0
    for r in table.where("part = 0").collect():
        words, gold = gold_labels(r["text"], r["spans"])
        emission = np.array([model.emission(f) for f in sequence_features(words)])
        got = crf.viterbi(emission, np.array([0, len(words)]), model.transition, model.start)
        gold = np.array(gold)
        right, total = right + int((got == gold)[gold > 0].sum()), total + int((gold > 0).sum())
        false += int((got[gold == 0] > 0).sum())
    assert total > 100 and right >= 0.9 * total and false <= 0.03 * total
    assert len(allowed()[1]) == LABELS
