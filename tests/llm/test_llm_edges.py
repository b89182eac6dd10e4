"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from onefold.llm import backoff, bit_sliced, html_text, letters, packing, tokens
from onefold.llm.backoff import backoff_scores, from_small, from_sorted, small_numbers, sorted_hashes
from onefold.llm.bit_sliced import top_inner_products
from onefold.llm.components import components
from onefold.llm.decontaminate import contained_items
from onefold.llm.html_text import main_text
from onefold.llm.lang_id import fit_languages, predict_languages
from onefold.llm.near_dup import near_duplicates
from onefold.llm.packing import pack_documents
from onefold.llm.revisits import canonical_url, resolve_revisits
from onefold.llm.substring_dedup import remove_repeats
from onefold.llm.toxicity import fit_toxicity, score_toxicity

CLASH = "pack int, bucket string, rest string, id string, key string, label string, block string, part string, draw string, score string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LONG = " ".join(f"w{i}" for i in range(30_000))
COPY = " ".join(f"c{i}" for i in range(40))
TEXTS = [
    (1, COPY), (2, COPY), (2, COPY), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, LONG),
    (9, "x" * 300_000), (None, COPY), (10, COPY + " tail"), (11, "123 !!! 456"), (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None) + (None,) * 10 for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_and_windows():
    texts = pa.array(["ab  c\x0bd", None, "", " x y", "ab c d"])
    words = tokens.words_of(texts)
    assert words.counts().tolist() == [3, 0, 0, 2, 3]
    assert [words.bytes_of(i).decode() for i in range(5)] == ["ab", "c", "d", " x", "y"]
    hashes = words.hashes()
    at, row = tokens.window_starts(words.first, 3)
    same = tokens.window_hashes(hashes, 3)[at]
    assert row.tolist() == [0, 4] and same[0] == same[1] and hashes[0] == hashes[5]
    assert len(set(hashes.tolist())) == 5
    part = tokens.words_of(texts.slice(3, 2), lower=True)
    assert part.counts().tolist() == [2, 3]


def test_letters():
    points, text = letters.letters_of(pa.array(["aB1c", None, "", "É"]))
    assert "".join(map(chr, points)) == " ab c   é " and text.tolist() == [0, 0, 0, 0, 0, 1, 2, 3, 3, 3]
    for texts in ([], [None], ["", ""], ["1 2"]):
        assert len(letters.letter_words(pa.array(texts, pa.string()))[0]) == 0


def test_substrings(odd, none):
    got = {(r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in remove_repeats(odd).select("doc_id", "kept_text", "n_words", "n_removed").collect()}
    assert got == {
        (1, COPY, 40, 0), (2, "", 40, 40), (3, "", 0, 0), (4, "", 0, 0), (5, "", 0, 0), (6, "one two", 2, 0), (7, "one two", 2, 0),
        (8, LONG, 30_000, 0), (9, "x" * 300_000, 1, 0), (None, COPY, 40, 0), (10, "tail", 41, 40), (11, "123 !!! 456", 3, 0), (None, "", 0, 0),
    }
    spans = {r["doc_id"]: [tuple(s) for s in r["removed_spans"]] for r in remove_repeats(odd).collect()}
    assert spans[10] == [(0, 40)] and spans[1] == []
    assert remove_repeats(none).count() == 0


def test_near_duplicates(odd, none):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 1, False), (10, 1, False), (6, 6, True), (7, 6, False), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True)} <= got
    assert near_duplicates(odd).count() == len(TEXTS)
    assert near_duplicates(none).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "p q r s t u"), (7, "p q r s t u"), (8, "a b c d e f"), (9, "z")], "doc_id long, text string")
    assert rows_of(near_duplicates(docs).select("doc_id", "component_id")) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_near_copies_around_the_threshold(spark):
    """Clouds of near copies, some within 0.8 of each other and some not, one of them hot."""
    from test_llm_queries import components as brute

    rng = np.random.default_rng(3)
    docs, d = {}, 0
    for size, edits in ((300, 3), (40, 2), (40, 5)):
        base = [f"b{size}_{i}" for i in range(90)]
        for _ in range(size):
            own = list(base)
            for at in rng.integers(0, 90, rng.integers(0, edits + 1)):
                own[at] = f"n{rng.integers(1 << 30)}"
            docs[d] = " ".join(own)
            d += 1
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {k: v[0] for k, v in brute(docs, 5).items()}
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame).collect()} == want
    assert 5 < len(set(want.values())) < len(docs) - 50


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contained_items(spark, odd, none):
    items = spark.createDataFrame(
        [(1, COPY), (1, COPY), (2, " ".join(COPY.split()[5:30])), (3, None), (4, ""), (5, "one two"), (None, COPY), (6, "w7 w8 w9 w10 w11 w12"), (7, "not there at all you see")],
        "item_id long, text string",
    )
    want = [(1, 1), (1, 2), (2, 1), (2, 2), (6, 5), (7, 5), (8, 6), (10, 1), (10, 2)]
    small = contained_items(odd, items)
    assert rows_of(small.select("doc_id", "item_id")) == sorted(want, key=repr)
    assert rows_of(contained_items(odd, items, broadcast_shingles=0).select(*small.columns)) == rows_of(small)
    assert contained_items(none, items).count() == 0 and contained_items(odd, items.limit(0)).count() == 0


def test_packing_against_plain_search():
    rng = np.random.default_rng(5)
    sizes = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    bins, capacity = packing.pack(sizes, [16, 40, 100], 4)
    left, open_bins, want = sum(sizes), [], []
    for s in sizes:
        left -= s
        room = [(c - u, i) for i, (c, u) in enumerate(open_bins) if c - u >= s]
        if room:
            least = min(r for r, _ in room)
            # Of bins with equal room the one that got it last is taken; the choice changes no sum.
            want.append(least)
            i = bins[len(want) - 1]
            assert (least, i) in room
        else:
            c = min((c for c in (16, 40, 100) if c >= s), key=lambda c: ((c + 4) / (s + min(c - s, left)), c))
            open_bins.append((c, 0))
            i = len(open_bins) - 1
            want.append(-1)
            assert bins[len(want) - 1] == i
        open_bins[i] = (open_bins[i][0], open_bins[i][1] + s)
    assert capacity == [next(c for c in (16, 40, 100) if c >= u) for _, u in open_bins]


def test_packing_edges(spark, odd, none):
    rows = pack_documents(odd, lengths=(50, 10_000)).collect()
    pieces = sorted(((p["doc_id"] or -1, p["start"], p["length"]) for r in rows for p in r["pieces"]))
    assert pieces == sorted([
        (-1, 0, 40), (1, 0, 40), (2, 0, 40), (2, 0, 40), (6, 0, 2), (7, 0, 2), (8, 0, 10_000), (8, 10_000, 10_000), (8, 20_000, 10_000),
        (9, 0, 1), (10, 0, 41), (11, 0, 3),
    ])
    assert pack_documents(none).count() == 0
    lengths = spark.createDataFrame([(1, 7), (2, None), (3, -4), (4, 0)], "doc_id long, n long")
    assert [(r["capacity"], r["used"]) for r in pack_documents(lengths, tokens="n").collect()] == [(512, 7)]


def test_backoff_edges(odd, none):
    assert np.array_equal(from_small(pa.scalar(small_numbers(np.array([0, 255, 254, 10**12])), pa.binary()), 4), [0, 255, 254, 10**12])
    for values in ([5], [0, 1 << 63], [3, 4, 1 << 47]):
        x = np.array(values, np.uint64)
        assert np.array_equal(from_sorted(pa.scalar(sorted_hashes(x), pa.binary())), x)
    got = {(r["doc_id"], r["n_words"], r["per_word"] is None) for r in backoff_scores(odd).collect()}
    assert (3, 0, True) in got and (8, 30_000, False) in got and (None, 0, True) in got and len(got) == 13
    assert backoff_scores(none).count() == 0
    assert rows_of(backoff_scores(odd, order=1).where("doc_id = 6").select(F.round(F.exp("log_score"), 12))) == [(round((2 / 30_209) ** 2, 12),)]


def test_backoff_counts_what_occurs_once(spark):
    """Against plain counts, and n-grams with a part that occurs once are not asked for."""
    rng = np.random.default_rng(2)
    docs = {i: [f"w{x}" for x in rng.zipf(1.5, 40) % 50] for i in range(30)}
    counts: dict = {}
    for ws in docs.values():
        for n in range(1, 5):
            for i in range(len(ws) - n + 1):
                counts[tuple(ws[i:i + n])] = counts.get(tuple(ws[i:i + n]), 0) + 1
    total = sum(map(len, docs.values()))

    def log_score(ws, i, order, least):
        for n in range(min(order, i + 1), 0, -1):
            gram = tuple(ws[i - n + 1:i + 1])
            if n == 1 or counts[gram] >= least:
                share = counts[gram] / (counts[gram[:-1]] if n > 1 else total)
                return np.log(share) + (min(order, i + 1) - n) * np.log(0.4)

    frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string")
    for order, least in ((3, 1), (4, 1), (4, 2), (3, 3)):
        got = {r["doc_id"]: r["log_score"] for r in backoff_scores(frame, order=order, min_count=least).collect()}
        assert got == pytest.approx({d: sum(log_score(ws, i, order, least) for i in range(len(ws))) for d, ws in docs.items()})
    packs = backoff._squeezed([pa.RecordBatch.from_pydict({"pack": [0], "doc_id": [1], "text": ["a b c a b d"]})])
    grams = backoff._Grams(pa.Table.from_batches(packs), 6)
    assert grams.candidates(3, {2: np.array([2, 1, 1, 2, 1])}, 1)[1].tolist() == [False] * 4


def test_extraction_edges(spark):
    article = "<html><body><nav>menu</nav><article><header>by me</header><h1>Head</h1><p>One &amp;amp; two<br>three<p class='ad'>buy" \
        "<p>four <b>five</b><script>x='</p>'</script><!-- <p>no</p> --><div id=comments><p>first!</p></div></article><footer>f</footer>"
    same = "this sentence stands on every single page of the host"
    rows = [(1, "http://A.com/1", article), (2, None, None), (3, "", ""), (1, "http://a.com/1", article), (4, "http://c.com", "plain < text & more")]
    rows += [(10 + i, f"http://b.com/{i}", f"<p>{same}<div>{i} are the own words here</div><form>q</form>") for i in range(8)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, shard string")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert got[1] == "Head\n\nOne &amp; two three\n\nfour five"
    assert got[2] == got[3] == "" and got[4] == "plain < text & more"
    assert all(got[10 + i] == f"{i} are the own words here" for i in range(8))
    assert main_text(pages).count() == len(rows) and main_text(pages.limit(0)).count() == 0


def test_page_counts_hold_over_the_shards_of_a_host(spark):
    """A notice on 5 pages goes and one on 4 stays, however many shards the host has."""
    often, seldom = "this notice stands on five of the pages here", "that remark can be read on only four pages"
    rows = [(i, f"http://a.com/{i}", f"<p>{often if i < 5 else ''}<p>{seldom if i < 4 else ''}<p>{i} own words") for i in range(40)]
    rows += [(100 + i, f"http://b.com/{i}", f"<p>{often}<p>{i} own words") for i in range(4)]
    rows += [(200 + i, "http://a.com/none", None) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert whole[0] == f"{seldom}\n\n0 own words" and whole[4] == "4 own words" and whole[100] == f"{often}\n\n0 own words"
    for size in (30, 200, 1000):
        assert {r["page_id"]: r["text"] for r in main_text(pages, shard_bytes=size).collect()} == whole


def test_suffix_groups_against_plain_search():
    rng = np.random.default_rng(1)
    token = rng.integers(0, 3, 600).astype(np.uint64)
    page = np.sort(rng.integers(0, 25, 600))
    got = html_text.covered_tokens(token, page, 5, 4)
    where: dict = {}
    for i in range(596):
        if page[i] == page[i + 4]:
            where.setdefault(tuple(token[i:i + 5]), []).append(i)
    want = np.zeros(600, bool)
    for at in where.values():
        if len({page[i] for i in at}) >= 4:
            for i in at:
                want[i:i + 5] = True
    assert np.array_equal(got, want) and want.any() and not want.all()


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    for docs in (odd, none):
        model = fit_toxicity(docs, labels)
        rows = score_toxicity(docs, model).collect()
        assert len(rows) == docs.count() and all(r["score"] == 0.01 and r["predicted"] == 0 for r in rows)
    learn = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} " + ("bad" if i % 5 == 0 else "")) for i in range(400)], "doc_id long, text string")
    model = fit_toxicity(learn, learn.selectExpr("doc_id", "CAST(doc_id % 5 = 0 AS INT) AS toxic"))
    assert all((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in score_toxicity(learn, model).collect())
    assert score_toxicity(odd, model).count() == len(TEXTS)


def test_language_edges(spark, odd, none):
    for docs in (odd, none):
        model = fit_languages(docs)
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in predict_languages(docs, model).collect())
    learn = spark.createDataFrame([(i, "abab cdcd" if i % 2 else "xyxy zwzw", "l1" if i % 2 else "l2") for i in range(60)], "doc_id long, text string, lang string")
    found = predict_languages(odd.withColumn("text", F.when(F.col("doc_id") == 6, "ab cd").otherwise(F.col("text"))), fit_languages(learn)).collect()
    by = {r["doc_id"]: r for r in found}
    assert by[6]["lang_pred"] == "l1" and 0.5 < by[6]["score"] <= 1
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[11]["lang_pred"] == "und" and by[11]["score"] == 0
    assert len(found) == len(TEXTS)


def test_top_k_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-3.0, 0.25]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, []), (8, [1.0]), (None, [9.0, 9.0]), (9, [1e30, 0.0]), (10, [0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, block string, rank int")
    got = top_inner_products(vectors, F.col("vec_id").isin(0, 3, 8), k=3)
    assert rows_of(got) == [(0, 1, 1, 1310720), (0, 2, 1, 1310720), (0, 3, 10, 0)]
    assert top_inner_products(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_bit_slices_against_plain_products():
    rng = np.random.default_rng(2)
    for rows, dims, dropped in ((1, 3, 0), (130, 5, 2), (700, 9, 3), (300, 4, 12)):
        vectors = rng.integers(-900, 900, (rows, dims))
        vectors[rows // 2:] = vectors[:rows - rows // 2]  # ties
        ids = rng.permutation(rows)
        index = bit_sliced.BitSlices(vectors, dropped)
        copy = bit_sliced.BitSlices.from_bytes(rows, index.low, np.array(index.width), index.to_bytes(), dropped)
        for q in (0, rows - 1):
            found, score = bit_sliced.top_k(copy, ids, vectors, vectors[q], ids[q], 10)
            plain = vectors @ vectors[q]
            order = [i for i in np.lexsort((ids, -plain)) if i != q][:10]
            assert found.tolist() == ids[order].tolist() and score.tolist() == plain[order].tolist()


def test_revisits(spark):
    kinds = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, found string, part int"
    url = "HTTPS://www.A.org:443/p/?b=2&utm_x=1&a=1#f"
    rows = [
        (1, url, 10, "response", '"e1"', "d1", "h1", {"Server": "s", "server": "t", "Content-Length": "9"}),
        (2, "http://a.org/p?a=1&b=2", 20, "response", 'W/"e2"', "d2", "h2", None),
        (3, "a.org/p?a=1&b=2", 20, "revisit", '"e1"', "zz", None, {"SERVER": "new", "Content-Length": "0", "X": None}),
        (4, url, 21, "revisit", '"e2"', None, None, None), (5, url, 22, "revisit", None, "d2", None, None), (5, url, 22, "revisit", None, "d2", None, None),
        (6, url, 23, "revisit", None, None, None, None), (7, url, 24, "revisit", '"e1"', "d2", None, None), (8, url, 5, "revisit", None, None, None, None),
        (9, None, 30, "revisit", None, None, None, None), (10, url, None, "revisit", None, None, None, None), (None, url, 30, "response", None, None, "bad", None),
        (11, url, 40, "other", None, None, None, None), (12, "http://b.org", 1, "revisit", None, None, None, None),
    ]
    records = spark.createDataFrame([(*r, "x", 1) for r in rows], kinds)
    got = rows_of(resolve_revisits(records, partitions=5).select("record_id", "response_id", "outcome", "digest"))
    assert got == sorted([
        (3, 1, "resolved", "h1"), (4, 2, "resolved", "h2"), (5, 2, "resolved", "h2"), (5, 2, "resolved", "h2"), (6, 2, "unchecked", "h2"),
        (7, 2, "mismatch", None), (8, None, "missing", None), (9, None, "missing", None), (10, None, "missing", None), (12, None, "missing", None),
    ], key=repr)
    merged = resolve_revisits(records).where("record_id = 3").first()["headers"]
    assert merged == {"content-length": "9", "server": "new", "x": None}
    assert resolve_revisits(records.limit(0)).count() == 0
    keys = spark.createDataFrame([(u,) for u in (url, "", None, "http://WWW.x.org", "x.org/A?q")], "u string").select(canonical_url(F.col("u"))).collect()
    assert [r[0] for r in keys] == ["a.org/p?a=1&b=2", "", None, "x.org", "x.org/A?q"]


def test_a_hot_url_crosses_partitions(spark):
    records = spark.range(4000).selectExpr(
        "id AS record_id", "'http://hot.org/' AS url", "id AS ts", "IF(id % 1000 = 5, 'response', 'revisit') AS kind", "NULL AS etag",
        "NULL AS last_modified", "CAST(id AS STRING) AS digest", "map('a', 'b') AS headers",
    )
    rows = resolve_revisits(records, partitions=16).collect()
    assert len(rows) == 3996
    assert all(r["response_id"] == ((r["record_id"] - 6) // 1000 * 1000 + 5 if r["record_id"] > 5 else None) for r in rows)


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
                assert out.schema["text"].dataType == docs.schema["text"].dataType
            rows = out.collect()
            if docs is none:
                assert rows == []
            elif name == "near_dup":
                assert sorted(r["doc_id"] or -1 for r in rows) == [-1, -1, 1, 3, 4, 5, 6, 8, 9, 11]
            elif name == "language":
                assert {r["doc_id"] for r in rows} == {None, 1, 2, 6, 7, 8, 9, 10}
            elif name == "substrings":
                assert len(rows) == len(TEXTS) and {r["text"] for r in rows if r["doc_id"] in (3, 4, 5)} == {None, "", " \n\t "}
            elif name == "decontaminate":
                assert len(rows) == len(TEXTS)
