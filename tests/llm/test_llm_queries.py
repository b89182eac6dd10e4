"""The text queries: against SQL where it can express them, else against brute force or held-out labels."""

import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from brute import components, kept_words  # noqa: E402
from oracle import compare  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SQL = sorted(name for name in ORACLES if name.startswith("op"))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES if name.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in QUERIES


@pytest.mark.parametrize("name", SQL)
def test_matches_sql(spark, duck, sf_dir, name):
    got, want, _ = compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert got == want


def test_near_duplicates_match_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    want = components(docs, 4)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in QUERIES["op8_minhash_near_dup"](spark, sf_dir).collect()}
    assert got == want
    assert len({c for c, _ in want.values()}) < len(want)


def test_packing_holds_every_word_once(spark, sf_dir):
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in table(spark, sf_dir, "documents").collect()}
    seen: dict = {}
    for r in QUERIES["op3_best_fit_packing"](spark, sf_dir).collect():
        assert r["used"] == sum(p["length"] for p in r["pieces"]) <= r["capacity"]
        assert all(c < r["used"] for c in (512, 1024, 2048, 4096) if c < r["capacity"])
        for p in r["pieces"]:
            seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for doc, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == words[doc]
    assert set(seen) == {d for d, n in words.items() if n}


def test_extraction_keeps_articles_only(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    rows = QUERIES["op5_html_extraction"](spark, sf_dir).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "<" not in r["text"].replace("&lt;", "") and "track(" not in r["text"] and "©" not in r["text"]
        assert r["text"].count("\n\n") + 1 >= pages[r["page_id"]].count("</p>") - 1


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables hold nine toxic learning rows
    words = set("idiot moron scum loser trash worthless disgusting clown stupid pathetic".split())
    docs = {r["doc_id"]: set((r["text"] or "").lower().split()) for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op6_pu_toxicity"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    hit = [r["predicted"] for r in rows if len(docs[r["doc_id"]] & words) >= 2]
    clean = [r["predicted"] for r in rows if not docs[r["doc_id"]] & words]
    assert sum(hit) >= 0.9 * len(hit) and sum(clean) <= 0.02 * len(clean)


def test_language_on_held_out_rows(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, sf_dir).collect() if r["held_out"]]
    assert {r["doc_id"] for r in rows} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.93 * len(rows)


def test_pipeline_stages_match_brute_force(spark, sf_dir):
    import corpus_pipeline
    from onefold.session import stage

    docs = table(spark, sf_dir, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    out = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        out[name] = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(out[name])
    assert len(out["language"]) >= 0.98 * len(before)
    groups = components({d: r["text"] for d, r in out["language"].items()}, 5)
    assert set(out["near_dup"]) == {d for d, (c, _) in groups.items() if d == c}
    texts = {d: r["text"] for d, r in out["near_dup"].items()}
    want = kept_words(texts, 13)
    assert {d: r["text"].split() for d, r in out["substrings"].items()} == want
    assert all(r["text"] == texts[d] for d, r in out["substrings"].items() if texts[d].split() == want[d])
    assert all(r["n_chars"] == len(r["text"]) for r in out["substrings"].values())

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    items = [shingles(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    leaked = {d for d, r in out["substrings"].items() if any(100 * len(i & shingles(r["text"])) >= 80 * len(i) for i in items)}
    assert leaked and set(out["decontaminate"]) == set(out["substrings"]) - leaked
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r["used"] for r in packed) == sum(len(r["text"].split()) for r in out["decontaminate"].values())
