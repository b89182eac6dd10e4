"""Merkle manifest against a plain Python tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from onefold.llm.manifest import merkle_manifest

ROWS = [
    (5, "a", "en", 3, "x\ny"), (1, "a", None, None, "one"), (1, "a", None, None, "one"), (1, "a", "de", 2, "other"), (None, "a", "en", 1, None),
    (7, None, "en", 1, "no source\n"), (2, None, None, None, None), (3, "", "fr", 0, ""), (4, "é", "fr", 5, "é\n\n"), (6, "z", "en", 9, "line\n" * 4000),
] + [(100 + i, "hot", "en", i, f"text {i}\n" * (i % 3)) for i in range(40)]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos string, digest string, rank int, total int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(digests, fanout):
    """Root, and per digest the siblings left and right of it on each level."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, at in enumerate(places):
            lo = at - at % fanout
            paths[i].append(("".join(level[lo:at]), "".join(level[at + 1:lo + fanout])))
            places[i] = at // fanout
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in order}
    root, above = climb([trees[s][0] for s in order], fanout)
    out = []
    for s, upper in zip(order, above, strict=True):
        for (_, _, own, r), lower in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            half = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if r[4] is not None and half else r[4])
            for a, b in lower + upper:
                node = sha(a + node + b)
            out.append((r[0], own, trees[s][0], root, sha("".join(a + b for a, b in lower + upper)), node, node == root, s, len(out)))
    return out


def made(frame, **kw):
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle_manifest(frame, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=half, **kw)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "p", "d", 2, 3) for r in ROWS], SCHEMA).repartition(5)


@pytest.mark.parametrize(("fanout", "pack"), [(3, 2187), (3, 3), (2, 4), (5, 25)])
def test_matches_a_plain_tree(frame, fanout, pack):
    got = sorted((tuple(r) for r in made(frame, fanout=fanout, pack_leaves=pack).leaves.collect()), key=lambda r: r[-1])
    want = brute(ROWS, fanout)
    assert got == want
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_nodes_cover_nested_intervals(frame):
    m = made(frame, fanout=3, pack_leaves=9)
    nodes = m.nodes.collect()
    hot = [n for n in nodes if n["source"] == "hot"]
    by_level = {}
    for n in hot:
        by_level.setdefault(n["level"], []).append(n)
    assert {k: len(v) for k, v in by_level.items()} == {0: 40, 1: 14, 2: 5, 3: 2, 4: 1}
    for level in range(1, 5):
        for n in by_level[level]:
            inside = sorted((c for c in by_level[level - 1] if n["lo"] <= c["lo"] and c["hi"] <= n["hi"]), key=lambda c: c["lo"])
            assert sha("".join(c["digest"] for c in inside)) == n["digest"]
            assert [inside[0]["lo"], inside[-1]["hi"]] == [n["lo"], n["hi"]]
    top = max((n for n in nodes if n["of_groups"]), key=lambda n: n["level"])
    assert (top["lo"], top["hi"]) == (0, len(ROWS)) and top["digest"] == m.leaves.first()["root"]


def test_one_row_and_none(spark, frame):
    one = frame.where("doc_id = 4")
    got = made(one).leaves.first()
    row = next(r for r in ROWS if r[0] == 4)
    assert got["leaf"] == got["subroot"] == got["root"] == leaf(row, row[4]) and got["proof_sha256"] == sha("")
    empty = made(spark.createDataFrame([], SCHEMA))
    assert empty.leaves.count() == 0 and empty.nodes.count() == 0
    with pytest.raises(ValueError, match="two children"):
        merkle_manifest(frame, fanout=1)
