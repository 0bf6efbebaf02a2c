"""Every query and every pipeline stage on awkward and on empty tables."""

import hashlib
import zlib

import pytest
from cases import DOCUMENTS, VECTORS, awkward, empty  # noqa: F401 - fixtures

from concentra.llm.queries import QUERIES

NAMES = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))


def rows(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert rows(spark, name, empty) == []


def by_id(found):
    out = {}
    for r in found:
        out.setdefault(r.get("doc_id", r.get("page_id")), []).append(r)
    return out


def whole(found):
    """One row for each document, also repeated ones and those without id."""
    assert len(found) == len(DOCUMENTS)
    return by_id(found)


def test_op1(spark, awkward):
    found = rows(spark, "op1_decontamination", awkward)
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(10, 1), (10, 4)]
    assert all(r["coverage"] == 1.0 and r["n_tiles"] == 1 for r in found)


def test_op2(spark, awkward):
    found = whole(rows(spark, "op2_substring_dedup", awkward))
    empty = hashlib.sha256(b"").hexdigest()
    for i in (5, 6, 7):
        assert (found[i][0]["n_words"], found[i][0]["n_removed"], found[i][0]["kept_sha256"]) == (0, 0, empty)
    assert found[2][0]["n_removed"] == found[3][0]["n_removed"] == 60  # -5 has the passage too
    assert found[-5][0]["n_removed"] == 0
    assert found[3][0]["kept_sha256"] == empty
    assert [r["n_removed"] for r in found[8]] == [0, 0]
    assert sorted(r["n_words"] for r in found[None]) == [0, 40]
    assert 0 < found[4][0]["n_removed"] < 60


def test_op3(spark, awkward):
    found = by_id(rows(spark, "op3_source_mixing", awkward))
    assert set(found) == {d[0] for d in DOCUMENTS}
    assert len([r for r in found[8] if r["mix_epoch"] == 0]) == 2
    assert len([r for r in found[None] if r["mix_epoch"] == 0]) == 2


def test_op4(spark, awkward):
    found = by_id(rows(spark, "op4_html_extraction", awkward))
    assert len(found[1]) == 2 and found[1][0]["text"].startswith("T & t\n\n") and found[1][0]["text"].endswith("\n\nSecond, one.")
    assert [found[i][0]["text"] for i in (2, 3, 4)] == ["", "", "deep"]
    assert found[None][0]["text"] == "a\n\nb c" and found[None][0]["n_chars"] == 6


def test_op5(spark, awkward):
    found = whole(rows(spark, "op5_quality", awkward))
    for rs in found.values():
        for r in rs:
            assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) or r["doc_id"] is None
    assert found[5][0]["score"] == found[6][0]["score"]
    assert found[8][0] == found[8][1]


def test_op6(spark, awkward):
    found = whole(rows(spark, "op6_secret_scan", awkward))
    text = DOCUMENTS[16][1]
    assign, access = text.index("token"), text.index("AKIA")
    link, hexa = text.index("https"), text.index("0123")
    base = f"assign:{assign}:{assign + 21},access:{access}:{access + 20},hex:{hexa}:{hexa + 32}"
    r = found[14][0]
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["n_endpoint"]) == (1, 1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert r["spans"] == f"assign:{assign}:{assign + 21},access:{access}:{access + 20},endpoint:{link}:{link + 22},hex:{hexa}:{hexa + 32}"
    assert found[5][0]["spans"] == "" and found[5][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_op7(spark, awkward):
    found = whole(rows(spark, "op7_fingerprint", awkward))
    assert found[2][0]["fingerprint"] == found[3][0]["fingerprint"]
    assert found[2][0]["near_next"] == 1.0
    assert found[5][0]["fingerprint"] == "" and found[5][0]["near_edited"] == 1.0
    assert found[14][0]["edited_sha256"] and found[3][0]["near_next"] > 0.6
    ids = sorted(x[0] for x in DOCUMENTS if x[0] is not None)
    assert ids[-1] == 14  # followed by the first row, one without id: null or prose
    long = [d for d in DOCUMENTS if d[0] == 12][0][1]
    after = [d for d in DOCUMENTS if d[0] == 13][0][1]
    edited = long[: len(long) - len(long) // 2] + after[: len(long) // 2]
    assert found[12][0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_op8(spark, awkward):
    found = whole(rows(spark, "op8_jaccard_join", awkward))
    assert found[3][0]["component_id"] == found[2][0]["component_id"] == found[-5][0]["component_id"] == -5
    assert found[4][0]["component_id"] in (-5, 4)
    assert [found[i][0]["component_id"] for i in (1, 5, 6, 7, 9, 12, 13)] == [1, 5, 6, 7, 9, 12, 13]
    assert [r["component_id"] for r in found[8]] == [8, 8] and found[8][0]["n_shingles"] == 1
    assert [found[i][0]["n_shingles"] for i in (5, 6, 7)] == [0, 0, 0]
    assert [r["component_id"] for r in found[None]] == [None, None]


def test_op9(spark, awkward):
    found = whole(rows(spark, "op9_language_id", awkward))
    assert [found[i][0]["lang_pred"] for i in (5, 6, 7, 9)] == ["und"] * 4
    assert found[5][0]["score"] == 0.0
    assert found[1][0]["lang_pred"] == "en" and found[8][0] == found[8][1]


def test_op10(spark, awkward):
    found = rows(spark, "op10_token_output", awkward)
    assert len(found) == len(DOCUMENTS)
    found = sorted(found, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids[:3] == [None, None, -5] and ids[2:] == sorted(ids[2:])
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:i]) for i in range(len(found))]
    empty = [r for r in found if r["doc_id"] in (5, 6)]
    assert all(r["n_tokens"] == 1 and r["ids_crc32"] == zlib.crc32(b"\0\0\0\0") for r in empty)


def test_op11(spark, awkward):
    from brute import filter_audit

    found = rows(spark, "op11_filter_audit", awkward)
    docs = [(d[0], d[1], d[3]) for d in DOCUMENTS]
    labels = [(i, int(i % 2), 0) for i in range(1, 15)] + [(2, None, None), (None, 1, 0), (3, 1, 1), (77, 0, 0)]
    keys = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[k] for k in keys) for r in found) == filter_audit(docs, labels)
    assert len(found) == 600 * len({d[3] or "" for d in DOCUMENTS})


def test_op12(spark, awkward):
    from brute import neighbours

    found = rows(spark, "op12_nearest_neighbours", awkward)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == neighbours(VECTORS, lambda i: i % 20 == 0, 20)
    assert {r["vec_id"] for r in found if r["query_id"] == 320} == {321}
    assert not {r["query_id"] for r in found} & {200, 220, 240, 260, 280, 300, 340, None}


def test_op13(spark, awkward):
    from brute import clusters

    found = rows(spark, "op13_centroid_clustering", awkward)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found), key=str)
    assert got == sorted(clusters(VECTORS), key=str)
    assert sum(r["vec_id"] is None for r in found) == 1


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_pipeline(spark, tmp_path, request, kind):
    import corpus_pipeline

    folder = request.getfixturevalue(kind)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "token_output":
            assert docs.columns == columns
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            if kind == "awkward":
                # language ID drops what has no letters; then copies, then the leak
                assert not kept & {5, 6, 7, 9} and {1, 8, 12} <= kept
                assert (2 in kept) == (3 in kept) == (name == "language_id")
                assert (10 in kept) == (name in ("language_id", "near_duplicates"))
    assert docs.count() > 0 if kind == "awkward" else docs.count() == 0
