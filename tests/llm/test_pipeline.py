"""The stages over a small corpus with planted cases, held against brute force."""

import pytest

import corpus_pipeline as C
from rasterlab.llm import queries

from .conftest import Prose
from .test_documents import check_pieces, near_by_force, shingles


#: A clean text without an id, and two of one id.
NO_ID = " ".join(f"lonely{i}" for i in range(50))
TWICE = [" ".join(f"{x}{i}" for i in range(50)) for x in ("first", "second")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    p = Prose(21)
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(400):
        w = p.words(p.random.randrange(60, 120))
        if i % 8 == 0:
            for _ in range(4):
                w.insert(p.random.randrange(len(w)), "moron")
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, "\n".join(" ".join(w[k : k + 10]) for k in range(0, len(w), 10))))
    passage, item = p.text(70, 10), " ".join(p.words(30))
    clean = [i for i in range(400) if i % 8]
    texts = dict(rows)
    for i in clean[10:20]:
        texts[i] += "\n" + passage
    for i in clean[30:33]:
        texts[i] += "\n" + item
    copies = {1000 + k: " ".join([*texts[clean[50]].split(), f"tail{k}"]) for k in range(5)}  # one line each: line dedup leaves them
    texts |= copies | {2000: texts[clean[60]], 2001: None, 2002: ""}
    extra = [(None, " ".join(p.words(40)) + " " + item), (None, NO_ID), (3000, TWICE[0]), (3000, TWICE[1]), (3000, TWICE[1])]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in [*texts.items(), *extra]], ", ".join(("doc_id long", "text string", "lang string", "source string", "n_chars long"))).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage, item, clean, copies


def test_stages(spark, corpus):
    folder, texts, passage, item, clean, copies = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        extra = sorted((r.doc_id is None, r.text) for r in seen[name] if name != "packing" and r.doc_id in (None, 3000))
        if name in ("near_dedup", "decontamination"):  # rows without an id are judged by their texts, as are texts of one id
            assert [t for _, t in extra] == sorted(TWICE) + [NO_ID] + ([] if name == "decontamination" else [extra[-1][1]])
        if name != "packing":
            assert tuple(docs.columns) == C.COLUMNS
    after = {n: {r.doc_id: r.text for r in rows if r.doc_id not in (None, 3000)} for n, rows in seen.items() if n != "packing"}
    toxic = {i for i in range(400) if i % 8 == 0}
    assert len(toxic & after["toxicity"].keys()) <= 1 and set(texts) - toxic == after["toxicity"].keys() - toxic
    holders = [i for i, t in after["line_dedup"].items() if any(x in (t or "") for x in passage.split("\n"))]
    assert holders == [clean[10]] and 2000 not in after["line_dedup"]
    assert all(after["line_dedup"][i] == texts[i] for i in clean if i not in clean[10:20] and i in after["line_dedup"])
    groups = near_by_force(list(after["line_dedup"].items()))
    assert after["near_dedup"].keys() == {i for i, c in groups.items() if i == c}
    assert len(copies.keys() & after["near_dedup"].keys()) == 0 and clean[50] in after["near_dedup"]
    wanted = {i for i, t in after["near_dedup"].items() if 100 * len(shingles(item) & shingles(t)) < 75 * len(shingles(item))}
    assert after["decontamination"].keys() == wanted and len(after["near_dedup"]) - len(wanted) == 3
    check_pieces(seen["packing"], [*after["decontamination"].values(), *TWICE, NO_ID])
    assert {r.doc_id for r in seen["packing"]} == after["decontamination"].keys() | {None, 3000}


def test_run_and_queries(spark, corpus):
    assert C.run(spark, corpus[0]).columns[:3] == ["doc_id", "start", "length"]
    assert {n.split("_")[0] for n in queries.QUERIES if n != "pipeline"} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in queries.QUERIES and C.ORACLE_SQL is None


def test_stages_on_nothing(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0
