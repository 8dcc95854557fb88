"""The pipeline stage by stage against brute force, and as a whole."""

import re

import pytest

import corpus_pipeline as cp
from framegraph.llm.common import drop_scratch, materialize
from framegraph.llm.decontamination import drop_contaminated
from framegraph.llm.near_dedup import drop_near_copies

from .test_contracts import ALNUM, LOW, brute_classes, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [ALNUM.findall(r["text"].translate(LOW)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(b[k : k + 10]) for b in bench for k in range(max(1, len(b) - 9))}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            assert len(gone & toxic) > 0.6 * len(toxic) and len(gone - toxic) < 0.1 * len(before)
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[t.translate(LOW)] = max(i, best.get(t.translate(LOW), -1))
            assert set(after) == set(best.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, c in brute_classes(before.items()).items() if i == c}
        else:
            hit = lambda t: (w := ALNUM.findall(t.translate(LOW))) and any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
            assert set(after) == {i for i, t in before.items() if not hit(t)}
        before = after
    used, least = check_packing(cp.STAGES[-1][1](spark, docs, SF).collect(), before.items(), 2048)
    assert used <= least + 1


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    drop_scratch()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(cp.__file__).parent / "framegraph"
    for f in root.rglob("*.py"):
        if root / "llm" not in f.parents:
            assert not re.search(r"(import|from)\s.*\bllm\b", f.read_text()), f


@pytest.mark.parametrize("empty", ["documents"])
def test_stages_on_nothing(spark, empty):
    docs = spark.read.parquet(f"{SF}/{empty}.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_stages_tell_rows_apart_by_more_than_doc_id(spark):
    """Different texts under one doc_id or without one stay; their links and hits are their own."""
    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    near = lambda name: text(name) + " end"
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")), (8, near("e")), (9, near("a"))]
    rows += [(5, text("f")), (5, near("f")), (6, text("f")), (4, "!"), (4, "?"), (3, text("g")), (3, text("g"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in drop_near_copies(docs).collect()), key=str)
    fives = [x for x in kept if x[0] == 5]
    assert len(fives) == 1 and fives[0] in rows
    assert [x for x in kept if x[0] != 5] == sorted([*rows[:5], (4, "!"), (4, "?"), (3, text("g"))], key=str)

    bench = spark.createDataFrame([(1, text("b", 12)), (2, text("e", 12))], "item_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in drop_contaminated(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1][0] not in "be"], key=str)
