"""The pipeline's stages against their decisions on the smallest tables."""

import collections
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from plansheet.llm._common import materialize

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF), name)
    return out


def test_columns_and_subsets(stages):
    names = ["input", "toxicity", "near_duplicates"]
    rows = {n: {tuple(r) for r in stages[n].collect()} for n in names}
    assert rows["near_duplicates"] <= rows["toxicity"] <= rows["input"]
    assert all(stages[n].columns == stages["input"].columns for n in stages if n != "packing")


def test_one_of_each_class_stays(stages):
    from plansheet.llm.simhash import classes

    before = classes(stages["toxicity"]).collect()
    assert sorted({r["component_id"] for r in before}) == sorted(r["doc_id"] for r in stages["near_duplicates"].collect())
    after = classes(stages["near_duplicates"]).collect()
    assert len({r["component_id"] for r in after}) == len(after)


def test_secrets_are_masked(stages):
    from plansheet.llm.secrets import scanned

    assert stages["secret_masking"].count() == stages["near_duplicates"].count()
    left = scanned(stages["secret_masking"], ("doc_id",)).where("size(s_access) + size(s_hex) > 0")
    assert left.count() == 0


def test_mix_and_packing(stages):
    size, taken = collections.Counter(), collections.Counter()
    for r in stages["secret_masking"].collect():
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in stages["source_mixing"].collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * size[s] for s in size)
    packed = stages["packing"].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in packed) <= 4096
    assert stages["packing"].where("piece = 0").count() == stages["source_mixing"].count()


def test_whole_run(spark, stages):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() == stages["packing"].count()


HARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, src int, slot string"


def hard_rows():
    long = " ".join(f"word{i % 97} is{i}" for i in range(6000))
    rows = [(1, long, "en", "a", len(long), 1, "s"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "s"), (4, " \n\t", "en", None, 3, 1, "s")]
    rows += [(5, "a text of the one id", "en", "b", 20, 1, "s"), (5, "another text altogether under that id, and longer", "en", "b", 49, 1, "s"), (None, "no id at all here but some words", "en", "b", 31, 1, "s")]
    return rows + [rows[0], rows[4], rows[1]] + [(10 + i, f"some plain sentence number {i} with {i * i} things in it", "de", ["a", "b", "Z"][i % 3], 40, 1, "s") for i in range(30)]


@pytest.mark.parametrize("rows", [hard_rows(), []], ids=["nulls, repeats, long and empty texts", "empty table"])
def test_stages_on_hard_rows(spark, rows):
    import corpus_pipeline
    from plansheet.llm._common import materialize

    docs = spark.createDataFrame(rows, HARD)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in HARD.split(", ")]
    kept = [(r["doc_id"], r["text"]) for r in seen["near_duplicates"].collect()]
    assert len(kept) == len(set(kept))
    if rows:
        assert seen["toxicity"].count() == len(rows)  # nothing toxic here
        assert {(5, "a text of the one id"), (5, "another text altogether under that id, and longer"), (None, "no id at all here but some words")} <= set(kept)
        assert sum(t is None or not t.strip() for _, t in kept) == 1  # all without words are one class
    assert seen["packing"].where("piece = 0").count() == seen["source_mixing"].count()
