import json

import pytest

from tracebraid.sources import cases as c, shards


def case(name):
    return {"case_id": name, "symptom_nodes": ["a"], "known_edges": [["a", "r", "b"]], "evidence": [], "metadata": {"n": name}}


def made(spark, tmp_path, *names):
    path = tmp_path / f"in-{'-'.join(names)}.jsonl"
    path.write_text("\n".join(json.dumps(case(n)) for n in names))
    return c.read_cases(spark, str(path))


def test_shards_are_merged_in_order(spark, tmp_path):
    d = tmp_path / "x y"
    assert shards.write_shard(made(spark, tmp_path, "k3", "k1"), f"{d}/shard-b")["n_cases"] == 2
    shards.write_shard(made(spark, tmp_path, "k2"), f"{d}/shard-a")
    stats = shards.merge_case_shards(spark, f"{d}/shard-*", f"{tmp_path}/all", manifest_total=7)
    assert stats["shard_counts"] == {"shard-a": 1, "shard-b": 2} and stats["n_shards"] == 2
    assert (stats["manifest_total_rows"], stats["normalized_adapter_valid_cases"]) == (7, 3)
    assert json.loads((tmp_path / "all.meta.json").read_text()) == stats
    lines = [json.loads(x)["case_id"] for p in sorted((tmp_path / "all").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["k1", "k2", "k3"]
    assert c.read_cases(spark, f"{tmp_path}/all").edges.count() == 3
    # A merged file is a shard itself.
    assert shards.merge_case_shards(spark, f"{tmp_path}/all", f"{tmp_path}/again")["normalized_adapter_valid_cases"] == 3


def test_unfinished_and_changed_shards_are_refused(spark, tmp_path):
    shards.write_shard(made(spark, tmp_path, "k1"), f"{tmp_path}/s1")
    with pytest.raises(FileExistsError):
        shards.write_shard(made(spark, tmp_path, "k2"), f"{tmp_path}/s1")
    (tmp_path / "s2").write_text(json.dumps(case("k2")) + "\n\n")
    with pytest.raises(ValueError, match="s2 is not finished"):
        shards.merge_case_shards(spark, f"{tmp_path}/s[12]", f"{tmp_path}/out")
    assert shards.merge_case_shards(spark, f"{tmp_path}/s[12]", f"{tmp_path}/out", finished_only=False)["shard_counts"] == {"s1": 1, "s2": 1}
    (tmp_path / "s2.meta.json").write_text('{"n_cases": 3}')
    with pytest.raises(ValueError, match="s2 has 1 cases, its meta says 3"):
        shards.merge_case_shards(spark, f"{tmp_path}/s[12]", f"{tmp_path}/out")
    with pytest.raises(FileNotFoundError):
        shards.merge_case_shards(spark, f"{tmp_path}/none-*", f"{tmp_path}/out")


def test_cases_that_come_twice_are_refused(spark, tmp_path):
    for name in ("s1", "s2"):
        shards.write_shard(made(spark, tmp_path, "k1"), f"{tmp_path}/{name}")
    with pytest.raises(ValueError, match="k1"):
        shards.merge_case_shards(spark, f"{tmp_path}/s[12]", f"{tmp_path}/out")
    # A shard whose write was broken off has no meta and can be written again.
    twice = made(spark, tmp_path, "k5", "k5")
    with pytest.raises(ValueError, match="k5"):
        shards.write_shard(twice, f"{tmp_path}/s3")
    assert shards.read_meta(spark, f"{tmp_path}/s3") is None
    assert shards.write_shard(made(spark, tmp_path, "k5"), f"{tmp_path}/s3")["n_cases"] == 1
