"""A store built in increments against the store of one build."""

import pytest
from pyspark.sql import functions as F

import gridweave as gw
from gridweave.plans import increments


def record(name: str) -> str:
    return (
        f'id: "{name}" table {{ columns {{ text: "c" }} rows {{ cells {{ text: "{name}" }} }} }} '
        f'questions {{ original_text: "what is {name}?" }}'
    )


def put(folder, name: str, count: int) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(record(f"{name}/{i}") + "\n" for i in range(count)))


def rows(graph) -> list[list]:
    return [sorted(tuple(r) for r in part.collect()) for part in graph]


def one_build(spark, records, out) -> list[list]:
    gw.build_stores(spark, str(records), str(out))
    return rows(gw.read_graph(spark, str(out)))


def test_increments_give_the_store_of_one_build(spark, tmp_path):
    records, store = tmp_path / "records", str(tmp_path / "store")
    put(records, "a.txt", 7)
    put(records, "b [1] é.txt", 5)
    assert gw.append_records(spark, str(records), store) == 12
    assert gw.append_records(spark, str(records), store) == 0
    put(records, "c.txt", 4)
    (records / "d.txt").write_text("table { " + "columns { } " * 60 + "rows { } " * 60 + "}\n")  # too large
    (records / "e.txt").write_text("")  # read once it has lines
    assert gw.append_records(spark, str(records), store) == 4
    assert gw.append_records(spark, str(records), store) == 0
    assert rows(gw.read_increments(spark, store)) == one_build(spark, records, tmp_path / "whole")
    assert gw.read_graph_count(spark, store).first().num == 16
    texts = sorted(r.text for r in gw.read_increments_corpus(spark, store).collect())
    assert texts == sorted(r.text for r in gw.read_corpus(spark, str(tmp_path / "whole" / "text")).collect())
    ledger = gw.read_ledger(spark, store)
    firsts = {r.file_path.rsplit("/", 1)[1][0]: (r.increment, r.first_gid, r.tables) for r in ledger.collect()}
    assert firsts == {"a": (0, 0, 7), "b": (0, 7, 5), "c": (1, 12, 4), "d": (1, None, 0)}


def test_an_attempt_that_ended_early_leaves_no_graphs(spark, tmp_path, monkeypatch):
    records, store = tmp_path / "records", str(tmp_path / "store")
    put(records, "a.txt", 3)
    gw.append_records(spark, str(records), store)
    put(records, "b.txt", 2)

    def lost(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as broken:
        broken.setattr(increments, "_commit", lost)
        with pytest.raises(OSError):
            gw.append_records(spark, str(records), store)
    assert gw.read_increments(spark, store).nodes.select("gid").distinct().count() == 3
    assert gw.append_records(spark, str(records), store) == 2
    assert rows(gw.read_increments(spark, store)) == one_build(spark, records, tmp_path / "whole")


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    records, store = tmp_path / "records", str(tmp_path / "store")
    put(records, "a.txt", 3)
    commit = increments._commit

    def overtaken(*where):
        monkeypatch.setattr(increments, "_commit", commit)
        assert gw.append_records(spark, str(records), store) == 3
        commit(*where)

    monkeypatch.setattr(increments, "_commit", overtaken)
    with pytest.raises(Exception, match="(?i)exist"):
        gw.append_records(spark, str(records), store)
    assert gw.read_increments(spark, store).nodes.select("gid").distinct().count() == 3


def test_a_changed_file_is_an_error(spark, tmp_path):
    records, store = tmp_path / "records", str(tmp_path / "store")
    put(records, "a.txt", 3)
    gw.append_records(spark, str(records), store)
    put(records, "a.txt", 4)
    with pytest.raises(ValueError, match="a.txt"):
        gw.append_records(spark, str(records), store)


def test_only_new_files_are_read(spark, tmp_path):
    records = tmp_path / "records"
    for name in "abcd":
        put(records, f"{name}.txt", 3)
    lines = gw.read_lines(spark, str(records))
    last = max(r.file_path for r in lines.select("file_path").distinct().collect())
    found = lines.where(F.col("file_path").isin([last]))
    assert found.count() == 3
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().totalNumberOfFiles() == 1


def test_a_store_without_increments(spark, tmp_path):
    (tmp_path / "records").mkdir()
    store = str(tmp_path / "store")
    assert gw.append_records(spark, str(tmp_path / "records"), store) == 0
    assert gw.read_increments(spark, store).edges.count() == 0
    assert gw.read_graph_count(spark, store).first().num == 0


def test_lines_of_increments_are_packed(spark):
    """The record lines are the largest thing the increments store."""
    from pathlib import Path

    from workload import catalog

    store = Path(catalog._in_increments(spark, "/root/testdata/sf0.001"))
    lines = [p for p in store.parent.glob("record-lines-*/day=*/part-*") if p.stat().st_mtime >= store.stat().st_ctime - 600]
    assert lines and all(p.name.endswith(".txt.gz") for p in lines[-2:])
    assert all(".zstd." in p.name for p in store.rglob("part-*.parquet"))
