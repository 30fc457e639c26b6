"""The catalogue that persists: several writers, deletion and its recovery, old versions."""

import threading

import pytest

from framelake.sources import catalog, versions

SCHEMA = "job_id string, name string, size bigint, created bigint"


@pytest.fixture
def jobs(spark, tmp_path):
    return versions.Catalogue(spark, str(tmp_path / "catalogue"), SCHEMA)


def rows(spark, *ids, created=1):
    return spark.createDataFrame([(i, f"{i}.mp4", 10, created) for i in ids], SCHEMA)


def ids(jobs, **options):
    return sorted(r["job_id"] for r in jobs.read(**options).collect())


def test_upserts_replace_by_id_and_are_read_anew(spark, jobs):
    assert ids(jobs) == [] and jobs.newest() == 0
    jobs.upsert(rows(spark, "a", "b"))
    jobs.upsert(rows(spark, "b", "c", created=2))
    again = versions.Catalogue(spark, jobs.path, SCHEMA)
    assert ids(again) == ["a", "b", "c"] and {r["job_id"]: r["created"] for r in again.read().collect()} == {"a": 1, "b": 2, "c": 2}
    assert ids(again, version=1) == ["a", "b"]
    done = catalog.rebuild(again.read(), spark.createDataFrame([("a",), ("c",)], "job_id string"), spark.createDataFrame([("c",)], "job_id string"))
    assert [r["job_id"] for r in done.collect()] == ["a"]


def test_no_writer_loses_an_update(spark, jobs):
    failed = []

    def write(k):
        try:
            for n in range(3):
                versions.Catalogue(spark, jobs.path, SCHEMA).upsert(rows(spark, f"w{k}-{n}"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and ids(jobs) == sorted(f"w{k}-{n}" for k in range(4) for n in range(3)) and jobs.newest() == 12


def test_a_version_is_offered_once(spark, jobs):
    jobs.upsert(rows(spark, "a"))
    assert not jobs._offer(1, "data-other") and ids(jobs) == ["a"]


def files(tmp_path, job):
    return [str(tmp_path / f"{job}-{kind}") for kind in ("result", "checkpoint")]


def test_deleting_takes_files_and_row(spark, jobs, tmp_path):
    jobs.upsert(rows(spark, "a", "b", "c"))
    for f in files(tmp_path, "a"):
        open(f, "w").close()
    assert jobs.delete("a", files(tmp_path, "a")) and ids(jobs) == ["b", "c"]
    assert not any((tmp_path / f"a-{k}").exists() for k in ("result", "checkpoint"))
    assert not jobs.delete("b", files(tmp_path, "b")) and ids(jobs) == ["c"]  # it had no result
    before = jobs.newest()
    assert not jobs.delete("../c", []) and not jobs.delete("", []) and jobs.newest() == before


def test_a_deletion_that_was_cut_off_is_finished(spark, jobs, tmp_path, monkeypatch):
    jobs.upsert(rows(spark, "a", "b"))
    for f in files(tmp_path, "a"):
        open(f, "w").close()
    monkeypatch.setattr(versions.Catalogue, "_finish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        jobs.delete("a", files(tmp_path, "a"))
    monkeypatch.undo()
    assert ids(jobs) == ["b"] and (tmp_path / "a-result").exists()  # marked: no more listed
    assert jobs.recover(lambda j: files(tmp_path, j)) == ["a"] and not (tmp_path / "a-result").exists()
    assert jobs.recover(lambda j: files(tmp_path, j)) == [] and sorted(r["job_id"] for r in jobs.read(marked=True).collect()) == ["b"]


def test_old_versions_go(spark, jobs):
    for k in range(5):
        jobs.upsert(rows(spark, f"j{k}"))
    jobs.tidy(keep=2)
    assert ids(jobs) == [f"j{k}" for k in range(5)] and ids(jobs, version=4) == [f"j{k}" for k in range(4)]
    with pytest.raises(Exception):
        jobs.read(version=3).collect()
