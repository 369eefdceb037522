"""Logs as a data source of their own, and claims on a catalogue."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from vaneflow.operators import catalog
from vaneflow.sources import ulog

from .test_checks import build_ulog


@pytest.fixture
def logs(tmp_path):
    data = build_ulog()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.ulg").write_bytes(data)
    (tmp_path / "sub" / "b.ulg").write_bytes(data[:-2])
    (tmp_path / "c.ulg").write_bytes(b"junk")
    (tmp_path / "d.ulg").write_bytes(data[:40])
    (tmp_path / "e.ulg").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no log")
    return f"file://{tmp_path}"


def test_the_format_gives_what_whole_files_give(spark, logs):
    ulog.register(spark)
    columns = [c.split()[0] for c in ulog.SCHEMA.split(", ")][1:]
    name = F.regexp_extract("log_id", r"(\w)\.ulg$", 1).alias("log")
    new = spark.read.format("ulog").load(logs)
    assert new.rdd.getNumPartitions() == 5  # one a file
    old = ulog.read_ulogs(spark, f"{logs}/*.ulg").unionByName(ulog.read_ulogs(spark, f"{logs}/sub"))
    rows = lambda df: sorted(map(repr, df.select(name, *columns).collect()))
    assert rows(new.filter("log_id not like '%e.ulg'")) == rows(old) and new.count() > 20  # Spark passes over files without a byte
    assert {r.log: r.v_str for r in new.filter("kind = 'error'").select(name, "v_str").collect()} == {"b": "cut off", "c": "not a ULog file", "d": "cut off", "e": "not a ULog file"}
    assert spark.read.format("ulog").load(f"{logs}/a.ulg").filter("kind = 'sample'").count() == 10


def test_topics_and_kinds_go_into_the_scan(spark, logs):
    ulog.register(spark)
    df = spark.read.format("ulog").load(logs).filter("topic in ('att', 'none') and kind = 'sample' and v > 1.5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = "".join(line for line in plan.splitlines() if "Filter" in line and "Scan" not in line)
    assert "kind" not in kept and "none" not in kept and "> 1.5" in kept  # the scan alone decides on topics and kinds
    assert df.filter("log_id like '%/a.ulg'").count() == 6
    reader = ulog.ULogReader(logs)
    left = list(reader.pushFilters([ulog.EqualTo(("topic",), "x"), ulog.In(("topic",), ("x", "y")), ulog.EqualTo(("v",), 1.0)]))
    assert reader.topics == {"x"} and left == [ulog.EqualTo(("v",), 1.0)]


def test_one_of_two_claims_wins(spark, tmp_path):
    folder, won, lost = f"file://{tmp_path}/shared", [], []
    start = threading.Barrier(6)

    def claim(n):
        start.wait()
        try:
            won.append((n, catalog.claim_source(spark, folder, "review", {"db": f"/db{n % 3}", "log_dir": "/logs"})))
        except catalog.ClaimedBefore:
            lost.append(n)

    threads = [threading.Thread(target=claim, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(first for _, first in won) == 1  # one call bound it; the other of its source found it bound
    assert len({n % 3 for n, _ in won}) == 1 and len(won) == 2 and len(lost) == 4
    assert not list((tmp_path / "shared").glob("*.tmp"))


def test_claims_meet_older_rows(spark, tmp_path):
    rows = spark.createDataFrame([("/logs/a.ulg",), ("/other/b.ulg",)], "log_path string")
    source = {"db": "/db", "log_dir": "/logs/"}
    with pytest.raises(catalog.ClaimedBefore):
        catalog.claim_source(spark, f"file://{tmp_path}", "review", source, rows)
    assert catalog.claim_source(spark, f"file://{tmp_path}", "review", source, rows.limit(1)) is True
    assert catalog.claim_source(spark, f"file://{tmp_path}", "review", source, rows) is False
    assert catalog.claim_source(spark, f"file://{tmp_path}", "uploads", {"db": "/x"}) is True


@pytest.mark.parametrize("sent", [10_000, 0])
def test_a_tag_of_all_logs_is_not_one_task(spark, monkeypatch, sent):
    """Links aren't shuffled by tag alone, whether tags are sent or spread; results are those of a plain loop."""
    monkeypatch.setattr(catalog, "TAGS_SENT", sent, raising=False)
    names = {1: "All", 2: "Even", 3: "even", 4: "Third", 5: "unused"}
    of = {i: {1} | ({2 + i % 4 // 2} if i % 2 == 0 else set()) | ({4} if i % 3 == 0 else set()) for i in range(60)}
    logs = spark.createDataFrame([(i, i % 5 != 0) for i in of], "id long, source_available boolean")
    link = spark.createDataFrame([(i, t) for i, own in of.items() for t in own] + [(99, 1), (None, 1), (1, None)], "log_id long, tag_id int")
    tags = spark.createDataFrame(list(names.items()), "id int, name string")
    both, listed, counts = catalog.having_all(logs, link, tags, ["EVEN", "third"]), catalog.with_tags(logs, link, tags), catalog.tag_counts(tags, link, logs)
    assert sorted(r.id for r in both.collect()) == [i for i in of if i % 6 == 0]
    assert {r.id: r.tags for r in listed.collect()} == {i: sorted((names[t] for t in own), key=str.lower) for i, own in of.items()}
    assert {r.name: r.n_logs for r in counts.collect()} == {name: sum(t in own and i % 5 != 0 for i, own in of.items()) for t, name in names.items()}
    for df in (both, listed):
        assert not re.search(r"hashpartitioning\(tag_id#\w+, \d", df._jdf.queryExecution().executedPlan().toString())
