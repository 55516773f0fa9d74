"""op2: what it holds on disk goes when it is done with it, and passes over the postings give the same lines."""

from __future__ import annotations

import os
import time

import pytest

from tempograph.llm import base, linededup
from tests.llm.test_llm_small import brute_matches, docs_of, line_docs


def noted(monkeypatch):
    saved, save = [], base.Scratch.save

    def noting(self, df, name="t"):
        out = save(self, df, name)
        saved.append((name, out.tempograph_path.removeprefix("file:"), out.count(), out.columns))
        return out

    monkeypatch.setattr(base.Scratch, "save", noting)
    return saved


def test_only_the_removed_lines_stay_on_disk(spark, monkeypatch):
    """The pipeline's later stages ran beside all tables of this one (F1)."""
    saved = noted(monkeypatch)
    out = linededup.without_repeats(docs_of(spark, line_docs(11)))
    there = {name for name, path, *_ in saved if os.path.isdir("/" + path.lstrip("/"))}
    assert len(saved) > 5 and there == {"removed"}
    assert out.count() > 0


@pytest.mark.parametrize(("seed", "small", "hot", "broadcast"), [(12, 64, 10**6, 10**6), (13, 2, 10**6, -1), (14, 1, 2, -1)])
def test_passes_give_the_same_lines(spark, monkeypatch, seed, small, hot, broadcast):
    for name, value in (("SMALL", small), ("HOT", hot), ("PASS_MB", 1e-4), ("PASSES", 3), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(linededup, name, value)
    saved, rows = noted(monkeypatch), line_docs(seed)
    got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line) for r in linededup.removed_lines(docs_of(spark, rows)).collect()}
    assert got == brute_matches(rows)
    lists = [x for x in saved if x[0] == "lists"]
    assert len(lists) == 3 and sum(x[2] > 0 for x in lists) > 1
    assert ("firsts" in [x[0] for x in saved]) == (broadcast < 0)


def test_shuffle_files_go_with_the_query(spark):
    """Else a pass runs beside the files of the ones before; the session's own setting stays."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, was = blocks.getAllFiles().size(), spark.conf.get(base.CLEANUP)
    out = base.Scratch(spark, "t").save(spark.range(100_000).groupBy("id").count(), "t")
    end = time.time() + 10
    while blocks.getAllFiles().size() > before and time.time() < end:
        time.sleep(0.1)
    assert blocks.getAllFiles().size() <= before
    assert spark.conf.get(base.CLEANUP) == was
    assert out.count() == 100_000
