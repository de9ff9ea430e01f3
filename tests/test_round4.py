"""What round 4 found."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tessarine.operators import evaluation
from tessarine.sources import files as src


def test_target_overlap_holds_the_rows_of_one_id_at_a_time(spark):
    """the two explodes are no one piece of generated code, which would keep all rows of two blocks in memory."""
    rows = spark.range(60).select("id", F.lit("holdout").alias("set"), F.lit("p").alias("path"), F.lit("s").alias("symbol"))
    found = evaluation.target_overlap(rows, ("holdout",))
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    pieces = re.findall(r"\*\((\d+)\) Generate explode", found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert len(pieces) == 2 and len(set(pieces)) == 2


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_the_driver_does_not_list_the_files_of_a_tree(spark, tmp_path, monkeypatch, first):
    """tasks list and read the files, wherever the driver stops looking for folders: each once, of all names, and none of skipped or linked folders."""
    monkeypatch.setattr(src, "FIRST_FOLDERS", first)
    names = {"src/__init__.py", "src/.hidden.py", "src/a b/c%20d.py", "src/a b/deep/er/ü.py", "top.py", *(f"src/many/{i}.py" for i in range(20))}
    for name in (*names, "src/node_modules/x/b.py", "src/a b/vendor/b.py", "other/b.py", "src/c.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "src/empty").mkdir()
    (tmp_path / "src/loop").symlink_to(tmp_path / "src")
    (tmp_path / "src/gone.py").symlink_to(tmp_path / "nothing")
    with open(os.fsencode(tmp_path) + b"/src/\xff.py", "w") as odd:
        odd.write("odd")
    found = src.scan_source_tree(spark, f"file://{tmp_path}/", ("src/", "src/many"), (".py",))
    assert found.inputFiles() == []
    rows = found.collect()
    assert sorted(r.path for r in rows) == sorted(names - {"top.py"} | {"src/\ufffd.py"}) and all(r.content == ("odd" if "\ufffd" in r.path else r.path) for r in rows)
    assert "top.py" in {r.path for r in src.scan_source_tree(spark, str(tmp_path)).collect()}
