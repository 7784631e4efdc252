"""Small tables in few files, however many shuffle partitions there are."""

from pathlib import Path

from tarnfell.llm.near_dedup import near_duplicates
from tarnfell.sources.stores import shared_folder


def test_near_duplicates_in_few_files(spark):
    rows = [(i, " ".join(f"w{(i // 3) * 97 + k * 7919 % 1013}" for k in range(80)) + (f" end{i}" if i % 3 else "")) for i in range(300)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("*/part-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: i // 3 * 3 for i in range(300)}
    files = set(folder.glob("*/part-*")) - before
    by_table = {t: sum(f.parent.name == t for f in files) for t in {f.parent.name for f in files}}
    assert max(by_table.values()) <= 2
