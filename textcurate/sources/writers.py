"""Writers: JSON lines by split, CSV, generated blocks with a manifest, merged reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import read_json, write_json
from .readers import BLOCK


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8 JSON lines with nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A folder for each style type and split, so that readers prune."""
    df.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("style_type", "split").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_blocks(df: DataFrame, path: str, manifest: dict[str, Any] | None = None, text: str = "generated", position: str = "pos", parts: int | None = None) -> None:
    """A text folder with the blocks, and `path`.manifest.json beside it.

    Part files hold ranges of positions, so the files one after another, by name, are the
    blocks in order, each followed by the separator; no task writes more than its range.
    """
    rows = df.select(position, F.coalesce(text, F.lit("")).alias("value"))
    rows = rows.repartitionByRange(parts, position) if parts else rows.repartitionByRange(position)
    rows.sortWithinPartitions(position).select("value").write.mode("overwrite").option("lineSep", BLOCK).text(path)
    if manifest is not None:
        write_json(f"{path}.manifest.json", manifest)


def write_summaries(path: str, summaries: DataFrame) -> str:
    """The rows of a small table as a JSON list at path; returns them as a table with a head."""
    rows = [r.asDict(True) for r in summaries.collect()]
    write_json(path, rows)
    return "\n".join("\t".join("" if v is None else str(v) for v in line) for line in [summaries.columns, *(r.values() for r in rows)])


def merge_report(path: str, meta: dict[str, Any], by_type: dict[str, Any]) -> dict[str, Any]:
    """The report with _meta and the given types replaced and other types kept."""
    report: dict[str, Any] = {**(read_json(path) or {}), **by_type, "_meta": meta}
    write_json(path, report)
    return report


def write_generation_report(path: str, meta: dict[str, Any], summaries: dict[str, DataFrame]) -> dict[str, Any]:
    """A report of meta and, for each file, its one-row summary."""
    report = {"meta": meta, "files": [{"path": name, **df.first().asDict(True)} for name, df in summaries.items()]}
    write_json(path, report)
    return report


def write_evaluation(path: str, results: dict[str, dict[str, Any]], lengths: dict[str, DataFrame] | None = None, cosines: dict[str, DataFrame] | None = None) -> None:
    """eval_summary.json, cross_type_confusion.json and tables of lengths and cosines of each style type."""
    for name, tables in (("length", lengths or {}), ("cosine", cosines or {})):
        for style, df in tables.items():
            write_csv(df, f"{path}/{name}_{style}.csv")
    write_json(f"{path}/eval_summary.json", {style: {k: v for k, v in out.items() if k != "confusion"} for style, out in results.items()})
    confusion = {style: out["confusion"] for style, out in results.items() if "confusion" in out}
    if confusion:
        write_json(f"{path}/cross_type_confusion.json", confusion)


def tsv(df: DataFrame, columns: list[str]) -> str:
    """A small result as tab-separated lines under a head; columns that it lacks are empty."""
    rows = [r.asDict() for r in df.collect()]
    return "\n".join("\t".join(line) for line in [columns, *([str(r.get(c, "")) for c in columns] for r in rows)])


#: The columns of the cost listing.
COST_COLUMNS = ["path", "n_records", "usage_prompt_tokens", "usage_completion_tokens", "usage_total_tokens", "cost_usd_estimate"]
