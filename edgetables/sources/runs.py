"""Run-metrics tables as CSV with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The columns of a run-metrics file, in order.
RUN_COLUMNS = {
    "algo": "string",
    "graph_type": "string",
    "n_nodes": "bigint",
    "n_edges": "bigint",
    "n_components": "bigint",
    "diameter": "int",
    "median_time_s": "double",
    "mean_time_s": "double",
    "stdev_time_s": "double",
    "iterations": "int",
    "successful_runs": "int",
    "timeout_runs": "int",
    "n_runs": "int",
    "timed_out": "int",
    "error": "int",
}
LATER_COLUMNS = ("diameter", "iterations")  # absent from older files
HEADER = r'(^|,)"?algo"?(,|$)' r'.*"?n_nodes"?(,|$)'
MOST_FORMS = 100


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run metrics with all columns; those an older file lacks are null.

    Every file is read by its own header line, so old and new files may lie side
    by side.  A header lacking other columns, or a file without one, raises.
    Cells hold no line breaks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("value <> ''")
    is_header = F.col("value").rlike(HEADER)
    forms = lines.filter(is_header).groupBy("file").agg(F.min("value").alias("form"))
    known = [row["form"] for row in forms.select("form").distinct().limit(MOST_FORMS + 1).collect()]
    if len(known) > MOST_FORMS:
        raise ValueError(f"run tables at {path} have more than {MOST_FORMS} different headers")
    columns = {form: [cell.strip().strip('"') for cell in form.split(",")] for form in known}
    for names in columns.values():
        missing = [c for c in RUN_COLUMNS if c not in names and c not in LATER_COLUMNS]
        if missing:
            raise ValueError(f"run table at {path} lacks {missing}")
    # One header per file, so this side is small next to the lines.
    cells = lines.filter(~is_header).join(forms, "file", "left")
    parsed = F.coalesce(
        *[
            F.when(F.col("form") == form, F.struct(*[_cell(names, name, kind) for name, kind in RUN_COLUMNS.items()]))
            for form, names in columns.items()
        ],
        F.raise_error(F.concat(F.lit("no header line in "), "file")).cast(
            "struct<" + ",".join(f"{name}:{kind}" for name, kind in RUN_COLUMNS.items()) + ">"
        ),
    )
    return cells.select(parsed.alias("run")).select("run.*")


def _cell(names: list[str], name: str, kind: str):
    if name not in names:
        return F.lit(None).cast(kind).alias(name)
    row = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
    return row[name].cast(kind).alias(name)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.select(*[name for name in RUN_COLUMNS if name in runs.columns]).write.csv(path, header=True)
