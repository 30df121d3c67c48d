"""Writers.  All are ordinary Spark writes: one output file per task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import file_system, new_file

CALL_COLUMNS = ("filename", "startidx", "stopidx", "lencall", "f0", "sigma_f0", "mean_peak", "sigma_peak")
REPORT_COLUMNS = (
    "mmsi", "time_of_day", "range_m", "bearing_deg", "sog", "nav_status", "lane_range_m", "lane_minutes",
)


def write_calls(calls: DataFrame, path: str, run: str) -> str:
    """Tab-separated call list with a header, one folder per run."""
    out = calls.withColumnRenamed("file", "filename") if "file" in calls.columns else calls
    whole = {c: F.col(c).cast("long") for c in CALL_COLUMNS[1:]}
    target = f"{path.rstrip('/')}/run={run}"
    out.withColumns(whole).select(*CALL_COLUMNS).write.csv(target, sep="\t", header=True)
    return target


def spectrogram_folder(n_bands: int, n_slices: int, f_low: float, f_high: float, delta_t: float, log: bool) -> str:
    return f"{n_bands}x{n_slices}_{f_low:.0f}to{f_high:.0f}_{delta_t:.1f}sec" + ("_logF" if log else "")


def write_spectrograms(spec: DataFrame, path: str, **params) -> str:
    """Arrays with their metadata in one table; the folder name carries the
    parameters."""
    target = f"{path.rstrip('/')}/{spectrogram_folder(**params)}"
    spec.write.mode("append").parquet(target)
    return target


def write_clips(clips: DataFrame, path: str) -> None:
    clips.write.mode("append").parquet(path)


def append_annotations(annotations: DataFrame, path: str) -> None:
    annotations.select("file", "t_lo", "f_lo", "t_hi", "f_hi", "code").write.mode("append").csv(path)


def range_report(ships: DataFrame) -> DataFrame:
    """Report columns in their written precision."""
    return ships.select(
        "mmsi",
        F.date_format("ts", "HH:mm:ss").alias("time_of_day"),
        F.col("range_m").cast("int").alias("range_m"),
        F.col("bearing_deg").cast("int").alias("bearing_deg"),
        F.round("sog", 2).alias("sog"),
        "nav_status",
        F.col("lane_range_m").cast("int").alias("lane_range_m"),
        F.col("lane_minutes").cast("int").alias("lane_minutes"),
    )


def write_range_snapshot(ships: DataFrame, path: str) -> bool:
    """Overwrite the report; an empty registry leaves the last one in place."""
    ships = ships.persist()  # evaluated once for the test and the write
    some = not ships.isEmpty()
    if some:
        ships.write.mode("overwrite").csv(path, header=True)
    ships.unpersist()
    return some


def write_objects(rows: DataFrame, path: str) -> DataFrame:
    """Writes each row's ``content`` under its ``key`` below ``path``; returns (key, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            sizes = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with new_file(system, f"{root.rstrip('/')}/{key}") as out:
                    sizes.append(out.write(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n_bytes"])

    return rows.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(write, "key string, n_bytes long")
