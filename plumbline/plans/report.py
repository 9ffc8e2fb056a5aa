"""The report: its document, the data of all charts, and a sink that shows them only when all are there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..config import Config
from ..operators import charts, floor, grid, histogram
from ..operators.select import fixed
from ..session import prepared

#: The document's names of the flatness figures.
FLATNESS = {"mean_tilt": "mean_tilt_degrees", "max_tilt": "max_tilt_degrees", "cell_size": "cell_size_meters", "valid_cells": "valid_cells", "total_cells": "total_cells"}


class Analysis:
    """What the document and several charts share, computed once: peak, rows with their masks, counts of the stages."""

    def __init__(self, points: DataFrame, cfg: Config = Config()):
        self.points, self.cfg = points, cfg
        self.peak = fixed(histogram.floor_peak(points, cfg))
        self.rows = floor.with_floor(points, cfg, peak=self.peak)
        self.own = self.rows.where("is_floor").drop("in_band", "is_floor")
        self.counts = fixed(self.rows.agg(F.count("*").alias("total"), F.count_if("in_band").alias("after_z_filter"), F.count_if("is_floor").alias("after_refinement")))

    def document(self, filename: str = "", elapsed: float | None = None, timestamp: str | None = None, view_mode: int = 4, total_points: int | None = None) -> DataFrame:
        cfg = self.cfg
        flat = fixed(grid.flatness_summary(self.own.select("x", "y", "z"), cfg.flatness_grid, cfg.min_points))
        swept = floor.sensitivity(self.points, cfg).groupBy("param").agg(F.sort_array(F.collect_list(F.struct("value", "floor_ratio"))).alias("p"))
        swept = swept.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", F.expr("struct(p.value AS values, transform(p.floor_ratio, x -> nanvl(x, NULL)) AS floor_ratios)"))))).alias("sensitivity"))
        r = lambda c, n, name=None: F.bround(c, n).alias(name or c)
        given = (F.lit(filename).alias("file"), F.lit(timestamp).cast("string").alias("timestamp"), F.lit(view_mode).alias("view_mode"))
        doc = F.struct(
            F.struct(*given, F.lit(cfg.max_points).alias("max_points_loaded"), F.col("total").alias("actual_points_loaded"), F.bround(F.lit(elapsed).cast("double"), 3).alias("elapsed_seconds"), F.coalesce(F.lit(total_points).cast("long"), "total").alias("total_vertices")).alias("metadata"),
            F.struct(*(r(c, 6) for c in ("peak_z", "z_min", "z_max", "fwhm")), F.lit(cfg.num_bins).alias("num_bins"), "is_fallback", "is_tilt_limited").alias("peak_detection"),
            F.struct(F.col("total").alias("total_points"), "after_z_filter", "after_refinement", F.bround(F.coalesce(F.try_divide("after_refinement", "total"), F.lit(0.0)), 6).alias("floor_ratio")).alias("filtering"),
            F.struct(*(F.lit(getattr(cfg, c)).alias(c) for c in ("width_multiplier", "intensity_percentile", "color_tolerance", "num_bins", "prominence_ratio", "min_peak_width"))).alias("parameters_used"),
            "sensitivity",
            F.struct(*(r(c, 4, n) if c not in ("valid_cells", "total_cells") else F.col(c).alias(n) for c, n in FLATNESS.items())).alias("flatness"),
        )
        one = F.broadcast(self.peak).crossJoin(F.broadcast(self.counts)).crossJoin(F.broadcast(swept)).crossJoin(F.broadcast(flat))
        return one.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("report"))


def report(points: DataFrame, cfg: Config = Config(), **given) -> DataFrame:
    """One row, one column `report`: JSON of metadata, peak, filtering, parameters, sensitivity, flatness.

    Missing statistics are null, and so is the ratio of a sweep's run that fails. timestamp: a label of the run, given and not read off a
    clock. total_points: of the file, if points is a sample of it. given: see Analysis.document().
    """
    return Analysis(points, cfg).document(**given)


def report_fields(document: DataFrame) -> DataFrame:
    """section, field, value of each number of a document; of lists, field is followed by the place."""
    numbers = "map<string, string>"
    kind = f"peak_detection {numbers}, filtering {numbers}, parameters_used {numbers}, flatness {numbers}, sensitivity map<string, struct<values: array<double>, floor_ratios: array<double>>>"
    doc = document.select(F.from_json("report", kind).alias("d"))
    plain = [doc.select(F.lit(s).alias("section"), F.explode(f"d.{s}").alias("field", "v")).select("section", "field", F.expr("try_cast(v AS double)").alias("value")) for s in ("peak_detection", "filtering", "parameters_used", "flatness")]
    swept = doc.select(F.explode("d.sensitivity").alias("param", "x")).select("param", F.posexplode(F.arrays_zip("x.values", "x.floor_ratios")).alias("i", "y"))
    out = plain[0].where(~F.col("field").isin("is_fallback", "is_tilt_limited"))
    for x in (*plain[1:], swept.select(F.lit("sensitivity").alias("section"), F.expr("concat(param, '.', i)").alias("field"), F.col("y.floor_ratios").alias("value"))):
        out = out.unionByName(x)
    return out


def run_report(points: DataFrame, cfg: Config = Config(), **given) -> dict[str, DataFrame]:
    """The data of the seven charts and the document, by name. The peak and the floor's statistics are computed once for all."""
    a = Analysis(points, cfg)
    stages = "array(named_struct('stage', 'total', 'n', total), named_struct('stage', 'after_z_filter', 'n', after_z_filter), named_struct('stage', 'after_refinement', 'n', after_refinement))"
    return {
        "z_histogram": histogram.histogram(points, "z", cfg.num_bins),
        "fwhm_overlay": charts.fwhm_overlay(points, cfg, a.peak),
        "filtering_funnel": a.counts.select("total", F.inline(F.expr(stages))).selectExpr("stage", "n", "n / cast(greatest(total, 1) AS double) * 100 AS pct"),
        "intensity_histogram": charts.intensity_histogram(a.own, cfg),
        "color_histogram": charts.color_histogram(a.own, cfg),
        "floor_ratio": a.counts.selectExpr("after_refinement AS floor", "total - after_refinement AS non_floor", "coalesce(try_divide(after_refinement, total), 0D) AS floor_ratio"),
        "sensitivity": floor.sensitivity(points, cfg),
        "flatness_cells": grid.flatness_cells(a.own, cfg.flatness_grid, cfg.min_points),
        "report": a.document(**given),
    }


# --- sink -----------------------------------------------------------------------------


class ReportSink(DataSource):
    """format("report"): rows (chart, row), row as JSON, go to <path>/<chart>/part-*.json; option path.

    Tasks write below a hidden name. Only once all have ended does the driver move the charts to their place, the document after them, and at last
    write an empty file _SUCCESS. A write that fails or is killed leaves nothing that a reader takes for a report.
    """

    @classmethod
    def name(cls):
        return "report"

    def schema(self):
        return "chart string, row string"

    def writer(self, schema, overwrite):
        return _ReportWriter(self.options["path"].rstrip("/"))


class _Written(WriterCommitMessage):
    def __init__(self, charts: list[str]):
        self.charts = charts


class _ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        top, _, label = path.rpartition("/")
        self.path, self.hidden = path, f"{top}/_writing-{label}-{uuid.uuid4().hex}"

    def _at(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, iterator) -> WriterCommitMessage:
        fs, top = self._at(self.hidden)
        files, name = {}, f"part-{uuid.uuid4().hex}.json"
        try:
            for r in iterator:
                if r["chart"] not in files:
                    fs.create_dir(f"{top}/{r['chart']}", recursive=True)
                    files[r["chart"]] = fs.open_output_stream(f"{top}/{r['chart']}/{name}")
                files[r["chart"]].write(f"{r['row']}\n".encode())
        finally:
            for f in files.values():
                f.close()
        return _Written([f"{c}/{name}" for c in files])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        (fs, hidden), (_, final) = self._at(self.hidden), self._at(self.path)
        written = sorted((x for m in messages if m for x in m.charts), key=lambda x: (x.startswith("report/"), x))
        for x in written:  # what other attempts of a task left stays behind
            fs.create_dir(f"{final}/{x.rpartition('/')[0]}", recursive=True)
            fs.move(f"{hidden}/{x}", f"{final}/{x}")
        with fs.open_output_stream(f"{final}/_SUCCESS") as f:
            f.write(json.dumps(written).encode())
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs as pafs

        fs, hidden = self._at(self.hidden)
        if fs.get_file_info(hidden).type == pafs.FileType.Directory:
            fs.delete_dir(hidden)


def write_report(points: DataFrame, folder: str, timestamp: str, **kwargs) -> str:
    """Write run_report() as one committed report below folder/timestamp: a folder of JSON lines a chart, `report` the document. Returns that path."""
    path = f"{folder.rstrip('/')}/{timestamp}"
    out = None
    for name, df in run_report(points, timestamp=timestamp, **kwargs).items():
        row = F.col("report") if name == "report" else F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        rows = df.select(F.lit(name).alias("chart"), row.alias("row"))
        out = rows if out is None else out.unionByName(rows)
    prepared(points.sparkSession).dataSource.register(ReportSink)
    out.write.format("report").mode("append").option("path", path).save()
    return path
