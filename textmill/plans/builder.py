"""A dataset from sources of any kind: register them, process them by the default pipeline or one's own, and export the rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.plans.pipeline import Pipeline, default_pipeline
from textmill.sources import files, sinks, web

DEFAULTS = {"chunk_size": 512, "overlap": 50, "remove_pii": True, "quality_threshold": 0.7, "remove_duplicates": True, "chunking_strategy": "semantic"}


class DatasetBuilder:
    """Sources are registered without being read. ``config`` (a dict, or a JSON file on the driver) has defaults for the arguments of ``process``."""

    def __init__(self, spark: SparkSession, config: dict | str | None = None):
        self.spark = spark
        self.config = {**DEFAULTS, **(json.loads(Path(config).read_text()) if isinstance(config, str) else config or {})}
        self.sources: list[tuple[str, str, dict]] = []
        self.readers: dict[str, Callable[..., DataFrame]] = {}
        self.dataset: DataFrame | None = None

    def _add(self, kind: str, path: str, **options: object) -> DatasetBuilder:
        self.sources.append((kind, path, options))
        return self

    def add_file(self, path: str, **options: object) -> DatasetBuilder:
        """A file of any known kind: PDF, office, e-book or text."""
        return self._add("file", path, **options)

    add_pdf = add_office_document = add_ebook = add_file

    def add_directory(self, path: str, recursive: bool = True, pattern: str = "*", **options: object) -> DatasetBuilder:
        return self._add("file", path, recursive=recursive, pattern=pattern, **options)

    def add_website(self, url: str, pages: DataFrame, max_depth: int = 2, max_pages: int | None = None, allowed: list[str] | None = None, blocked: list[str] | None = None) -> DatasetBuilder:
        """The pages that are reached from ``url`` in a table of fetched ``pages`` (page_id, url, html)."""
        return self._add("website", url, pages=pages, max_depth=max_depth, max_pages=max_pages, allowed=allowed, blocked=blocked)

    def add_table(self, df: DataFrame, name: str = "table") -> DatasetBuilder:
        """Rows that are there already, with a column text; id (else doc_id, else a hash of the text) and source are made where they are missing."""
        return self._add("table", name, df=df)

    def register_extractor(self, kind: str, read: Callable[..., DataFrame]) -> DatasetBuilder:
        """``read(spark, path, **options)`` gives rows with a column text; sources of the kind are added by ``add``."""
        self.readers[kind] = read
        return self

    def add(self, kind: str, path: str, **options: object) -> DatasetBuilder:
        if kind not in self.readers:
            raise ValueError(f"no extractor is registered for {kind}")
        return self._add(kind, path, **options)

    def _read(self, kind: str, path: str, options: dict) -> DataFrame:
        if kind == "file":
            return files.extract(self.spark, path, **options)
        if kind == "website":
            pages = web.domain_filter(options["pages"], options["allowed"], options["blocked"])
            reached = web.crawl(pages, [path], options["max_depth"], options["max_pages"])
            return web.parse_pages(pages.join(reached.select("url"), "url", "left_semi")).select(F.col("url").alias("id"), F.col("url").alias("source"), "text", "title", "language")
        if kind == "table":
            return options["df"].withColumn("source", F.col("source") if "source" in options["df"].columns else F.lit(path))
        return self.readers[kind](self.spark, path, **options)

    def rows(self) -> DataFrame:
        """The union of all sources, missing columns as nulls: id, source, text and what sources have besides."""
        if not self.sources:
            raise ValueError("no sources were added")

        def one(kind: str, path: str, options: dict) -> DataFrame:
            df = self._read(kind, path, options)
            own = F.col("id") if "id" in df.columns else F.col("doc_id") if "doc_id" in df.columns else F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
            return df.withColumn("id", own.cast("string")).withColumn("source", F.col("source") if "source" in df.columns else F.lit(path)).withColumn("source_kind", F.lit(kind))

        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(*s) for s in self.sources])

    def process(self, pipeline: Pipeline | None = None, progress: Callable[[float, str], None] | None = None, **arguments: object) -> DataFrame:
        """The rows through ``pipeline``, or through the default one with ``arguments`` over the config's. Rows whose extraction failed go. progress: is told how far
        the plan is made, as a share and a word; Spark's listeners tell how far a job is."""
        tell = progress or (lambda share, what: None)
        tell(0.0, "sources")
        rows = self.rows()
        if "error" in rows.columns:
            rows = rows.filter("error is null")
        rows = rows.withColumn("doc_id", F.xxhash64("source_kind", "id"))
        tell(0.6, "processing")
        made = pipeline or default_pipeline(**{**{k: self.config[k] for k in DEFAULTS}, **arguments})
        self.dataset = made.process(rows)
        tell(1.0, "done")
        return self.dataset

    def export(self, path: str, form: str = "jsonl", **options: object) -> None:
        """Write what ``process`` gave: jsonl, parquet, csv or folder (a dataset folder)."""
        if self.dataset is None:
            raise ValueError("process() comes first")
        writers = {"jsonl": sinks.to_jsonl, "parquet": sinks.to_parquet, "csv": sinks.to_csv, "folder": sinks.to_dataset_folder}
        if form not in writers:
            raise ValueError(f"unknown format {form}")
        writers[form](self.dataset, path, **options)

    def save_config(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.config, indent=1, sort_keys=True))

    def clear(self) -> None:
        """Sources and the dataset go; the config and registered extractors stay."""
        self.sources, self.dataset = [], None
