"""python -m textmill.cli create|analyze ..: datasets from files, and reports on them."""

from __future__ import annotations

import argparse

from textmill.operators import stats
from textmill.plans.builder import DatasetBuilder
from textmill.session import get_session
from textmill.sources import sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textmill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create", help="process files into a dataset")
    c.add_argument("paths", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--format", default="jsonl", choices=["jsonl", "parquet", "csv", "folder"])
    c.add_argument("--chunk-size", type=int, default=512)
    c.add_argument("--overlap", type=int, default=50)
    c.add_argument("--strategy", default="semantic")
    c.add_argument("--quality", type=float, default=0.7)
    c.add_argument("--keep-pii", action="store_true")
    a = sub.add_parser("analyze", help="print a summary of a JSONL dataset")
    a.add_argument("path")
    a.add_argument("--report", help="write an HTML report to this file")
    x = p.parse_args(argv)
    spark = get_session()
    if x.command == "create":
        b = DatasetBuilder(spark)
        for path in x.paths:
            b.add_directory(path)
        b.process(chunk_size=x.chunk_size, overlap=x.overlap, chunking_strategy=x.strategy, quality_threshold=x.quality, remove_pii=not x.keep_pii)
        b.export(x.output, x.format)
        return 0
    df = sinks.from_jsonl(spark, x.path)
    s = stats.summary(df).first()
    print(f"documents: {s['total_documents']}\ncharacters: {s['total_text_length']}\naverage: {s['text_length_mean']:.1f}")
    if x.report:
        with open(x.report, "w", encoding="utf-8") as f:
            f.write(stats.report(df))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
