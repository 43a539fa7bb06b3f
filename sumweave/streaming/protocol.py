"""The line protocol: relation names up to ``Done``, then queries; ``F`` ends a batch."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from sumweave.plans.builder import build
from sumweave.sources.catalog import Catalog

log = logging.getLogger(__name__)


class Timer:
    """Wall-clock time between ``start`` and ``pause``, added up; starts may nest or overlap between threads."""

    def __init__(self):
        self._lock, self._running, self._since, self.total = threading.Lock(), 0, 0.0, 0.0

    def start(self) -> None:
        with self._lock:
            if not self._running:
                self._since = time.perf_counter()
            self._running += 1

    def pause(self) -> None:
        with self._lock:
            self._running -= 1
            if not self._running:
                self.total += time.perf_counter() - self._since

    def __enter__(self) -> Timer:
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.pause()


def format_row(row: Iterable) -> str:
    """Values with single spaces between; a zero or missing sum is NULL."""
    return " ".join("NULL" if v is None or v == 0 else str(int(v)) for v in row)


def run_protocol(spark: SparkSession, lines: Iterable[str], stage_dir: str | None = None, workers: int = 4) -> Iterator[str]:
    """Result lines in query order. Queries of a batch run side by side on the driver's thread
    pool (Spark schedules their jobs together); results come out at ``F`` or at the end.

    A relation name is a column file, or a Parquet path (ending ``.parquet``). With ``stage_dir``
    column files are copied to Parquet there first.
    """
    it = (x.strip() for x in lines)
    cat, load, answer, queries = Catalog(spark), Timer(), Timer(), 0
    load.start()
    for name in it:
        if name == "Done":
            break
        if name.endswith(".parquet"):
            cat.add_parquet(name)
        elif name:
            cat.add_file(name, f"{stage_dir}/r{len(cat)}" if stage_dir else None)
    cat.analyze(workers)
    load.pause()

    def job(line: str) -> str:
        with answer, Timer() as own:
            out = format_row(build(cat, line).collect()[0])
        log.info("%.3f s: %s", own.total, line)
        return out

    with ThreadPoolExecutor(workers) as pool:
        pending = []
        for line in it:
            if line == "F":
                yield from (p.result() for p in pending)
                pending = []
            elif line:
                pending.append(pool.submit(job, line))
                queries += 1
        yield from (p.result() for p in pending)
    log.info("loading %.3f s; %d queries %.3f s", load.total, queries, answer.total)


def main() -> None:
    import sys

    logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    spark = SparkSession.builder.getOrCreate()
    try:
        for out in run_protocol(spark, sys.stdin):
            print(out, flush=True)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
