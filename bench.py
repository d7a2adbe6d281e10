"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

$BENCH_CPUS may list several numbers of cores ("1,2,4"); the first gives the headline figures, all are reported. A time is
the median of $BENCH_RUNS warm runs. The tables are copied once, untimed, into as many files as there are cores: how an
input is split is the caller's choice, and the test tables are single files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from doclake.operators import containers, office, tables
from doclake.plans import QUERIES, office_queries
from doclake.session import get_session, work_dir

HEADLINE = [
    "html_tokens", "html_to_markdown", "html_links", "media_candidates", "md_blocks", "md_to_html", "md_toc_pages", "detect_kind",
    "archive_members", "expand_nested", "docx_to_markdown", "pptx_to_markdown", "sheets_to_markdown", "file_tree", "bundle_documents",
    "concat_raw", "stream_links", "stream_ingest",
]
# Operators over packages: the packages are written once and not timed.
STORED = {
    "archive_members": ("zip", lambda f: containers.archive_members(f)),
    "expand_nested": ("zip", lambda f: containers.expand_nested(f)),
    "docx_to_markdown": ("docx", lambda f: office.docx_to_markdown(containers.package_parts(f))),
    "pptx_to_markdown": ("pptx", lambda f: office.pptx_to_markdown(containers.package_parts(f))),
    "sheets_to_markdown": ("xlsx", lambda f: tables.sheets_to_markdown(tables.sheet_cells(containers.package_parts(f)))),
}
TABLES = ["region", "nation", "customer", "part", "documents", "pages", "conversations", "events"]


def moved(spark) -> tuple[int, int]:
    """Bytes that all stages so far wrote to shuffles and spilled to disk."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    every = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in every), sum(s.diskBytesSpilled() for s in every)


def measure(sf: str, cpus: str, runs: int, chosen: list[str]) -> dict:
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 30
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": f"{max(2, min(20, memory * 5 // 8))}g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    data = work_dir(spark, "bench-input")
    for name in TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(int(cpus)).write.parquet(f"{data}/{name}.parquet")
    pages = spark.read.parquet(f"{data}/pages.parquet").selectExpr("count(*)", "sum(octet_length(html))").first()
    times, shuffled, spilled, stored, failed = {}, {}, {}, {}, {}
    for kind in sorted({STORED[n][0] for n in chosen if n in STORED}):
        stored[kind] = work_dir(spark, kind)
        getattr(office_queries, f"{kind}_files")(spark, data).write.parquet(stored[kind])
    for name in chosen:
        taken = []
        try:
            for run in range(runs + 1):  # the first run compiles
                before, start = moved(spark), time.perf_counter()
                job = STORED[name][1](spark.read.parquet(stored[STORED[name][0]])) if name in STORED else QUERIES[name](spark, data)
                job.write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
                shuffled[name], spilled[name] = (round((b - a) / 1e6, 2) for a, b in zip(before, moved(spark)))
            times[name] = round(statistics.median(taken[1:]), 3)
        except Exception as e:  # one failing query does not take the figures of the others
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"
    spark.stop()
    whole = times.get("html_to_markdown")
    return {"cpus": int(cpus), "value": round(sum(times.values()), 3), "queries": times, "failed": failed, "shuffle_mb": shuffled, "spill_mb": spilled,
            "pages_per_sec_html_to_markdown": round(pages[0] / whole, 1) if whole else None, "mb_per_sec_html_to_markdown": round(pages[1] / 1e6 / whole, 2) if whole else None}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    found = [measure(sf, cpus, runs, chosen) for cpus in os.environ.get("BENCH_CPUS", "8").split(",")]
    if any(f["failed"] for f in found):
        print(*[f["failed"] for f in found], sep="\n", file=sys.stderr)
    print(json.dumps({"metric": "total_headline_seconds", "unit": "sec", "sf": os.path.basename(sf).removeprefix("sf"), **found[0], "by_cpus": {f["cpus"]: f["value"] for f in found}}))


if __name__ == "__main__":
    main()
