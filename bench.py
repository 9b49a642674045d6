"""Benchmark: two pipeline runs over tables at rest, then the API queries on the stored tables.

Prints one JSON line. Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Run 1
fills empty tables, run 2 upserts the second half of the articles, retitled, into them. The API queries
read the stored tables, as the reference's service does, and are the median of three. At the end, one
pipeline run over the next smaller scale (if it lies beside) gives the slope: the power of the input
that a run's seconds grow with. ``value`` is everything at the full scale, the derived resources
(``setup_sec``: vocabulary, stem table, language model) included.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = max(8, 2 * cpus)
    from narrascope.session import get_spark, scratch_dir

    spark = get_spark(f"local[{cpus}]", app="narrascope-bench", shuffle_partitions=parts,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": "16g",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-ckpt-")})
    from pyspark.sql import functions as F

    from narrascope.operators import framing as FR
    from narrascope.operators import queries as Q
    from narrascope.plans import catalog as C
    from narrascope.plans import params as P
    from narrascope.plans.pipeline import current, run_pipeline

    times: dict[str, float] = {}

    def timed(name, fn, repeat=1):
        took = []
        for _ in range(repeat):
            t0 = time.time()
            out = fn()
            took.append(time.time() - t0)
        times[name] = round(statistics.median(took), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def prepared(directory):
        """The derived resources, which stand in for the reference's shipped resource files."""
        b = C.bindings(spark, directory)
        res = C.resources(b)
        res.stem_map.count()
        _ = b.entity
        return b, res

    def one_run(b, res, root, run_id, day, arts):
        return run_pipeline(spark, arts, root, res, run_id=run_id, run_date=dt.date.fromisoformat(day))

    t_setup = time.time()
    b, res = prepared(sf_dir)
    setup = round(time.time() - t_setup, 3)
    print(f"setup: {setup}s", file=sys.stderr, flush=True)
    root = scratch_dir(spark, "bench-tables")
    out = timed("run_pipeline", lambda: one_run(b, res, root, P.RUN1, P.RUN1_DATE, b.articles))
    half = b.articles.agg(F.expr("percentile_disc(0.5) within group (order by ord)").alias("m")).first()["m"]
    again = b.articles.where(F.col("ord") > half).withColumn("title", F.concat(F.lit(P.RETITLE), "title"))
    second = timed("run_pipeline_again", lambda: one_run(b, res, root, P.RUN2, P.RUN2_DATE, again))
    arts, ment, sent, fram = (current(spark, root, t) for t in ("articles", "named_entity_recognition", "sentiment_analysis", "entity_framing"))
    ent = b.entity
    timed("trends", lambda: run(Q.trends(arts, ment, sent, ent, P.RANGE_START, P.RANGE_END)), 3)
    timed("trend_pivot", lambda: run(Q.trend_pivot(Q.trends(arts, ment, sent, ent, P.RANGE_START, P.RANGE_END))), 3)
    timed("phrases", lambda: run(Q.phrases(arts, fram, ent, P.RANGE_START, P.RANGE_END)), 3)
    timed("network", lambda: run(Q.graph_frame(*Q.network(arts, ment, ent, P.RANGE_START, P.RANGE_END,
                                                          P.MIN_SCORE, P.MAX_SCORE, P.GROUPS))), 3)
    timed("corpus_phrases", lambda: run(FR.corpus_phrases(arts, ent, res.stopwords)), 3)
    total = round(setup + sum(times.values()), 3)
    slope = None
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    small = sf_dir.replace(scale[0], f"sf{float(scale[1]) / 10:g}") if scale else ""
    if os.path.isdir(small):  # last, when code is compiled already
        sb, sres = prepared(small)
        arts = sb.articles
        timed("run_pipeline_small", lambda: one_run(sb, sres, scratch_dir(spark, "bench-small"), P.RUN1, P.RUN1_DATE, arts))
        slope = round(math.log10(times["run_pipeline"] / times["run_pipeline_small"]), 2)
    print(json.dumps({"metric": "setup_plus_two_pipeline_runs_plus_api_queries", "value": total, "unit": "sec",
                      "queries": times, "setup_sec": setup, "pipeline_stages": out["timings"], "pipeline_again_stages": second["timings"],
                      "slope": slope, "sf": float(scale[1]) if scale else sf_dir, "cpus": cpus, "shuffle_partitions": parts}))
    spark.stop()


if __name__ == "__main__":
    main()
