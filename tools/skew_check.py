"""Largest share of rows any one task receives, on tables where a third of
all rows sit on one row, one key and one value.

    python tools/skew_check.py [sf_dir] > skew.md

Two tables are derived from the driver's ``lineitem`` (through the
synthetic diamond view): ``dup`` turns every row whose price is divisible
by 3 (about a third) into one identical row; ``hot`` gives those rows clarity
``VS2``, price 999 and carat 1.0 (the rows stay distinct in their other
columns, the original price kept in z). Both are written as Parquet in several files to a fresh scratch
folder, so scans are parallel and only the operators' shuffles are
measured. For every operator the event log gives the records each task
read from shuffles; the report shows the largest per task, as a share of
the table's rows. A hot group funnelled into one task would show ~0.33.
Adaptive partition coalescing is off here (it would merge small shuffle
partitions into a few tasks, which hides how the keys are spread).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = (argv[1] if len(argv) > 1 else "/root/testdata/sf0.1").rstrip("/")
    scratch = tempfile.mkdtemp(prefix="gemstats-skew-")
    logdir = os.path.join(scratch, "events")
    os.makedirs(logdir)
    from pyspark.sql import functions as F

    from gemstats.operators import category as cat
    from gemstats.operators import clean as cln
    from gemstats.operators import distribution as dst
    from gemstats.operators import filters as flt
    from gemstats.operators import insight as ins
    from gemstats.operators import profile as prf
    from gemstats.session import build_session
    from gemstats.sources.fixture import RAW_COLUMNS, diamond_raw_from, table

    parts = 16
    spark = build_session(master="local[8]", shuffle_partitions=parts,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                                 "spark.eventLog.compress": "false",
                                 # one task per shuffle partition: small shuffles are not merged,
                                 # so the per-task counts show how the keys hash
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    sc = spark.sparkContext
    raw = diamond_raw_from(table(spark, sf_dir, "lineitem"))
    raw = raw.withColumn("_h", F.col("price") % 3 == 0)  # about a third of all rows
    dup_rows = raw.select(*[F.when(F.col("_h"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip(
        RAW_COLUMNS, [1.0, "Ideal", "E", "VS2", 999, 6.4, 6.5, 4.0])])
    # hot rows keep their original price in z, so they stay distinct through de-duplication
    hot_values = {"clarity": F.lit("VS2"), "price": F.lit(999).cast("bigint"), "carat": F.lit(1.0),
                  "z": F.col("price") / 1000.0 + 0.5}
    hot_rows = raw.select(*[F.when(F.col("_h"), hot_values[c]).otherwise(F.col(c)).alias(c)
                            if c in hot_values else F.col(c) for c in RAW_COLUMNS])
    paths = {}
    for name, df in (("dup", dup_rows), ("hot", hot_rows)):
        paths[name] = os.path.join(scratch, name)
        df.repartition(parts).write.parquet(paths[name])
    dup = spark.read.parquet(paths["dup"])
    hot_raw = spark.read.parquet(paths["hot"])
    paths["hot_clean"] = os.path.join(scratch, "hot_clean")
    cln.clean(hot_raw).write.parquet(paths["hot_clean"])
    hc = spark.read.parquet(paths["hot_clean"])
    rows = {"dup": dup.count(), "hot": hc.count(),
            "hot_rows": hc.filter((F.col("clarity") == "VS2") & (F.col("price") == 999)
                                  & (F.col("carat") == 1.0)).count()}
    checks = [
        ("clean (dedup)", "dup", lambda: cln.clean(dup)),
        ("category profile by clarity", "hot", lambda: cat.category_profile(hc, "clarity", ("price", "carat"))),
        ("filter options", "hot", lambda: flt.filter_options(hc)),
        ("histogram price", "hot", lambda: dst.histogram(hc, "price", 50)),
        ("ecdf values carat", "hot", lambda: dst.ecdf_values(hc, "carat")),
        ("ecdf rows carat", "hot", lambda: dst.ecdf_rows(hc, "carat")),
        ("box stats price by clarity", "hot", lambda: dst.box_stats(hc, "price", "clarity")),
        ("box outliers price by clarity", "hot", lambda: dst.box_outliers(hc, "price", "clarity")),
        ("carat stats (exact quartiles)", "hot", lambda: prf.carat_stats(hc)),
        ("scatter density", "hot", lambda: dst.scatter_density(hc)),
        ("insight bundles", "hot", lambda: ins.all_insight_stats(hc)),
    ]
    for label, _, fn in checks:
        sc.setJobGroup(label, label)
        fn().write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, per_task = {}, {}
    for path in [p for p in glob.glob(f"{logdir}/**", recursive=True) if os.path.isfile(p)]:
        for line in open(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                grp = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = grp
            elif kind == "SparkListenerTaskEnd":
                grp = stage_group.get(ev.get("Stage ID"))
                m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                if grp:
                    per_task.setdefault(grp, []).append(m.get("Total Records Read", 0))
    print(f"Rows: dup table {rows['dup']:,} (a third of them one row before de-duplication), "
          f"cleaned hot table {rows['hot']:,} ({rows['hot_rows']:,} of them on clarity VS2, price 999, carat 1.0); "
          f"{parts} shuffle partitions, AQE on, coalescing off.\n")
    print("| operator | table | shuffle records read, all tasks | most by one task | share of table rows |")
    print("|---|---|---|---|---|")
    for label, tab, _ in checks:
        recs = per_task.get(label, [0])
        top = max(recs)
        print(f"| {label} | {tab} | {sum(recs):,} | {top:,} | {top / rows[tab]:.4f} |")


if __name__ == "__main__":
    main(sys.argv)
