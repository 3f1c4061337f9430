"""Rows read per query (from Spark's event log, in a separate process):
the statistics that promise one read of the table keep that promise."""

import os
import re
import subprocess
import sys


from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# Histograms read twice: min and max, then rows into bins, so that nothing but
# bins is shuffled.
EXPECTED = {"hist_carat": 2.0, "hist_price": 2.0, "scatter_density": 2.0,
            "color_profile": 1.0, "corr_matrix": 1.0}
# These read the table so often, and the written per-value counts (50 carats) twice.
WITH_COUNTS = {"ecdf_values": 1, "ecdf_rows": 1, "carat_stats": 2, "insight_stats": 2}
# Box plots read the table once (outliers: twice); what they read besides is the
# written per-value counts, which at this size are nearly as many as the rows.
TABLE_READS = {"box_price_by_clarity": 1, "box_outliers": 2}


def test_reads_per_query():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "scan_check.py"), SF_SMALL, *EXPECTED, *WITH_COUNTS, *TABLE_READS],
                         capture_output=True, text=True, timeout=900, cwd=ROOT)
    got = {m.group(1): float(m.group(2))
           for m in re.finditer(r"^(\w+): records read \d+ = ([\d.]+) x", out.stdout, re.M)}
    boxes = {name: got.pop(name) for name in TABLE_READS}
    counted = {name: got.pop(name) for name in WITH_COUNTS}
    assert all(reads < counted[name] < reads + 0.05 for name, reads in WITH_COUNTS.items()), counted
    assert got == EXPECTED, out.stdout[-2000:] + out.stderr[-2000:]
    for name, reads in TABLE_READS.items():
        assert reads < boxes[name] < reads + 5  # counts twice, cumulative counts at most twice
