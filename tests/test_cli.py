"""The command line runs a report end to end and writes it with Spark's writer."""

import glob
import json
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_run_writes_report_rows():
    out = os.path.join(tempfile.mkdtemp(prefix="distkpi-cli-"), "cover_days")
    cmd = [sys.executable, "-m", "distkpi.run", "cover_days", "--testdata", "/root/testdata/sf0.001",
           "--start", "2000-03-01", "--end", "2000-03-31", "--out", out, "--format", "json",
           "--master", "local[2]"]
    subprocess.run(cmd, cwd=ROOT, check=True, timeout=600,
                   stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    rows = [json.loads(line) for f in glob.glob(os.path.join(out, "*.json")) for line in open(f)]
    assert {r["classification"] for r in rows} == {"A", "B", "C", "Others"}
    assert all("cover_days" in r for r in rows)
