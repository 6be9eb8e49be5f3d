"""The command line, and backward CIGAR operations."""

from __future__ import annotations

import csv
import gzip
import io
import json

import pytest

from depthforge.__main__ import main
from depthforge.functions.back_steps import remove_back_steps, unwind
from depthforge.sources import bam, bgzf

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chrA\tLN:1000
@SQ\tSN:chrB\tLN:500
@RG\tID:g\tSM:s
r1\t99\tchrA\t6\t60\t10M\t=\t151\t150\tACGTACGTAC\t*
r2\t0\tchrA\t13\t60\t4M2D6M\t*\t0\t0\tACGTACGTAC\t*
r3\t0\tchrA\t300\t60\t10M\t*\t0\t0\tACGTACGTAC\t*
r4\t0\tchrB\t1\t60\t5M\t*\t0\t0\tACGTA\t*
"""
BED = "chrA\t10\t20\nchrA\t18\t30\nchrB\t0\t10\n"


def lines(folder, opener=open):
    return [r for part in sorted(folder.glob("part-*")) for r in opener(part, "rt").read().splitlines()]


def give(monkeypatch, data):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(data)))


@pytest.mark.parametrize("form", ["txt", "csv", "json"])
def test_report(spark, tmp_path, form):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "t.bed").write_text(BED)
    out = tmp_path / "out"
    main(["report", "-o", str(out), "-p", str(tmp_path / "t.bed"), "-f", "5", "-F", form, "--uncover", "1", "--depthratio", "0.5", "--cutoffdepth", "2", "--bamout", str(tmp_path / "on.bam"), str(tmp_path / "a.sam")], spark)
    depth = {(r["#Chr"], int(r["Pos"])): int(r["Cover depth"]) for r in csv.DictReader(lines(out / "depth.tsv.gz", gzip.open), delimiter="\t") if r["#Chr"] != "#Chr"}
    want = {("chrA", p): (p <= 15) + (13 <= p <= 24) for p in range(11, 31)} | {("chrB", p): int(p <= 5) for p in range(1, 11)}
    assert depth == want
    assert sorted(lines(out / "uncover.bed")) == ["chrA\t24\t30", "chrB\t5\t10"]
    if form == "json":
        made = json.loads((out / "report.json").read_text())
        assert made["target"]["reads"] == 3 and [x["name"] for x in made["chromosomes"]] == ["chrA", "chrB"] and "cov_2x" in made["chromosomes"][0]
        assert made["depth_distribution"][0] == {"depth": 0, "count": 11, "fraction": 0.366667, "cumulative_count": 19, "cumulative_fraction": 0.633333}
        assert len(made["insert_size_distribution"]) == 151 and made["insert_size"] == {"average": 150, "median": 0}
    elif form == "csv":
        assert "[Target] Target Reads,3" in (out / "coverage.csv").read_text().splitlines()
        assert (out / "chromosomes.csv").read_text().splitlines()[0] == "Chromosome,DATA(%),Avg depth,Median,Coverage%,Cov 4x %,Cov 10x %,Cov 30x %,Cov 100x %,Cov 2x %"
        assert (out / "depth_distribution.csv").read_text().splitlines()[:2] == ["depth,count,fraction,cumulative_count,cumulative_fraction", "0,11,0.366667,19,0.633333"]
    else:
        assert "[Target] Target Reads".rjust(60) + "\t3" in (out / "coverage.report").read_text().splitlines()
        assert (out / "chromosomes.report").read_text().splitlines()[2].split() == ["chrB", "22.73", "0.50", "0.0", "50.00", "0.00", "0.00", "0.00", "0.00", "0.00"]
        assert (out / "depth_distribution.plot").read_text().splitlines()[0] == "0\t11\t0.366667\t19\t0.633333"
    kept = bam.read_bam(spark, str(tmp_path / "on.bam"))
    assert sorted((r["qname"], r["chrom"], r["pos"]) for r in kept.collect()) == [("r1", "chrA", 5), ("r2", "chrA", 12), ("r4", "chrB", 0)]
    assert [r["line"] for r in bam.read_bam_header(spark, str(next((tmp_path / "on.bam").glob("part-*.bam")))).collect()] == SAM.splitlines()[:4]


def test_report_of_standard_input(spark, tmp_path, monkeypatch, capsys):
    """Binary alignments, with and without the block that ends a file, and text."""
    (tmp_path / "t.bed").write_text(BED)
    record = {"qname": "r", "tid": 0, "pos": 12, "mapq": 60, "cigar": [{"op": "M", "len": 5}], "flag": 0, "mtid": -1, "mpos": -1, "isize": 0, "seq": "ACGTA", "qual": "*", "aux": {}}
    whole = bam.encode_file("@SQ\tSN:chrA\tLN:1000\n@SQ\tSN:chrB\tLN:500\n", [("chrA", 1000), ("chrB", 500)], [record] * 4)
    for k, (data, warned) in enumerate([(whole, False), (whole[: -len(bgzf.EOF_BLOCK)], True), (SAM.encode(), False), (gzip.compress(SAM.encode()), False)]):
        give(monkeypatch, data)
        main(["report", "-o", str(tmp_path / f"o{k}"), "-p", str(tmp_path / "t.bed"), "-F", "csv"], spark)
        assert "[Total] Raw Reads (All reads),4" in (tmp_path / f"o{k}" / "coverage.csv").read_text().splitlines()
        assert ("cut off" in capsys.readouterr().err) == warned


def test_toolkit(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.bed").write_text(BED)
    (tmp_path / "b.bed").write_text("chrA\t12\t14\n")
    a, b = str(tmp_path / "a.bed"), str(tmp_path / "b.bed")
    for k, (args, want) in enumerate([(["merge", a], {"chrA\t10\t30", "chrB\t0\t10"}), (["merge", "--left", "2", b], {"chrA\t10\t14"}), (["intersect", a, b], {"chrA\t12\t14"}), (["subtract", a, b], {"chrA\t10\t12", "chrA\t14\t30", "chrB\t0\t10"}), (["trim", "--left", "2", "--right", "3", a], {"chrA\t12\t27", "chrB\t2\t7"}), (["shift", "--to", "1", b], {"chrA\t13\t14"})]):
        main([*args, "-o", str(tmp_path / f"o{k}")], spark)
        assert set(lines(tmp_path / f"o{k}")) == want
    assert "'regions': 1" in capsys.readouterr().out
    give(monkeypatch, b"chrA\t12\t14\n")
    main(["diff", a, "-"], spark)
    assert capsys.readouterr().out.splitlines() == ["chrA\t10\t12", "chrA\t14\t30", "chrB\t0\t10"]


def test_unwind():
    assert unwind([("M", 4), ("B", 2), ("M", 4)], "ACGTGTAA", "55555555") == ([("M", 6)], "ACGTAA", "555555")
    # the better of two different bases stays, with the difference as its quality
    assert unwind([("M", 2), ("B", 1), ("M", 2)], "ACTG", "5+5+") == ([("M", 3)], "ATG", "5++")
    assert unwind([("M", 2), ("D", 3), ("B", 1), ("N", 2), ("M", 1)], "ACC", "*") == ([("M", 1), ("N", 2), ("M", 1)], "AC", "*")
    assert unwind([("M", 3), ("B", 1)], "ACG", "*") == ([("M", 3)], "ACG", "*")
    assert unwind([("B", 1), ("M", 3)], "ACG", "*") is None and unwind([("M", 2), ("B", 3), ("M", 3)], "*", "*") is None
    assert unwind([], "*", "*") == ([], "*", "*")


def test_remove_back_steps(spark):
    schema = "qname string, flag int, cigar array<struct<op:string,len:int>>, seq string, qual string, l_qseq int"
    rows = [("b", 0, [("M", 4), ("B", 2), ("M", 4)], "ACGTGTAA", "55555555", 8), ("plain", 0, [("M", 3)], "ACG", "*", 3), ("bad", 0, [("B", 1), ("M", 3)], "ACG", "*", 3), ("off", 4, [("B", 1)], "A", None, 1), ("none", None, None, None, None, None)]
    got = {r["qname"]: r for r in remove_back_steps(spark.createDataFrame(rows, schema)).collect()}
    assert (got["b"]["cigar"], got["b"]["seq"], got["b"]["l_qseq"], got["b"]["flag"]) == ([("M", 6)], "ACGTAA", 6, 0)
    assert got["bad"]["flag"] == 4 and got["bad"]["seq"] == "ACG" and got["off"]["flag"] == 4 and got["none"]["flag"] is None
    assert tuple(got["plain"]) == rows[1]
    assert remove_back_steps(spark.createDataFrame([], schema)).count() == 0
