"""Index files: what they return must equal a plain filter over all alignments."""

from __future__ import annotations

import random

import pytest

from depthforge.sources import bai, bam

CONTIGS = [("chrA", 400_000), ("chrB", 90_000), ("chrC", 5_000)]


def record(name, tid, pos, cigar, flag=0):
    n = sum(k for op, k in cigar if op in "MIS=X")
    return {"qname": name, "flag": flag, "tid": tid, "pos": pos, "mapq": 60, "cigar": [{"op": op, "len": k} for op, k in cigar], "mtid": -1, "mpos": -1, "isize": 0, "l_qseq": n, "seq": "ACGT" * (n // 4) + "A" * (n % 4) or "*", "qual": "*", "aux": {}}


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    rng, rows = random.Random(4), []
    for i in range(3000):
        tid = rng.choice([0, 0, 0, 1])
        cigar = [("M", 50), ("N", rng.choice([10, 20_000, 70_000])), ("M", 50)] if rng.random() < 0.05 else [("M", 100)]
        rows.append(record(f"r{i}", tid, rng.randrange(CONTIGS[tid][1] - 100), cigar, 4 if rng.random() < 0.1 else 0))
    rows.sort(key=lambda r: (r["tid"], r["pos"]))
    rows += [record("u", -1, -1, [], 4)] * 3
    at = tmp_path_factory.mktemp("indexed")
    (at / "a.bam").write_bytes(bam.encode_file("@HD\tVN:1.4\n", CONTIGS, rows))
    return at, rows


def test_fetch_equals_filter(spark, sample):
    at, rows = sample
    assert bai.write_bai(spark, str(at)).count() == 1 and (at / "a.bam.bai").exists()
    end = lambda r: r["pos"] + (sum(c["len"] for c in r["cigar"] if c["op"] in "MN") or 1)
    for tid, beg, stop in [(0, 0, 1 << 29), (0, 100_000, 100_001), (0, 16_380, 16_390), (0, 131_072, 150_000), (1, 60_000, 99_999), (1, 89_999, 90_000), (2, 0, 5000), (0, 7, 7)]:
        want = sorted(r["qname"] for r in rows if r["tid"] == tid and r["pos"] < stop and end(r) > beg and beg < stop)
        assert sorted(r["qname"] for r in bai.fetch_region(spark, str(at), CONTIGS[tid][0], beg, stop).collect()) == want
    assert bai.fetch_region(spark, str(at), "chrZ").count() == 0


def test_counts_and_order(spark, sample):
    at, rows = sample
    bai.write_bai(spark, str(at)).collect()
    found = bai.read_bai(spark, str(at)).collect()
    counts = {r["tid"]: (r["beg"], r["end"]) for r in found if r["kind"] == "counts"}
    for tid in (0, 1):
        mine = [r for r in rows if r["tid"] == tid]
        assert counts[tid] == (sum(r["flag"] == 0 for r in mine), sum(r["flag"] == 4 for r in mine))
    assert [r["beg"] for r in found if r["kind"] == "unplaced"] == [3] and 2 not in counts
    with pytest.raises(ValueError):
        bai.build(bam.encode_file("", CONTIGS, [record("x", 0, 9, [("M", 4)]), record("y", 0, 3, [("M", 4)])]))
    with pytest.raises(ValueError):
        list(bai.parse(b"none"))
    empty = bai.build(bam.encode_file("", CONTIGS, []))
    assert list(bai.parse(empty)) == [(-1, "unplaced", 0, 0, 0)] and bai.region_chunks(empty, 0, 0, 10) == []


def test_splits_equal_whole(spark, sample):
    at, rows = sample
    (at / "a.bam.bai").unlink(missing_ok=True)
    whole = sorted((r["qname"], r["tid"], r["pos"], r["flag"]) for r in bam.read_bam(spark, str(at / "a.bam")).collect())
    pick = lambda df: sorted((r["qname"], r["tid"], r["pos"], r["flag"]) for r in df.collect())
    one = bai.read_bam_splits(spark, str(at / "a.bam"), 4096)
    assert pick(one) == whole and len(whole) == len(rows)
    bai.write_bai(spark, str(at)).collect()
    many = bai.read_bam_splits(spark, str(at), 4096)
    assert pick(many) == whole
    order = [r["qname"] for r in many.orderBy("rec_idx").select("qname").collect()]
    assert order == [r["qname"] for r in rows] and many.select("rec_idx").distinct().count() == len(rows)
    data = (at / "a.bam").read_bytes()
    assert len(bai.split_points(bai.build(data), 0, 4096)) > 2
    empty = at / "none"
    empty.mkdir()
    (empty / "e.bam").write_bytes(bam.encode_file("@HD\tVN:1.4\n", CONTIGS, []))
    assert bai.read_bam_splits(spark, str(empty)).count() == 0
