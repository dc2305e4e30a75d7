"""Block-compressed and binary call files, whole and by region, against plain text."""

from __future__ import annotations

import gzip
import random
import struct

import pytest

from strandloom.sources import bcf, blocks, text
from strandloom.sources import contigs as C

NAMES = [f"s{i}" for i in range(8)]
HEAD = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="x">', "##contig=<ID=1,length=3000000>", "##contig=<ID=2,length=90000>", '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">']
HEAD.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *NAMES]))


@pytest.fixture(scope="module")
def records():
    rng, out = random.Random(8), []
    for contig, end, n in (("1", 3_000_000, 4000), ("2", 90_000, 300)):
        for pos in sorted(rng.choices(range(1, end), k=n)):
            ref = "A" * rng.choice((1, 1, 1, 40))
            calls = [tuple(rng.choice((0, 0, 1, 2, None)) for _ in range(rng.choice((1, 2, 2, 2)))) for _ in NAMES]
            out.append((contig, pos, ref, rng.choice(("T", "T,G")), calls, "i" * rng.randrange(90)))
    return out


def lines(records):
    show = lambda x: "." if x is None else str(x)
    return ["\t".join([c, str(p), ".", ref, alt, ".", ".", info, "DP:GT", *("7:" + "|".join(map(show, g)) for g in calls)]).replace("DP:GT", "GT").replace("7:", "") for c, p, ref, alt, calls, info in records]


def typed(values, kind=1):
    head = bytes([len(values) << 4 | kind]) if len(values) < 15 else bytes([0xF0 | kind, 0x12]) + struct.pack("<h", len(values))
    return head + (values if kind == 7 else struct.pack(f"<{len(values)}b", *values))


def binary(records, kind=None):
    """A binary call file, and an index of it, made by the format's description."""
    head = ("\n".join(HEAD) + "\n\0").encode()
    out, index = blocks.Writer(), blocks.Index()
    out.write(b"BCF\x02\x02" + struct.pack("<I", len(head)) + head)
    for contig, pos, ref, alt, calls, _ in records:
        alleles = [ref, *alt.split(",")]
        shared = struct.pack("<iiifII", "12".index(contig), pos - 1, len(ref), 0.0, len(alleles) << 16, 2 << 24 | len(NAMES)) + typed(b"", 7) + b"".join(typed(x.encode(), 7) for x in alleles) + typed([], 0)
        genotypes = [([0 if a is None else a + 1 << 1 | 1 for a in g] + [-127])[:2] for g in calls]
        own = typed([1]) + bytes([1 << 4 | 1]) + struct.pack("<8b", *[7] * 8) + typed([2]) + bytes([2 << 4 | 1]) + struct.pack("<16b", *[x for g in genotypes for x in g])
        data, start = struct.pack("<II", len(shared), len(own)) + shared + own, out.mark
        if len(out.held) + len(data) > blocks.TEXT:
            out.flush()
            start = out.mark
        out.write(data)
        index.add(contig, pos - 1, pos - 1 + len(ref), start, out.mark)
    return out.finish(), blocks.compressed(blocks.encode_index(index, blocks.CSI))


def calls(df):
    return sorted(((r.contig, r.pos, r.ref, r.alt, r.sample, r.a0, r.a1) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def files(records, tmp_path_factory):
    folder = tmp_path_factory.mktemp("calls")
    (folder / "plain.vcf").write_text("\n".join([*HEAD, *lines(records)]) + "\n")
    (folder / "one.vcf.gz").write_bytes(gzip.compress((folder / "plain.vcf").read_bytes()))
    for name, kind, ending in (("tabix", blocks.TBI, "tbi"), ("csi", blocks.CSI, "csi")):
        data, index = blocks.indexed_calls(HEAD, lines(records), kind)
        (folder / f"{name}.vcf.gz").write_bytes(data)
        (folder / f"{name}.vcf.gz.{ending}").write_bytes(index)
    (folder / "bare.vcf.gz").write_bytes(data)
    data, index = binary(records)
    (folder / "b.bcf").write_bytes(data)
    (folder / "b.bcf.csi").write_bytes(index)
    (folder / "bare.bcf").write_bytes(data)
    return folder


REGIONS = [None, "1:1000000-1200000", "1:0-17000", "1:2990000-3000000", "2:40000-40500", "2:1-900000", "1:5-6", "3:1-9"]


@pytest.mark.parametrize("name", ["one.vcf.gz", "tabix.vcf.gz", "csi.vcf.gz", "bare.vcf.gz", "b.bcf", "bare.bcf"])
def test_regions_equal_the_plain_file(spark, files, name):
    for region in REGIONS[:: 1 if "bare" not in name else 2]:
        want = calls(text.read_vcf(spark, str(files / "plain.vcf"), ["s5", "s0"], region))
        assert calls(text.read_vcf(spark, str(files / name), ["s5", "s0"], region)) == want
        assert want or region in ("1:5-6", "3:1-9")


def test_any_reader_takes_the_blocks(files):
    assert gzip.decompress((files / "tabix.vcf.gz").read_bytes()) == (files / "plain.vcf").read_bytes()


@pytest.mark.parametrize("split", [1, 700, 30_000, 10**9])
def test_every_line_is_in_one_split(files, split):
    path, want = str(files / "tabix.vcf.gz"), (files / "plain.vcf").read_text().splitlines()
    with blocks.open_file(path) as file:
        found = [x for one in blocks.stretches(path, None, max(split, file.size() // 300)) for x in blocks.stretch_lines(file, one)]
    assert [x.decode() for _, x in found] == want and len({at for at, _ in found}) == len(want)


def test_lines_that_end_with_blocks_and_long_ones(tmp_path):
    """Blocks that end with a line's end, lines over several blocks, carriage returns, no line end at the end."""
    rng, out, want = random.Random(3), blocks.Writer(), []
    for i in range(300):
        line = f"{i} " + "x" * rng.choice((3, 900, 70_000 if i % 40 == 0 else 5))
        want.append(line)
        out.write((line + ("\r\n" if i % 7 == 0 else "\n")).encode())
        if rng.random() < 0.4:
            out.flush()
    out.write(b"last")
    path = tmp_path / "a.txt.gz"
    path.write_bytes(out.finish())
    for split in (50, 333, 5000):
        with blocks.open_file(str(path)) as file:
            found = [x.decode() for one in blocks.stretches(str(path), None, split) for _, x in blocks.stretch_lines(file, one)]
        assert found == [*want, "last"]


def test_a_region_reads_only_its_blocks(spark, files):
    path = str(files / "tabix.vcf.gz")
    index = blocks.read_index(path)
    chunks = index.chunks("1", 1_000_000, 1_050_000)
    size = (files / "tabix.vcf.gz").stat().st_size
    with blocks.open_file(path) as file:
        starts = [at for at, text in blocks.blocks(file, 0) if text]
    touched = [at for at in starts if any(a >> 16 <= at <= b >> 16 for a, b in chunks)]
    assert len(starts) > 5 and 1 <= len(touched) <= 2
    rows = blocks.read_lines(spark, path, ("1", 1_000_000, 1_050_000)).collect()
    assert 0 < len(rows) < 400 and all(any(a <= r.offset < b for a, b in chunks) for r in rows)
    whole = blocks.read_lines(spark, path, split=10_000)
    assert whole.rdd.getNumPartitions() == -(-size // 10_000) and whole.count() == len(HEAD) + 4300


def test_records_that_begin_before_a_linear_window(files):
    """A bin's chunks begin with long records; what the linear index and the first offsets leave out is not in the region."""
    for name in ("tabix", "csi"):
        index = blocks.read_index(str(files / f"{name}.vcf.gz"))
        with blocks.open_file(str(files / f"{name}.vcf.gz")) as file:
            for low in range(0, 3_000_000, 70_001):
                got = {x for a, b in index.chunks("1", low, low + 9000) for _, x in blocks.lines(file, a, b)}
                want = {x.encode() for x in (files / "plain.vcf").read_text().splitlines() if x.startswith("1\t") and int(x.split("\t")[1]) - 1 < low + 9000 and int(x.split("\t")[1]) - 1 + len(x.split("\t")[3]) > low}
                assert want <= got


def test_damage_is_an_error(spark, files, tmp_path):
    data = bytearray((files / "tabix.vcf.gz").read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "bad.vcf.gz").write_bytes(data)
    with pytest.raises(Exception, match="damaged|no block|invalid|Error -3"):
        text.read_vcf(spark, str(tmp_path / "bad.vcf.gz"), ["s1"]).collect()
    (tmp_path / "cut.vcf.gz").write_bytes((files / "tabix.vcf.gz").read_bytes()[:-60])
    with pytest.raises(Exception, match="cut off|no block"):
        text.read_vcf(spark, str(tmp_path / "cut.vcf.gz"), ["s1"]).collect()
    (tmp_path / "x.bcf").write_bytes(blocks.compressed(b"BCF\x01..."))
    with pytest.raises(ValueError, match="version 2"):
        text.read_vcf(spark, str(tmp_path / "x.bcf"), ["s1"])
    with pytest.raises(ValueError, match="neither"):
        blocks.parse_index(b"nothing")


def test_header_and_source(spark, files):
    for name in ("plain.vcf", "tabix.vcf.gz", "b.bcf"):
        assert text.vcf_samples(spark, str(files / name)) == NAMES and text.vcf_lengths(spark, str(files / name)) == {"1": 3_000_000, "2": 90_000}
    seen = [C.contig(spark, str(files / name), ["s1", "s4"], "1:100000-400000").observe(1000) for name in ("plain.vcf", "tabix.vcf.gz", "b.bcf")]
    het = [sorted((r.sample, r.win, r.ob) for r in x.het.collect()) for x in seen]
    spectra = [{r.k: r.n_sites for r in x.spectrum.collect()} for x in seen]
    assert het[0] == het[1] == het[2] and spectra[0] == spectra[1] == spectra[2] and sum(spectra[0].values()) > 50
    assert bcf.read_head(str(files / "b.bcf"))[0].keys == {0: "PASS", 1: "DP", 2: "GT"}
