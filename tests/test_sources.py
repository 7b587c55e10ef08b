"""Readers and writers of the text and binary formats."""

import pytest

from kinstats.sources import bed
from kinstats.sources import (
    find_freqs, read_covariates, read_crossprods, read_freqs, read_genotypes, read_grm, read_joined_pairs, read_pairs, read_phenotype,
    read_phenotypes, read_results, read_samples, read_variants, write_genotypes, write_tsv,
)


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write


def test_samples_and_variants_keep_file_order(spark, put):
    path = put("x.fam", "".join(f"f{k}  id{k} 0 0 {k % 3} -9\n" for k in range(50)) + "lonely\n\nf50\tid50 0 0 x NA\n")
    out = read_samples(spark, path).orderBy("sample_idx").collect()
    assert [x.iid for x in out] == [f"id{k}" for k in range(51)] and [x.sample_idx for x in out] == list(range(51))
    assert out[50].sex is None and out[50].pheno is None and out[1].pheno == -9
    path = put("x.bim", "1 rs0 0 100 A G\n1 short\n1 rs1 0.5 200 C T\n")
    assert [(x.variant_idx, x.snp_id, x.bp, x.a1) for x in read_variants(spark, path).orderBy("variant_idx").collect()] == [(0, "rs0", 100, "A"), (1, "rs1", 200, "C")]


def test_frequency_layouts(spark, put, tmp_path):
    plain = put("a.frq", " CHR  SNP   A1   A2  MAF  NCHROBS\n   1  rs0    A    G  0.3  8\n   1  rs1    C    T  NA  8\n")
    six = put("b.afreq", "#CHROM\tID\tREF\tALT1\tALT1_FREQ\tOBS_CT\n1\trs0\tG\tA\t0.3\t8\n")
    seven = put("c.afreq", "#CHROM\tID\tREF\tALT\tPROVISIONAL_REF?\tALT_FREQS\tOBS_CT\n1\trs0\tA\tG\tY\t0.7\t8\n")
    assert [tuple(x) for x in read_freqs(spark, plain).orderBy("variant_idx").collect()] == [(0, "rs0", "A", 0.3, 8), (1, "rs1", "C", None, 8)]
    assert tuple(read_freqs(spark, six).first())[1:] == ("rs0", "A", 0.3, 8)
    assert tuple(read_freqs(spark, seven).first())[1:] == ("rs0", "G", 0.7, 8)
    assert find_freqs(spark, str(tmp_path / "a")).endswith("a.frq") and find_freqs(spark, str(tmp_path / "b")).endswith("b.afreq")
    with pytest.raises(ValueError, match="ALT_FREQS"):
        read_freqs(spark, put("d.afreq", "#CHROM\tID\tREF\tALT\tOBS_CT\n1\trs0\tA\tG\t8\n"))
    with pytest.raises(FileNotFoundError):
        find_freqs(spark, str(tmp_path / "z"))


def test_pairs(spark, put):
    get = lambda text, **k: [(x.iid1, x.iid2) for x in read_pairs(spark, put("p", text), **k).orderBy("file_order").collect()]
    assert get("IID1\tIID2\textra\na\tb\t1\n# note\n\nc d\nlonely\n") == [("a", "b"), ("c", "d")]
    assert get("sample1x b\nc d\n") == [("sample1x", "b"), ("c", "d")]
    assert get("f1 a f2 b\nf3 c f4 d\n", layout="fid_iid") == [("a", "b"), ("c", "d")]
    assert get("any thing\na b\n", with_header=True) == [("a", "b")]


def test_wide_tables(spark, put):
    path = put("y", "IID h.t w\na 1.5 NA\nb x 2e1\nc NA .\nd 1.0d inf\ne 1e999 -3.\n")
    out = {x.iid: (x["h.t"], x.w) for x in read_phenotypes(spark, path).collect()}
    assert out == {"a": (1.5, None), "b": (None, 20.0), "e": (None, -3.0)}
    assert read_phenotype(spark, path).count() == 5
    covariates = {x.iid: (x["h.t"], x.row_complete) for x in read_covariates(spark, path).collect()}
    assert covariates["a"] == (1.5, False) and read_covariates(spark, put("c", "IID s\na 1\n")).first().row_complete
    with pytest.raises(ValueError):
        read_covariates(spark, put("c1", "IID\na\n"))
    products = read_crossprods(spark, put("x", "IID1 IID2 h.crossprod\na b 1\nc d NA\n"))
    assert sorted(tuple(x)[:3] for x in products.collect()) == [("a", "b", 1.0), ("c", "d", None)]


def test_relatedness_layouts(spark, put):
    get = lambda text: sorted(tuple(x)[:4] for x in read_grm(spark, put("g", text)).collect())
    assert get("IID1 IID2 N_SNPs GRM\na b 10 0.5\nc d\n") == [("a", "b", 10, 0.5)]
    assert get("x y z kinship w\na b 1 0.25 9\n")[0][3] == 0.25
    assert get("a b 0.1\nc d 0.2\n") == [("a", "b", None, 0.1), ("c", "d", None, 0.2)]
    assert get("a b 7 0.1\n") == [("a", "b", 7, 0.1)]
    with pytest.raises(ValueError):
        get("a b\n")
    joined = read_joined_pairs(spark, put("j", "iid1 iid2 GRM_value height.crossprod\na b 0.1 -\nc d NaN 2\n"))
    assert sorted((tuple(x)[:4] for x in joined.collect()), key=str) == [("a", "b", 0.1, None), ("c", "d", None, 2.0)]
    assert read_joined_pairs(spark, put("k", "a b y1 g2\np q 1 2\n"), grm_col="g2", pheno_col="y1").first()[2:4] == (2.0, 1.0)


def test_writer(spark, tmp_path):
    frame = spark.createDataFrame([("b", None, 1.23456789), ("a", 3, None)], "interval string, n_pairs long, slope double")
    write_tsv(frame, str(tmp_path / "o"), ["interval"], decimals=3)
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    lines = [x for x in text.splitlines() if not x.startswith("interval")]
    assert lines == ["a\t3\tNA", "b\tNA\t1.235"]
    (tmp_path / "r.tsv").write_text("interval\tn_pairs\tintercept\tslope\tr_squared\tmse\tintercept_se\tslope_se\tintercept_ci_lower\tintercept_ci_upper\tslope_ci_lower\tslope_ci_upper\n0.0-0.1\t5\t1\t2\tNA\t0\t0\t0\t0\t0\t1\t3\n")
    got = read_results(spark, str(tmp_path / "r.tsv")).first()
    assert got.n_pairs == 5 and got.r_squared is None and got.slope_ci_upper == 3.0


def test_genotypes(spark, put):
    data = bytes([0x6C, 0x1B, 0x01]) + bytes(range(20))
    out = {x.variant_idx: bytes(x.codes) for x in read_genotypes(spark, put("g.bed", data), samples=7, variants_per_partition=3).collect()}
    assert out == {k: bytes([2 * k, 2 * k + 1]) for k in range(10)}
    for bad in (data + b"x", b"abc" + data[3:]):
        with pytest.raises(Exception, match="genotype file|ends within"):
            read_genotypes(spark, put("bad.bed", bad), samples=7).collect()


def test_genotype_folder(spark, tmp_path):
    rows = [(k, bytes([k % 250, 7])) for k in range(500)]
    path = str(tmp_path / "folder.bed")
    write_genotypes(spark.createDataFrame(rows, "variant_idx int, codes binary").repartition(3), path)
    assert sorted((x.variant_idx, bytes(x.codes)) for x in read_genotypes(spark, path, samples=7, variants_per_partition=40).collect()) == rows


def test_headers_of_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}").write_text("\nIID y\n" + "".join(f"p{k}_{i} {i}\n" for i in range(20)))
    got = read_phenotype(spark, str(folder)).orderBy("file_order").collect()
    assert [x.iid for x in got] == [f"p{k}_{i}" for k in range(3) for i in range(20)]


def folder_of(spark, tmp_path, name, n=1000, **options):
    rows = [(k, bytes([k % 251, k // 251])) for k in range(n)]
    path = str(tmp_path / name)
    write_genotypes(spark.createDataFrame(rows, "variant_idx int, codes binary").repartition(5), path, **options)
    return path, rows


def test_wanted_rows_become_ranges_of_bytes(spark, tmp_path, monkeypatch):
    path, rows = folder_of(spark, tmp_path, "ranges.bed", bytes_per_file=300)
    for wanted in ((700, 701), (120, 131), [(999, 5000), (3, 4), (4, 6)], [(5, 9), (0, 7)], (9, 9), []):
        spans = [wanted] if isinstance(wanted, tuple) else wanted
        some = read_genotypes(spark, path, samples=7, variants_per_partition=64, variants=wanted)
        assert sorted((x.variant_idx, bytes(x.codes)) for x in some.collect()) == [x for x in rows if any(a <= x[0] < b for a, b in spans)], wanted
    # A frame keeps its rows whatever other queries ask of it.
    every = read_genotypes(spark, path, samples=7)
    assert [every.filter("variant_idx < 5").count(), every.count(), every.filter("variant_idx = 2 or variant_idx = 8").count(), every.count()] == [5, 1000, 2, 1000]
    # What a reader touches besides each file's first three bytes.
    reader = bed.GenotypeReader({"path": path, "samples": "7", "variantsPerPartition": "64", "variants": "[[140, 330]]"})
    touched = []
    real = bed.fs.LocalFileSystem.open_input_file

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *rest):
            self.file.close()

        def read_at(self, n, at):
            touched.append(n)
            return self.file.read_at(n, at)

    parts = reader.partitions()
    monkeypatch.setattr(bed, "store", lambda p, old=bed.store: (type("S", (), {"open_input_file": lambda self, name: Counting(real(old(p)[0], name))})(), p))
    got = [i for part in parts for batch in reader.read(part) for i in batch.column(0).to_pylist()]
    assert sorted(got) == list(range(140, 330)) and sum(touched) == 190 * 2


def test_stores_that_only_spark_reads(spark, tmp_path):
    path, rows = folder_of(spark, tmp_path, "whole.bed", bytes_per_file=100)
    assert not bed.known_to_arrow("viewfs://store/x") and bed.known_to_arrow("file:///x") and bed.known_to_arrow("/x")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.beds.link./in", f"file://{tmp_path}")
    far = "viewfs://beds/in/whole.bed"
    assert sorted((x.variant_idx, bytes(x.codes)) for x in read_genotypes(spark, far, samples=7).collect()) == rows
    some = read_genotypes(spark, far, samples=7, variants=(77, 205))
    assert sorted(x.variant_idx for x in some.collect()) == list(range(77, 205))
    assert len(some.inputFiles()) < len(read_genotypes(spark, far, samples=7).inputFiles()) / 3
    assert read_genotypes(spark, far, samples=7, variants=(5000, 6000)).count() == 0
    assert sorted(x.variant_idx for x in read_genotypes(spark, path, samples=7, variants=(77, 205)).collect()) == list(range(77, 205))


@pytest.mark.parametrize("rows, says", [
    ([(0, b"ab"), (2, b"cd")], "variant 2 follows 0"), ([(1, b"ab"), (2, b"cd")], "first variant is 1"), ([(0, b"ab"), (0, b"cd")], "0 follows 0"),
    ([(0, b"ab"), (1, b"c")], "bytes"), ([(0, b"ab"), (None, b"cd")], "without variant_idx"),
])
def test_a_folder_is_whole_or_not_there(spark, tmp_path, rows, says):
    frame = spark.createDataFrame(rows, "variant_idx int, codes binary")
    with pytest.raises(Exception, match=says):
        write_genotypes(frame, str(tmp_path / "bad.bed"))
    assert not (tmp_path / "bad.bed").exists()


def test_only_committed_attempts_leave_files(tmp_path):
    import pyarrow as pa

    make = lambda first, n: pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int32()), pa.array([bytes([k, k]) for k in range(first, first + n)], pa.binary())], ["variant_idx", "codes"])
    writer = bed.GenotypeWriter({"path": str(tmp_path / "two.bed"), "bytesPerFile": "4"})
    late = writer.write(iter([make(0, 3)]))
    told = [writer.write(iter([make(3, 2)])), writer.write(iter([make(0, 3)])), writer.write(iter([])), None]
    with pytest.raises(ValueError, match="not been written"):
        bed.bed_files(str(tmp_path / "two.bed"))
    writer.commit(told)
    files = sorted((tmp_path / "two.bed").iterdir())
    assert [x.name for x in files] == ["part-00000.bed", "part-00001.bed", "part-00002.bed"] and late.files
    assert b"".join(x.read_bytes()[3:] for x in files) == bytes([0, 0, 1, 1, 2, 2, 3, 3, 4, 4])
    with pytest.raises(FileExistsError):
        bed.GenotypeWriter({"path": str(tmp_path / "two.bed")})
    other = bed.GenotypeWriter({"path": str(tmp_path / "gone.bed")})
    other.write(iter([make(0, 3)]))
    other.abort([None])
    assert not (tmp_path / "gone.bed").exists()
