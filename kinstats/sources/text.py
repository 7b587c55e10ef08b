"""Delimited text: readers that keep the order of lines where it matters, and a writer.

Missing values are null in every frame. ``file_order`` (where it is kept) sorts as the lines of the files do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import missing_or_number, number, words_of
from ..watch import Watch, count_if, watched

ORDER = "file_order"
RESULT = "interval string, n_pairs long, intercept double, slope double, r_squared double, mse double, intercept_se double, slope_se double, intercept_ci_lower double, intercept_ci_upper double, slope_ci_lower double, slope_ci_upper double"
#: First two column names by which a pair list's header is known.
PAIR_HEADERS = [("iid1", "iid2"), ("id1", "id2"), ("sample1", "sample2"), ("fid1", "iid1")]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Tokens ``t`` of every line that has any, and ``file_order``."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(words_of(F.col("value")).alias("t"), order.alias(ORDER)).filter(F.col("t")[0] != "")


def numbered_lines(rows: DataFrame) -> DataFrame:
    """``rows`` of ``lines`` with ``idx``, from 0 in file order.

    Rows are numbered inside each block of each file; only the blocks' sizes, a row for each, meet on the driver.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"_file": F.col(f"{ORDER}.file"), "_block": F.col(f"{ORDER}.block"), "_row": F.col(f"{ORDER}.row")})
    from pyspark.sql import Window

    within = Window.partitionBy("_file", "_block").orderBy("_row")
    at, starts = 0, []
    for file, block, n in sorted(map(tuple, rows.groupBy("_file", "_block").count().collect())):
        starts.append((file, block, at))
        at += n
    starts = spark.createDataFrame(starts, "_file string, _block long, _start long")
    return rows.withColumn("_k", F.row_number().over(within)).join(F.broadcast(starts), ["_file", "_block"]).withColumn("idx", (F.col("_start") + F.col("_k") - 1).cast("int")).drop("_file", "_block", "_row", "_start", "_k")


def first_line(spark: SparkSession, path: str) -> list[str] | None:
    """Tokens of the first line of the first file; of that file only what comes before it is read."""
    files = sorted(spark.read.text(path).inputFiles())
    for file in files:
        found = lines(spark, file).filter(F.col(f"{ORDER}.block") == 0).limit(1).collect()
        if found:
            return found[0]["t"]
    return None


def header(spark: SparkSession, path: str) -> list[str]:
    """Tokens of the first line of the first file."""
    first = first_line(spark, path)
    if first is None:
        raise ValueError(f"{path} is empty")
    return first


def without_header(rows: DataFrame) -> DataFrame:
    """Without the first line of each file. Only files' first blocks are looked through for it; a row for each file is joined."""
    at = F.col(ORDER)
    firsts = rows.filter(at["block"] == 0).groupBy(at["file"].alias("_file")).agg(F.min(at["row"]).alias("_row"))
    return rows.join(F.broadcast(firsts), (at["file"] == F.col("_file")) & (at["row"] == F.col("_row")), "left_anti")


def token(k: int) -> Column:
    return F.get("t", F.lit(k))


def long_enough(rows: DataFrame, least: int, step: str, watch: Watch | None) -> DataFrame:
    """Lines of ``least`` tokens or more; a watch counts all and those left out."""
    return watched(watch, rows, step, n_lines=F.count("*"), n_short=count_if(F.size("t") < least)).filter(F.size("t") >= least)


def read_samples(spark: SparkSession, path: str, watch: Watch | None = None) -> DataFrame:
    """Six columns without a header; the place of a line is the sample's place in the genotype rows."""
    rows = numbered_lines(long_enough(lines(spark, path), 2, "read_samples", watch))
    return rows.select(F.col("idx").alias("sample_idx"), token(0).alias("fid"), token(1).alias("iid"), token(2).alias("pat"), token(3).alias("mat"), token(4).try_cast("int").alias("sex"), number(token(5)).alias("pheno"))


def read_variants(spark: SparkSession, path: str, watch: Watch | None = None) -> DataFrame:
    """Six columns without a header; the place of a line is the variant's row in the genotype matrix."""
    rows = numbered_lines(long_enough(lines(spark, path), 6, "read_variants", watch))
    return rows.select(F.col("idx").alias("variant_idx"), token(0).alias("chrom"), token(1).alias("snp_id"), number(token(2)).alias("cm"), token(3).try_cast("long").alias("bp"), token(4).alias("a1"), token(5).alias("a2"))


def read_freqs(spark: SparkSession, path: str) -> DataFrame:
    """Allele frequencies in either layout; a header that starts with ``#`` counts the ALT allele and is read by its column names."""
    names = header(spark, path)
    rows = without_header(lines(spark, path))
    if names[0].startswith("#"):
        where = {x.lstrip("#").upper(): k for k, x in enumerate(names)}

        def pick(*options: str) -> int:
            for x in options:
                if x in where:
                    return where[x]
            raise ValueError(f"{path} has no column {' or '.join(options)}")

        snp, allele, freq, n = pick("ID", "SNP"), pick("ALT", "ALT1"), pick("ALT_FREQS", "ALT1_FREQ", "ALT_FREQ"), pick("OBS_CT")
    else:
        snp, allele, freq, n = 1, 2, 4, 5
    rows = numbered_lines(rows.filter(F.size("t") > max(snp, allele, freq, n)))
    return rows.select(F.col("idx").alias("variant_idx"), token(snp).alias("snp_id"), token(allele).alias("counted_allele"), number(token(freq)).alias("freq"), token(n).try_cast("int").alias("obs_ct"))


def find_freqs(spark: SparkSession, prefix: str) -> str:
    """``<prefix>.afreq`` if it is there, else ``<prefix>.frq``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in (f"{prefix}.afreq", f"{prefix}.frq"):
        at = path(name)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name
    raise FileNotFoundError(f"{prefix}.afreq or {prefix}.frq")


def read_pairs(spark: SparkSession, path: str, layout: str = "iid", with_header: bool | None = None, watch: Watch | None = None) -> DataFrame:
    """iid1, iid2; further columns and lines from ``#`` on are ignored. ``layout`` fid_iid has FID1 IID1 FID2 IID2."""
    rows = lines(spark, path).filter(~F.col("t")[0].startswith("#"))
    if with_header is None:
        first = first_line(spark, path)
        with_header = first is not None and tuple(x.lower() for x in first[:2]) in PAIR_HEADERS
    a, b = (1, 3) if layout == "fid_iid" else (0, 1)
    if with_header:
        rows = without_header(rows)
    return long_enough(rows, b + 1, "read_pairs", watch).select(token(a).alias("iid1"), token(b).alias("iid2"), ORDER)


def wide(spark: SparkSession, path: str, ids: int, parse=number) -> tuple[DataFrame, list[str]]:
    names = header(spark, path)
    rows = without_header(lines(spark, path))
    return rows.select(*(token(k).alias(f"id{k + 1}") for k in range(ids)), *(parse(token(k)).alias(x) for k, x in enumerate(names[ids:], ids)), ORDER), names[ids:]


def read_phenotypes(spark: SparkSession, path: str, watch: Watch | None = None) -> DataFrame:
    """iid and a column for each phenotype of the header; people without any value are left out."""
    rows, names = wide(spark, path, 1)
    some = F.coalesce(*(F.col(f"`{x}`") for x in names)).isNotNull()
    return watched(watch, rows, "read_phenotypes", n_lines=F.count("*"), n_empty=count_if(~some)).filter(some).withColumnRenamed("id1", "iid")


def read_phenotype(spark: SparkSession, path: str) -> DataFrame:
    """The first phenotype of a file, people without a value too."""
    rows, names = wide(spark, path, 1)
    return rows.select(F.col("id1").alias("iid"), F.col(f"`{names[0]}`"), ORDER)


def read_covariates(spark: SparkSession, path: str, watch: Watch | None = None) -> DataFrame:
    """iid, the covariates, and ``row_complete``: whether all of them have a value."""
    rows, names = wide(spark, path, 1)
    if not names:
        raise ValueError("no covariate columns")
    complete = F.lit(True)
    for x in names:
        complete = complete & F.col(f"`{x}`").isNotNull()
    rows = watched(watch, rows, "read_covariates", n_lines=F.count("*"), n_incomplete=count_if(~complete))
    return rows.withColumnRenamed("id1", "iid").withColumn("row_complete", complete)


def read_grm(spark: SparkSession, path: str, watch: Watch | None = None) -> DataFrame:
    """iid1, iid2, n_snps (null if not given), grm: the column GRM or KINSHIP, or without such a header the third of three or fourth of four."""
    names = [x.upper() for x in header(spark, path)]
    rows = lines(spark, path)
    at = next((k for k, x in enumerate(names) if x in ("GRM", "KINSHIP")), None)
    if at is None:
        if len(names) not in (3, 4):
            raise ValueError(f"{len(names)} columns and none is named GRM or KINSHIP")
        at = len(names) - 1
    else:
        rows = without_header(rows)
    n = token(2).try_cast("long") if at == 3 else F.lit(None).cast("long")
    out = long_enough(rows, at + 1, "read_grm", watch).select(token(0).alias("iid1"), token(1).alias("iid2"), n.alias("n_snps"), number(token(at)).alias("grm"), ORDER)
    return watched(watch, out, "read_grm_values", n_missing=count_if(F.col("grm").isNull()))


def read_crossprods(spark: SparkSession, path: str) -> DataFrame:
    """iid1, iid2 and the cross-products of the header."""
    rows, names = wide(spark, path, 2)
    if not names:
        raise ValueError("at least three columns and a header are needed")
    return rows.withColumnsRenamed({"id1": "iid1", "id2": "iid2"})


def read_joined_pairs(spark: SparkSession, path: str, grm_col: str | None = None, pheno_col: str | None = None, watch: Watch | None = None) -> DataFrame:
    """iid1, iid2, grm, y. Without names: the last column whose name holds grm, relatedness or kinship, and the last with pheno, product or cross; else the third and fourth."""
    names = header(spark, path)
    last = lambda parts, other: max((k for k, x in enumerate(names) if any(p in x.lower() for p in parts)), default=other)
    g = names.index(grm_col) if grm_col else last(("grm", "relatedness", "kinship"), 2)
    y = names.index(pheno_col) if pheno_col else last(("pheno", "product", "cross"), 3)
    rows = without_header(lines(spark, path))
    out = rows.select(token(0).alias("iid1"), token(1).alias("iid2"), missing_or_number(token(g)).alias("grm"), missing_or_number(token(y)).alias("y"), ORDER)
    return watched(watch, out, "read_joined_pairs", n_lines=F.count("*"), n_excluded=count_if(F.col("grm").isNull() | F.col("y").isNull()))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=RESULT)


def write_tsv(df: DataFrame, path: str, order_by: list[str] | None = None, decimals: int | None = None, columns: dict[str, str] | None = None, compression: str = "none") -> None:
    """Tab-separated, with a header, NA for null; doubles in full or with fixed decimals.

    With ``order_by``, lines come in that order, file after file; ``file_order`` of a reader, which operators keep where they
    are asked to, gives that of its lines. ``columns``: which are written, and under what names. Readers take files that are
    compressed (``gzip``) as they take others.
    """
    if order_by:
        df = df.orderBy(*(F.col(f"`{x}`") for x in order_by))
    if columns:
        df = df.select(*(F.col(f"`{x}`").alias(name) for x, name in columns.items()))
    if decimals is not None:
        fixed = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.format_string(f"%.{decimals}f", F.col(f"`{c}`"))).alias(c)
        df = df.select(*(fixed(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
    # Without a comment mark of its own the writer would put a header that begins with # in quotes.
    df.write.option("sep", "\t").option("header", True).option("nullValue", "NA").option("comment", "\1").option("compression", compression).csv(path)
