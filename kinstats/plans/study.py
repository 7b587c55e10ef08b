"""A whole analysis from files to files: relatedness, residuals, products, bins, regression and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import HIGH, LOW, WIDTH, binned_stats
from ..operators.he import bootstrap_ci, he_regression, summarise
from ..operators.many import VALUES, binned_stats_many, he_regression_many, products_many, residualise_many
from ..operators.pairs import col, crossprods, first_of_each
from ..operators.residuals import covariates_at, join_covariates, residualise
from ..sources import read_covariates, read_grm, read_phenotypes, write_tsv
from ..sources.text import ORDER
from ..storage import saved
from ..watch import Watch
from .relatedness import relatedness


def covariate_names(table: DataFrame, positions: str | None) -> list[str]:
    """The covariates of a table in file order, or those at ``positions``."""
    names = [c for c in table.columns if c not in ("iid", "row_complete", ORDER)]
    return names if positions is None else covariates_at(names, positions)


def study(spark: SparkSession, out: str, pairs: str, phenotypes: str, covariates: str, cuts: DataFrame, prefix: str | None = None, grm: str | None = None, positions: str | None = None, group_col: str | None = None, width: float = WIDTH, low: float = LOW, high: float = HIGH, replicates: int = 1000, seed: int = 1, decimals: int = 6, watch: Watch | None = None, **options) -> dict[str, DataFrame]:
    """Reads the files of people and pairs, writes those of every step into the folder ``out``, and returns the steps' frames by name.

    Relatedness comes from the genotypes ``<prefix>.bed`` of the pairs listed in ``pairs`` (``options`` as for
    ``relatedness``) or from a file ``grm`` of pairs. Files of pairs and people have their lines in the order of the file that
    they follow: ``relatedness.tsv`` and ``products.tsv`` that of the pairs, ``residuals.tsv`` that of the covariates. Of a pair that is listed
    several times, either way round, the first line counts from the bins on. With one phenotype, ``bins.tsv``, ``results.tsv``
    (with bootstrap intervals) and ``summary.tsv`` follow; with several, all are adjusted, multiplied and regressed at once,
    and ``bins.tsv`` and ``results.tsv`` (without bootstrap) have a column for the phenotype.
    """
    x, y = read_covariates(spark, covariates, watch), read_phenotypes(spark, phenotypes, watch)
    names = [c for c in y.columns if c not in ("iid", ORDER)]
    chosen = covariate_names(x, positions)
    people = join_covariates(x, y, names, ORDER, keep=True)
    related = saved(relatedness(spark, prefix, pairs, watch=watch, **options) if prefix else read_grm(spark, grm, watch))
    write_tsv(related, f"{out}/relatedness.tsv", [ORDER], columns={"iid1": "IID1", "iid2": "IID2", "n_snps": "N_SNPs", "grm": "GRM"})
    found = _one(related, people, names[0], chosen, cuts, group_col, replicates, seed, width, low, high, watch) if len(names) == 1 else _several(related, people, names, chosen, cuts, group_col, width, low, high)
    resid = {f"{v}_resid": f"{v}.resid" for v in names}
    products = {f"{v}_crossprod": f"{v}.crossprod" for v in names}
    write_tsv(found["residuals"], f"{out}/residuals.tsv", [ORDER], decimals, {"iid": "IID"} | resid)
    write_tsv(found["products"], f"{out}/products.tsv", [ORDER], columns={"iid1": "IID1", "iid2": "IID2"} | products)
    write_tsv(found["bins"], f"{out}/bins.tsv", ["bin", *(["phenotype"] if len(names) > 1 else [])], columns={c: c for c in found["bins"].columns if c != "bin"})
    write_tsv(found["results"], f"{out}/results.tsv", ["interval_ord", *(["phenotype"] if len(names) > 1 else [])], columns={c: c for c in found["results"].columns if c not in ("interval_ord", "lo", "hi")})
    if "summary" in found:
        write_tsv(found["summary"], f"{out}/summary.tsv", ["interval"], columns={c: c for c in found["summary"].columns if c != "interval_ord"})
    return {"relatedness": related} | found


def once(products: DataFrame) -> DataFrame:
    """``products``, one row for each pair of people: the first line."""
    keyed = products.withColumns({"_lo": F.least("iid1", "iid2"), "_hi": F.greatest("iid1", "iid2")})
    return first_of_each(keyed, ["_lo", "_hi"], ORDER).drop("_lo", "_hi")


def _one(related, people, name, chosen, cuts, group_col, replicates, seed, width, low, high, watch):
    adjusted = saved(residualise(people, name, chosen, group_col, keep=(ORDER,), watch=watch))
    products = saved(crossprods(related, adjusted.withColumnRenamed(f"{name}_resid", name), [name], keep=("grm", ORDER), watch=watch))
    rows = saved(once(products))
    value = f"{name}_crossprod"
    results = saved(he_regression(rows, cuts, "grm", value).join(bootstrap_ci(rows, cuts, "grm", value, replicates=replicates, seed=seed).drop("interval"), "interval_ord"))
    return {"residuals": adjusted, "products": products, "bins": binned_stats(rows, [value], width=width, low=low, high=high), "results": results, "summary": summarise(results)}


def _several(related, people, names, chosen, cuts, group_col, width, low, high):
    adjusted = saved(residualise_many(people, names, chosen, group_col, keep=(ORDER,)))
    products = saved(products_many(related, adjusted, keep=("grm", ORDER)))
    rows = saved(once(products))
    wide = lambda df, suffix: df.select(*(col(c) for c in df.columns if c != VALUES), *(col(VALUES)[k].alias(f"{v}{suffix}") for k, v in enumerate(names)))
    bins = binned_stats_many(rows, names, width=width, low=low, high=high)
    return {"residuals": wide(adjusted, "_resid"), "products": wide(products, "_crossprod"), "bins": bins, "results": he_regression_many(rows, cuts, names)}
