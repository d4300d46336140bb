"""Letting the verdict of an operator on documents take effect on their rows.

Rows are named by where they stand: a hash of the path of their Parquet file and their place in it. So rows with a null id, rows that
share an id and rows that are equal in every column are still told apart, and nothing is matched by `doc_id`. Frames that aren't
read straight from Parquet are written first.

Defined edge cases: null and repeated ids and repeated rows as above; an empty table gives an empty result; other columns pass by,
whatever their names, but for those of `NAME`, which are an error.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import materialize, scope, sized

#: Columns that name a row. Among a million files two share a 64-bit hash with a chance of 3e-8.
NAME = ["__file", "__row"]


def named(docs: DataFrame) -> DataFrame:
    """`docs` with the columns `NAME`, no two rows alike and the same ones in every run over it."""
    clash = [c for c in docs.columns if c in NAME]
    if clash:
        raise ValueError(f"reserved column names: {clash}")
    if not _reads_parquet(docs):
        docs = materialize(docs, "rows")
    return docs.withColumns({NAME[0]: F.xxhash64("_metadata.file_path"), NAME[1]: F.col("_metadata.row_index")})


def _reads_parquet(docs: DataFrame) -> bool:
    """Whether rows are those of Parquet files, one for one, with nothing between but a choice of columns."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.child()
    try:
        return plan.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns and docs.select("_metadata.row_index") is not None
    except AnalysisException:
        return False


def keep_one(docs: DataFrame, verdict: DataFrame, group: str) -> DataFrame:
    """One row of each `group` of `docs` (with `NAME`), without the names: that which `verdict` (`NAME`, `group`, kept) keeps, and if
    it keeps several, as where ids repeat or are null, one of those. Rows whose group is null stay.

    Only the dropped rows' names are joined with the texts: usually the few.
    """
    row = F.struct(*NAME)
    with scope(docs.sparkSession):
        verdict = materialize(verdict.select(*NAME, F.col(group).alias("group"), "kept").where("group IS NOT NULL"), "verdict")
        several = verdict.where("kept").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first")).where("n > 1")
        again = verdict.where("kept").join(several.select("group", "first"), "group").where(row != F.col("first"))
        dropped = verdict.where("NOT kept").select(*NAME).unionByName(again.select(*NAME))
        dropped = sized(dropped, "dropped", outer=1)
    return docs.join(dropped, NAME, "left_anti").drop(*NAME)
