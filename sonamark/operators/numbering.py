"""Numbers of the shots of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shot_numbers(captures: DataFrame, group: list[str], folder: str, time: str, suffix: str, file: str, excluded: str, last: str = "txt") -> DataFrame:
    """captures with shot and the rule that numbered their group (a run's signal): `folder` where every capture that counts states its number in its
    folder, which is then kept; else `time`, in the order of capture; or `name` where a time is missing, in the order of the suffixes with `last`
    at the end, which deserves a warning. Excluded captures are numbered after the highest, by file name."""
    w, counts = W.partitionBy(*group), ~F.col(excluded)
    real = F.count_if(counts).over(w)
    stated = (real > 0) & (F.count_if(counts & F.col(folder).isNull()).over(w) == 0)
    timed = F.count_if(counts & F.col(time).isNull()).over(w) == 0
    x = captures.withColumns({"_real": real, "rule": F.when(stated, "folder").when(timed, "time").otherwise("name"), "_top": F.max(F.when(counts, F.col(folder))).over(w)})

    def where(rule: str, value: Column) -> Column:
        return F.when(counts & (F.col("rule") == rule), value)

    order = [F.col(excluded), where("folder", F.col(folder)), where("time", F.col(time)), where("name", F.col(suffix) == last), where("name", F.col(suffix)), F.col(file)]
    x = x.withColumn("_at", F.row_number().over(w.orderBy(*order)))
    top = F.when(F.col("rule") == "folder", F.col("_top")).otherwise(F.col("_real"))
    shot = F.when(F.col(excluded), top + F.col("_at") - F.col("_real")).when(F.col("rule") == "folder", F.col(folder)).otherwise(F.col("_at"))
    return x.withColumn("shot", shot.cast("long")).drop("_real", "_top", "_at")
