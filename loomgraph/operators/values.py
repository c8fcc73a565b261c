"""Value steps: results that are no elements, one row for each value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import predicates
from loomgraph.functions.fields import Fields


@dataclass
class Values:
    """A frame with the column *value*, and *_pos* (its element's id) for order."""

    df: DataFrame

    def Count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def Dedup(self) -> "Values":
        kind = self.df.schema["value"].dataType
        key = F.to_json("value") if isinstance(kind, (T.MapType, T.StructType, T.VariantType)) else F.col("value")
        return Values(self.df.groupBy(key.alias("_k")).agg(F.min_by("value", "_pos").alias("value"), F.min("_pos").alias("_pos")).drop("_k"))

    def Has(self, *args) -> "Values":
        """Keeps values that are structs or variants and have the fields; others go."""
        kind = self.df.schema["value"].dataType
        if not isinstance(kind, (T.StructType, T.VariantType)):
            return Values(self.df.filter(F.lit(False)))
        return Values(self.df.filter(predicates.has(Fields(self.df.schema, metadata="value"), args)))

    def Range(self, start: int, stop: int) -> "Values":
        return Values(self.df.orderBy("_pos", F.col("value").cast("string")).offset(start).limit(max(0, stop - start)))

    def Limit(self, n: int) -> "Values":
        return self.Range(0, n)
