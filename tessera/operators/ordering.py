"""The two orders of the data model: view order (case-sensitive, number < text < bool < empty) and formula order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIXED = "struct<kind:tinyint,num:double,str:string,bool:boolean,err:string>"
#: The kinds of a mixed cell.
EMPTY, NUMBER, TEXT, BOOL, ERROR = 0, 1, 2, 3, 5


def mixed_cell(c: Column) -> Column:
    """The view-order key of a mixed cell: errors sort as their text, empty cells last."""
    kind = c["kind"]
    rank = F.when(c.isNull() | (kind == EMPTY), 3).when(kind == NUMBER, 0).when(kind.isin(TEXT, ERROR), 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.when(rank == 0, c["num"]).alias("num"), F.when(rank == 1, F.coalesce(c["err"], c["str"])).alias("str"), F.when(rank == 2, c["bool"]).alias("bool"))


def view_order(c: Column, descending: bool = False, mixed: bool = False) -> Column:
    """Descending reverses everything, so empty cells come first."""
    key = mixed_cell(c) if mixed else c
    return key.desc_nulls_first() if descending else key.asc_nulls_last()


def formula_order(c: Column, dtype: str, descending: bool = False) -> Column:
    """Order of SORT(): text ignores case, a blank counts as 0, "" or FALSE."""
    key = F.coalesce(F.lower(c), F.lit("")) if dtype == "string" else F.coalesce(c, F.lit(False)) if dtype == "boolean" else F.coalesce(c, F.lit(0).cast(dtype))
    return key.desc() if descending else key.asc()
