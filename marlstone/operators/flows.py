"""Flow graphs in which every hub passes on what it gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hub:
    """``adds``: columns that flow into the hub, ``takes``: columns that flow out of it; what is left goes to the next hub."""

    name: str
    adds: tuple[str, ...]
    takes: tuple[str, ...]


def balanced(df: DataFrame, keys: list[str], hubs: list[Hub], profit: str = "profit", loss: str = "loss") -> DataFrame:
    """``keys, source, sink, v``: positive flows of each row through a chain of hubs.

    A negative leg flows the other way. A hub that is short is paid for by the next one, the last one by
    ``loss``; what the last has left goes to ``profit``. A missing amount is no flow. So what
    comes into each hub is what goes out.
    """
    amount = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    def leg(source: str, sink: str, v: Column) -> Column:
        back = v < 0
        return F.struct(F.when(back, sink).otherwise(source).alias("source"), F.when(back, source).otherwise(sink).alias("sink"), F.abs(v).alias("v"))

    legs, left = [], F.lit(0.0)
    for k, hub in enumerate(hubs):
        legs += [leg(c, hub.name, amount(c)) for c in hub.adds] + [leg(hub.name, c, amount(c)) for c in hub.takes]
        for c in hub.adds:
            left = left + amount(c)
        for c in hub.takes:
            left = left - amount(c)
        if k + 1 < len(hubs):
            legs.append(leg(hub.name, hubs[k + 1].name, left))
    last = hubs[-1].name
    legs += [F.struct(F.lit(last).alias("source"), F.lit(profit).alias("sink"), F.greatest(left, F.lit(0.0)).alias("v")), F.struct(F.lit(loss).alias("source"), F.lit(last).alias("sink"), F.greatest(-left, F.lit(0.0)).alias("v"))]
    return df.select(*keys, F.inline(F.array(*legs))).where("v > 0")
