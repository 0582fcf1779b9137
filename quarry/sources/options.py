"""What a scan is asked for, from settings as text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScanOptions:
    """Data sets and ids to include (none named: all), how many rows to skip and take, shard of shards, force."""

    datasets: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    start: int = 0
    limit: int | None = None
    shard: int = 0
    shards: int = 1
    force: bool = False

    @staticmethod
    def of(settings: Mapping[str, str]) -> ScanOptions:
        """From settings such as those of an environment; lists are separated by commas, blanks are dropped."""
        several = lambda k: tuple(x.strip() for x in settings.get(k, "").split(",") if x.strip())
        number = lambda k, d: int(settings[k]) if settings.get(k, "").strip() else d
        shards = number("shards", 1)
        if not 0 <= number("shard", 0) < shards:
            raise ValueError("shard is not below shards")
        return ScanOptions(several("datasets"), several("ids"), number("start", 0), number("limit", None), number("shard", 0), shards, settings.get("force", "").strip().lower() in ("1", "true", "yes"))

    def scan(self, df: DataFrame, dataset: str, key: str, hash_: str | None = None) -> DataFrame:
        """The rows asked for; a slice is taken in the order of the key. `hash_`: a column to shard by, else the key's."""
        from quarry.functions.text import stable_hash

        if self.datasets:
            df = df.where(F.trim(dataset).isin(*self.datasets))
        if self.ids:
            df = df.where(F.col(key).cast("string").isin(*self.ids))
        if self.shards > 1:
            of = F.col(hash_) if hash_ else stable_hash(F.col(key).cast("string"))
            df = df.where(of % self.shards == self.shard)
        if self.start or self.limit is not None:
            df = df.orderBy(key).offset(self.start)
            df = df if self.limit is None else df.limit(self.limit)
        return df
