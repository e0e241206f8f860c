"""Named preparation variants and the register of the sealed choice."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonloom.operators.contracts import enforce_budget, fingerprint
from photonloom.session import path_exists
from photonloom.sources.sinks import guarded_write


@dataclass(frozen=True)
class Variant:
    """A DataFrame -> DataFrame preparation with parameters. The key changes with the parameters and the version, so that
    stored results of different settings never mix."""

    name: str
    fn: Callable[..., DataFrame] | None = None
    params: dict = field(default_factory=dict)
    version: str = "1"
    max_failed_share: float = 0.05

    @property
    def key(self) -> str:
        if self.fn is None:
            return self.name
        text = json.dumps({"params": self.params, "version": self.version}, sort_keys=True, default=str)
        return f"{self.name}_{hashlib.sha256(text.encode()).hexdigest()[:8]}"

    def apply(self, pixels: DataFrame, value: str = "flux", enforce: bool = False) -> DataFrame:
        """Prepared value, `failed` and `reason`; a row whose prepared value is missing falls back to the raw one."""
        if self.fn is None:
            return pixels.withColumns({"failed": F.lit(False), "reason": F.lit(None).cast("string")})
        out = self.fn(pixels.withColumn("_raw", F.col(value)), **self.params)
        bad = F.col(value).isNull() | F.isnan(value)
        out = out.withColumn("failed", bad).withColumn("reason", F.when(F.col("failed"), "value not finite"))
        out = out.withColumn(value, F.when(F.col("failed"), F.col("_raw")).otherwise(F.col(value))).drop("_raw")
        return enforce_budget(out, F.col("failed"), self.max_failed_share) if enforce else out


VARIANTS: dict[str, Variant] = {"raw": Variant("raw")}


def register_variant(v: Variant) -> Variant:
    VARIANTS[v.name] = v
    return v


def variant(name: str) -> Variant:
    if name not in VARIANTS:
        raise KeyError(f"unknown variant {name}; registered: {sorted(VARIANTS)}")
    return VARIANTS[name]


class ChoiceRegister:
    """The first registered choice wins; a later one with other predictions is reported as changed."""

    def __init__(self, spark: SparkSession, path: str, root: str):
        self.spark, self.path, self.root = spark, path, root

    def register(self, choice: str, predictions: DataFrame, keys: list[str], value: str) -> tuple[str, str, bool]:
        row = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.format_string("%.6f", value))
        print_ = fingerprint(predictions, [], row).first()["fingerprint"]
        if path_exists(self.spark, self.path):
            old = self.spark.read.parquet(self.path).first()
            return old["choice"], old["fingerprint"], old["fingerprint"] != print_
        new = self.spark.range(1).select(F.lit(choice).alias("choice"), F.lit(print_).alias("fingerprint"), F.current_timestamp().alias("registered_at"))
        guarded_write(new, self.path, self.root)
        return choice, print_, False
