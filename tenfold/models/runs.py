"""A run table: the result rows of finished fits, by study, model and draw.

Fits are appended as they finish, so a job whose driver is lost goes on where it
stopped, and larger models may begin where smaller ones ended.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.models.fitting import RESULT_SCHEMA, Results, _row, split_results
from tenfold.models.spec import Design, ModelSpec
from tenfold.session import scratch_path

RUN_SCHEMA = f"study string, {RESULT_SCHEMA}"


class RunTable:
    """Rows below one path; without a path, a fresh one in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "run")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUN_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RUN_SCHEMA)

    def finished(self, study: str) -> set[tuple[str, int]]:
        """(model, draw) of the fits whose rows are there."""
        there = self.rows().where((F.col("study") == study) & (F.col("part") == "fit") & (F.col("term") == "deviance"))
        return {(r["spec"], r["pv"]) for r in there.select("spec", "pv").collect()}

    def append(self, study: str, table: DataFrame) -> None:
        """Rows of whole fits; one write, so a fit is there with all its rows or not at all."""
        table.select(F.lit(study).alias("study"), *table.columns).write.mode("append").parquet(self.path)

    def results(self, study: str, specs: list[ModelSpec]) -> Results:
        rows = self.rows().where((F.col("study") == study) & F.col("spec").isin([s.name for s in specs]))
        return split_results(rows.drop("study"))

    def states(self, study: str) -> dict[tuple[str, int], State]:
        found: dict[tuple[str, int], State] = {}
        for r in self.rows().where((F.col("study") == study) & (F.col("part") == "state")).collect():
            state = found.setdefault((r["spec"], r["pv"]), State({}, {}))
            if r["term2"] is None:
                state.beta[r["term"]] = r["value"]
            else:
                state.lam[r["term"], r["term2"]] = r["value"]
        return found


class State:
    """Fixed effects and covariance factor of a finished fit, by name, in the columns it was fitted in."""

    def __init__(self, beta: dict[str, float], lam: dict[tuple[str, str], float]):
        self.beta, self.lam = beta, lam

    def rows(self, spec: str, pv: int) -> list[tuple]:
        fixed = [_row(spec, pv, "state", term=c, value=v) for c, v in self.beta.items()]
        return fixed + [_row(spec, pv, "state", term=a, term2=c, value=v) for (a, c), v in self.lam.items()]

    @classmethod
    def of(cls, xcols: list[str], beta: np.ndarray, zcols: list[str], lam: np.ndarray) -> State:
        lower = {(zcols[i], zcols[j]): float(lam[i, j]) for i in range(len(zcols)) for j in range(i + 1)}
        return cls(dict(zip(xcols, map(float, beta))), lower)

    def factor(self, zcols: list[str]) -> np.ndarray:
        """The factor over ``zcols``, in which columns that are new vary little and by themselves."""
        out = 0.3 * np.eye(len(zcols))
        for i, a in enumerate(zcols):
            for j, c in enumerate(zcols[: i + 1]):
                if (a, c) in self.lam:
                    out[i, j] = self.lam[a, c] if i != j else self.lam[a, c] or 0.05
        return out[np.tril_indices(len(zcols))]


def nearest(known: dict[tuple[str, int], State], spec: ModelSpec, pv: int, design: Design) -> State | None:
    """Of the finished fits of this draw whose random part is nested in the model's, the one with most in common."""
    mine, fixed = set(spec.random_columns(design)), set(spec.fixed_columns(design))
    best, most = None, -1
    for (_, draw), state in known.items():
        inner = {a for a, _ in state.lam}
        if draw == pv and inner <= mine:
            common = 100 * len(inner) + len(fixed & set(state.beta)) - len(fixed ^ set(state.beta))
            if common > most:
                best, most = state, common
    return best


def by_nesting(specs: list[ModelSpec], design: Design) -> list[list[ModelSpec]]:
    """The models in the order in which one may start from another: by the size of the random part."""
    sizes = sorted({len(s.random_columns(design)) for s in specs})
    return [[s for s in specs if len(s.random_columns(design)) == n] for n in sizes]
