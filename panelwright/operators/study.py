"""One signal and its prices: labels once, every diagnostic on them, and an audit."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import audit as audits
from panelwright.errors import DataContractError
from panelwright.operators import decay, labels, portfolio, resample, signal, transform
from panelwright.result import Evidence, FrameResult


class SignalStudy:
    """Facade; labels are built once and persisted."""

    def __init__(self, signal_data: DataFrame, prices: DataFrame | None = None, *, labels_data: DataFrame | None = None, time: str = "time", instrument: str = "instrument", signal_value: str = "signal"):
        if (prices is None) == (labels_data is None):
            raise DataContractError("a study needs either prices or labels")
        self.data, self.prices, self._labels = signal_data, prices, labels_data
        self.names = {"time": time, "instrument": instrument, "signal_value": signal_value}
        self.label_evidence: Evidence | None = None

    def labels(self, **settings: Any) -> DataFrame:
        if self._labels is None:
            found = labels.forward_returns(self.prices, **settings)
            self._labels, self.label_evidence = found.frame.persist(), found.evidence
        return self._labels

    def ic(self, **settings: Any) -> Evidence:
        return signal.ic(self.data, self.labels(), **{**self.names, **settings})

    def bucketize(self, **settings: Any) -> FrameResult:
        return transform.bucketize(self.data, **{**self.names, **settings})

    def bucket_returns(self, bucketed: DataFrame, **settings: Any) -> Evidence:
        return signal.bucket_returns(bucketed, self.labels(), **{k: v for k, v in {**self.names, **settings}.items() if k != "signal_value"})

    def neutralize(self, **settings: Any) -> FrameResult:
        names = {"signal_time": self.names["time"], "instrument": self.names["instrument"], "signal_value": self.names["signal_value"]}
        return transform.neutralize(self.data, **{**names, **settings})

    def quantiles(self, **settings: Any) -> Evidence:
        return signal.quantiles(self.data, self.labels(), **{**self.names, **settings})

    def turnover(self, **settings: Any) -> Evidence:
        return signal.turnover(self.data, **{**self.names, **settings})

    def decay(self, **settings: Any) -> Evidence:
        return signal.decay(self.data, self.labels(), **{**self.names, **settings})

    def fit_decay(self, result: Evidence | None = None, **settings: Any) -> Evidence:
        return decay.fit_decay(result or self.decay(), **settings)

    def portfolio_projection(self, bucketed: DataFrame, **settings: Any) -> FrameResult:
        return portfolio.portfolio_projection(bucketed, self.labels(), **{**self.names, **settings})

    def independent_series(self, horizon: str, min_observations: int = 3) -> list[float]:
        """Coefficients of one horizon whose label intervals do not overlap: each period starts at or after the last one kept ends.

        The scan is sequential over periods, of which there are few.
        """
        lab = self.labels().where(F.col("horizon") == horizon)
        panel = signal.aligned(self.data, lab.drop("horizon"), time=self.names["time"], instrument=self.names["instrument"], value=self.names["signal_value"])
        series = signal.ic_frame(panel, min_observations=min_observations).where("ic is not null")
        ends = lab.groupBy(F.col("observation_time").alias("time")).agg(F.min("label_start").alias("start"), F.max("label_end").alias("end"))
        kept, last = [], None
        for r in series.join(ends, "time").orderBy("time").collect():
            if last is None or r["start"] >= last:
                kept.append(r["ic"])
                last = r["end"]
        return kept

    def audit(self, *, horizon: str, quantiles: int = 5, lags: Sequence[int] = (1,), resamples: int = 1000, seed: int = 0) -> Evidence:
        """The standard diagnostics of the signal and the default rules over them."""
        self.labels()
        results = {"ic": self.ic(), "quantiles": self.quantiles(quantiles=quantiles), "turnover": self.turnover(quantiles=quantiles, lags=lags), "decay": self.decay(quantiles=quantiles)}
        if self.label_evidence is not None:
            results["labels"] = self.label_evidence
        series = self.independent_series(horizon)
        if len(series) >= 2:
            df = self.data.sparkSession.createDataFrame([(float(v),) for v in series], "value double")
            results["bootstrap"] = resample.bootstrap(df, method="iid", resamples=resamples, seed=seed)
        return audits.audit(results=results, policies={"study_type": "signal", "inference_horizon": horizon})
