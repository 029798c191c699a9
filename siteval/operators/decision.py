"""Constants of a fitted decision layer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from siteval.functions import probs as P


@dataclass
class Layer:
    """Fitted constants: standardisation, coefficients and intercepts. A class absent from the data has intercept -inf."""

    mean: list[float]
    scale: list[float]
    coef: list[list[float]]
    intercept: list[float]
    C: float
    base: "Layer | None" = None
    #: largest mean gradient at the end of the fit, where it is known
    gradient: float | None = None

    def input(self, x: Column) -> Column:
        """What the layer's own coefficients see: the features, or the centred logits of the base layer."""
        return P.centred_logits(x, self.base) if self.base else x

    def proba(self, x: Column) -> Column:
        return P.softmax_linear(self.input(x), self)
