"""Small dense networks in numpy: forward and backward passes, squared loss, and Adam steps. A trained network becomes a
column by `Network.column`, so that scoring stays in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.algebra import activation

_F = {
    "relu": (lambda z: np.maximum(z, 0), lambda z: (z > 0).astype(float)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda z: np.exp(-z) / (1 + np.exp(-z)) ** 2),
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
    "identity": (lambda z: z, np.ones_like),
}


class Dense:
    def __init__(self, inputs: int, outputs: int, kind: str = "relu", seed: int = 0):
        g = np.random.default_rng(seed)
        self.w, self.b, self.kind = g.normal(size=(inputs, outputs)) * np.sqrt(2 / inputs), np.zeros(outputs), kind

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x, self.z = x, x @ self.w + self.b
        return _F[self.kind][0](self.z)

    def backward(self, slope: np.ndarray) -> np.ndarray:
        """Slopes by the inputs; those by weights and biases stay in dw and db."""
        s = slope * _F[self.kind][1](self.z)
        self.dw, self.db = self.x.T @ s, s.sum(0)
        return s @ self.w.T


def squared_loss(y: np.ndarray, want: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean of squares, and its slope by y."""
    return float(((y - want) ** 2).mean()), 2 * (y - want) / y.size


class Network:
    def __init__(self, *layers: Dense):
        self.layers, self.moments, self.steps = list(layers), {}, 0

    def add(self, layer: Dense) -> Network:
        self.layers.append(layer)
        return self

    def forward(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def backward(self, slope: np.ndarray) -> np.ndarray:
        for layer in reversed(self.layers):
            slope = layer.backward(slope)
        return slope

    def adam(self, rate: float = 0.01) -> None:
        """One step along the slopes of the last backward pass."""
        self.steps += 1
        for k, layer in enumerate(self.layers):
            for name in ("w", "b"):
                g = getattr(layer, f"d{name}")
                m, v = self.moments.get((k, name), (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.moments[k, name] = m, v
                setattr(layer, name, getattr(layer, name) - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8))

    def column(self, *inputs: Column) -> list[Column]:
        x = list(inputs)
        for layer in self.layers:
            new = []
            for j in range(layer.w.shape[1]):
                z = F.lit(float(layer.b[j]))
                for i, c in enumerate(x):
                    z = z + float(layer.w[i, j]) * c
                new.append(activation(layer.kind, z))
            x = new
        return x
