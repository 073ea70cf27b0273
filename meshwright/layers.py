"""Layer definitions, models and their builder: checked when made, without Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol, runtime_checkable

from meshwright.matrix import DenseMatrix, as_matrix

# The messages of invalid layers and models.
NO_NEIGHBOUR_WEIGHTS = "W_neigh cannot be empty"
BAD_BIAS = "bias dimension must match out_dim"
BAD_SELF = "W_self dimensions must match W_neigh dimensions"
NO_NODE_WEIGHTS = "W_node cannot be empty"
BAD_MODEL = "Layer dimension mismatch in GNNModel pipeline."
BAD_BUILD = "Layer dimension mismatch in GNNBuilder pipeline."


class Aggregation(Enum):
    SUM = "sum"
    MEAN = "mean"
    GCN_NORM = "gcn_norm"
    MAX = "max"

    @property
    def linear(self) -> bool:
        """Whether transforming before aggregating gives the same."""
        return self is not Aggregation.MAX


class Activation(Enum):
    NONE = "none"
    RELU = "relu"
    SIGMOID = "sigmoid"


def _checked(weights, bias, message: str = NO_NEIGHBOUR_WEIGHTS) -> tuple[DenseMatrix, tuple[float, ...]]:
    w, b = as_matrix(weights), tuple(float(x) for x in bias)
    if w.empty:
        raise ValueError(message)
    if b and len(b) != w.cols:
        raise ValueError(BAD_BIAS)
    return w, b


@dataclass(frozen=True, eq=False)
class GCNLayer:
    """z = gcn_norm(h) W + b. `self_loops` adds (v, v) to every neighbourhood and degree."""

    w_neigh: DenseMatrix
    bias: tuple[float, ...] = ()
    activation: Activation = Activation.NONE
    self_loops: bool = True
    aggregation: Aggregation = field(default=Aggregation.GCN_NORM, init=False)
    needs_edge_features = False

    def __post_init__(self):
        w, b = _checked(self.w_neigh, self.bias)
        object.__setattr__(self, "w_neigh", w)
        object.__setattr__(self, "bias", b)

    @property
    def in_dim(self) -> int:
        return self.w_neigh.rows

    @property
    def out_dim(self) -> int:
        return self.w_neigh.cols

    @property
    def has_bias(self) -> bool:
        return bool(self.bias)


@dataclass(frozen=True, eq=False)
class GraphSAGELayer:
    """z = h W_self + aggregate(h) W_neigh + aggregate(efeat) W_edge + b, without the terms that have no matrix.

    W_edge makes it a layer that needs edge features; the normalised aggregation has no such form.
    """

    w_neigh: DenseMatrix
    w_self: DenseMatrix | None = None
    bias: tuple[float, ...] = ()
    aggregation: Aggregation = Aggregation.MEAN
    activation: Activation = Activation.NONE
    self_loops: bool = True  # of GCN_NORM only
    w_edge: DenseMatrix | None = None

    def __post_init__(self):
        w, b = _checked(self.w_neigh, ())
        object.__setattr__(self, "w_neigh", w)
        if self.w_edge is not None:
            edge = as_matrix(self.w_edge)
            if edge.empty or edge.cols != w.cols or self.aggregation is Aggregation.GCN_NORM:
                raise ValueError("W_edge must have out_dim columns, and an aggregation other than GCN_NORM")
            object.__setattr__(self, "w_edge", edge)
        if self.w_self is not None:
            own = as_matrix(self.w_self)
            if (own.rows, own.cols) != (w.rows, w.cols):
                raise ValueError(BAD_SELF)
            object.__setattr__(self, "w_self", own)
        object.__setattr__(self, "bias", _checked(w, self.bias)[1])

    @classmethod
    def from_concat(cls, weights, **more) -> GraphSAGELayer:
        """The layer of concat(h, m) W, with W (2 F x out) holding W_self above W_neigh."""
        w = as_matrix(weights)
        if w.rows % 2:
            raise ValueError(BAD_SELF)
        half = w.rows // 2
        return cls(DenseMatrix(w.values[half:]), DenseMatrix(w.values[:half]), **more)

    @property
    def in_dim(self) -> int:
        return self.w_neigh.rows

    @property
    def out_dim(self) -> int:
        return self.w_neigh.cols

    @property
    def has_bias(self) -> bool:
        return bool(self.bias)

    @property
    def needs_edge_features(self) -> bool:
        return self.w_edge is not None

    @property
    def has_w_self(self) -> bool:
        return self.w_self is not None

    def self_weights(self) -> DenseMatrix:
        if self.w_self is None:
            raise LookupError("the layer has no W_self")
        return self.w_self


@dataclass(frozen=True, eq=False)
class EGATLayer:
    """Attention over incoming edges with edge features; W_attn is (3 out/heads) x heads."""

    w_node: DenseMatrix
    w_edge: DenseMatrix
    w_attn: DenseMatrix
    heads: int = 1
    activation: Activation = Activation.NONE
    slope: float = 0.2
    needs_edge_features = True

    def __post_init__(self):
        w, _ = _checked(self.w_node, (), NO_NODE_WEIGHTS)
        edge, attn = as_matrix(self.w_edge), as_matrix(self.w_attn)
        if self.heads < 1 or w.cols % self.heads:
            raise ValueError("num_heads must be positive and divide out_dim")
        if edge.cols != w.cols:
            raise ValueError("W_edge must have out_dim columns")
        if (attn.rows, attn.cols) != (3 * w.cols // self.heads, self.heads):
            raise ValueError("W_attn must be 3 out_dim / num_heads by num_heads")
        for name, x in (("w_node", w), ("w_edge", edge), ("w_attn", attn)):
            object.__setattr__(self, name, x)

    @property
    def in_dim(self) -> int:
        return self.w_node.rows

    @property
    def out_dim(self) -> int:
        return self.w_node.cols


Layer = GCNLayer | GraphSAGELayer | EGATLayer
KNOWN_LAYERS = (GCNLayer, GraphSAGELayer, EGATLayer)


def _follows(before: Layer, after: Layer, message: str) -> None:
    if before.out_dim != after.in_dim:
        raise ValueError(message)


@dataclass(frozen=True, eq=False)
class GNNModel:
    """Layers whose dimensions fit; without any it leaves features as they are."""

    layers: tuple[Layer, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "layers", tuple(self.layers))
        for a, b in zip(self.layers, self.layers[1:], strict=False):
            _follows(a, b, BAD_MODEL)

    def __len__(self) -> int:
        return len(self.layers)

    @property
    def empty(self) -> bool:
        return not self.layers

    def layer(self, i: int) -> Layer:
        if not 0 <= i < len(self.layers):
            raise IndexError(f"no layer {i}")
        return self.layers[i]

    @property
    def input_dim(self) -> int:
        return self.layers[0].in_dim if self.layers else 0

    @property
    def output_dim(self) -> int:
        return self.layers[-1].out_dim if self.layers else 0

    @property
    def needs_edge_features(self) -> bool:
        return any(x.needs_edge_features for x in self.layers)


@runtime_checkable
class SupportsLayers(Protocol):
    supported_layers: tuple[type, ...]


class GNNBuilder:
    """Collects layers that the engine can run and that fit each other."""

    def __init__(self, engine: SupportsLayers, allowed: tuple[type, ...] = KNOWN_LAYERS):
        if not isinstance(engine, SupportsLayers):
            raise TypeError("the engine does not say which layers it supports")
        self._usable = tuple(t for t in allowed if t in engine.supported_layers)
        self._layers: list[Layer] = []

    def add(self, layer: Layer) -> GNNBuilder:
        if type(layer) not in self._usable:
            raise TypeError(f"{type(layer).__name__} is not supported here")
        if self._layers:
            _follows(self._layers[-1], layer, BAD_BUILD)
        self._layers.append(layer)
        return self

    def add_gcn(self, *args, **more) -> GNNBuilder:
        return self.add(GCNLayer(*args, **more))

    def add_sage(self, *args, **more) -> GNNBuilder:
        return self.add(GraphSAGELayer(*args, **more))

    def add_egat(self, *args, **more) -> GNNBuilder:
        return self.add(EGATLayer(*args, **more))

    def build(self) -> GNNModel:
        """The model; the builder is empty afterwards."""
        done, self._layers = self._layers, []
        return GNNModel(tuple(done))
