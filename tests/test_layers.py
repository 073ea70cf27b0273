"""Matrices, layers, models and the builder: validation and accessors."""

import pytest

from meshwright.layers import Activation, Aggregation, EGATLayer, GCNLayer, GNNBuilder, GNNModel, GraphSAGELayer
from meshwright.matrix import DenseMatrix
from meshwright.plans.engine import SparkEngine

TWO = [[1, 2, 3], [4, 5, 6]]


def test_matrix_constructors_and_access():
    m = DenseMatrix.from_rows(TWO)
    assert (m.rows, m.cols, m.empty, m.data) == (2, 3, False, [1, 2, 3, 4, 5, 6])
    assert m[1, 2] == 6 and m[0] == m.row(0) == [1, 2, 3] and m.at(1, 0) == 4
    assert DenseMatrix.from_flat(2, 3, [1, 2, 3, 4, 5, 6]) == m
    assert DenseMatrix.full(1, 2, 7).data == [7, 7]
    assert DenseMatrix.blank().empty and DenseMatrix.from_rows([]).rows == 0
    hollow = DenseMatrix.from_rows([[], []])
    assert (hollow.rows, hollow.cols, hollow.empty) == (2, 0, True)


def test_matrix_errors():
    with pytest.raises(ValueError, match="DenseMatrix dimension mismatch with data size."):
        DenseMatrix.from_flat(2, 3, [1])
    with pytest.raises(ValueError, match="DenseMatrix constructor requires all rows to have equal length."):
        DenseMatrix.from_rows([[1], [1, 2]])
    for where in ((2, 0), (0, 3), (-1, 0)):
        with pytest.raises(IndexError, match="DenseMatrix::at out of bounds"):
            DenseMatrix.from_rows(TWO).at(*where)


@pytest.mark.parametrize("layer", [GCNLayer, GraphSAGELayer])
def test_layer_errors(layer):
    with pytest.raises(ValueError, match="W_neigh cannot be empty"):
        layer([])
    with pytest.raises(ValueError, match="bias dimension must match out_dim"):
        layer(TWO, bias=(1.0,))


def test_layer_accessors():
    g = GCNLayer(TWO, (1, 2, 3), Activation.RELU)
    assert (g.in_dim, g.out_dim, g.has_bias, g.aggregation, g.needs_edge_features) == (2, 3, True, Aggregation.GCN_NORM, False)
    s = GraphSAGELayer(TWO)
    assert s.aggregation is Aggregation.MEAN and not s.has_w_self and not s.has_bias
    with pytest.raises(LookupError):
        s.self_weights()
    for bad in ([[1, 2, 3]], []):
        with pytest.raises(ValueError, match="W_self dimensions must match W_neigh dimensions"):
            GraphSAGELayer(TWO, bad)
    split = GraphSAGELayer.from_concat([[1, 2], [3, 4], [5, 6], [7, 8]])
    assert split.self_weights().data == [1, 2, 3, 4] and split.w_neigh.data == [5, 6, 7, 8]


def test_attention_layer_checks():
    with pytest.raises(ValueError, match="W_node cannot be empty"):
        EGATLayer([], [[1]], [[1]])
    ok = EGATLayer([[1, 2]], [[1, 2]], [[1, 2]] * 3, 2)
    assert ok.needs_edge_features and (ok.in_dim, ok.out_dim) == (1, 2)
    for heads, attn, edge in ((0, [[1]] * 3, [[1, 2]]), (3, [[1]] * 3, [[1, 2]]), (1, [[1]] * 5, [[1, 2]]), (1, [[1]] * 6, [[1]])):
        with pytest.raises(ValueError):
            EGATLayer([[1, 2]], edge, attn, heads)


def test_model_and_builder():
    a, b = GCNLayer([[1, 2, 3]] * 2), GraphSAGELayer([[1, 2]] * 4)
    with pytest.raises(ValueError, match="Layer dimension mismatch in GNNModel pipeline."):
        GNNModel((a, b))
    builder = GNNBuilder(SparkEngine()).add(a)
    with pytest.raises(ValueError, match="Layer dimension mismatch in GNNBuilder pipeline."):
        builder.add(b)
    model = builder.add_sage([[1], [2], [3]]).build()
    assert (len(model), model.input_dim, model.output_dim, model.empty, model.needs_edge_features) == (2, 2, 1, False, False)
    assert builder.build().empty
    assert model.layer(0) is a
    for i in (2, -1):
        with pytest.raises(IndexError):
            model.layer(i)
    assert GNNModel().input_dim == GNNModel().output_dim == 0
    with pytest.raises(TypeError):
        GNNBuilder(SparkEngine(), allowed=(GraphSAGELayer,)).add(a)
    with pytest.raises(TypeError):
        GNNBuilder(object())
    assert GNNBuilder(SparkEngine()).add_gcn([[1, 2]]).add_egat([[1], [1]], [[1]], [[1]] * 3).build().needs_edge_features
