"""Models as exchanged graphs (K12): encoder, quantizer and coarse probe written in the public ONNX format, so that any runtime of
it computes what the operators do. Only the few messages of the format that these graphs need are written; numbers are 32-bit floats."""

from __future__ import annotations

import numpy as np

from ..operators.encoder import LinearEncoder, MlpEncoder
from ..operators.ivf import IvfPqIndex
from ..operators.pq import ProductQuantizer

#: Element types, attribute types and versions of the format (fixed values).
FLOAT, UINT8, INT32, INT64 = 1, 2, 6, 7
_KINDS = {np.dtype("<f4"): FLOAT, np.dtype("<i8"): INT64, np.dtype("<i4"): INT32}
_ATTR_INT, _ATTR_INTS = 2, 7
IR_VERSION, OPSET = 7, 13


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, value: np.ndarray) -> bytes:
    value = np.ascontiguousarray(value)
    dims = b"".join(_number(1, n) for n in value.shape)
    return dims + _number(2, _KINDS[value.dtype]) + _bytes(8, name) + _bytes(9, value.tobytes())


def _declared(name: str, kind: int, shape: list[int | str]) -> bytes:
    dims = b"".join(_bytes(1, _number(1, n) if isinstance(n, int) else _bytes(2, n)) for n in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, dims)))


class Graph:
    """Nodes in order of their computation."""

    def __init__(self, name: str):
        self.name, self.nodes, self.constants, self.inputs, self.outputs, self.n = name, [], [], [], [], 0

    def input(self, name: str, kind: int, shape: list[int | str]) -> str:
        self.inputs.append(_declared(name, kind, shape))
        return name

    def constant(self, value, dtype: str = "<f4") -> str:
        self.n += 1
        self.constants.append(_tensor(f"c{self.n}", np.asarray(value, dtype)))
        return f"c{self.n}"

    def node(self, op: str, *inputs: str, outputs: tuple[str, ...] | None = None, **attributes) -> str:
        self.n += 1
        outputs = outputs or (f"t{self.n}",)
        body = b"".join(_bytes(1, i) for i in inputs) + b"".join(_bytes(2, o) for o in outputs) + _bytes(3, f"n{self.n}") + _bytes(4, op)
        for key, value in attributes.items():
            if isinstance(value, int):
                body += _bytes(5, _bytes(1, key) + _number(3, value) + _number(20, _ATTR_INT))
            else:
                body += _bytes(5, _bytes(1, key) + b"".join(_number(8, v) for v in value) + _number(20, _ATTR_INTS))
        self.nodes.append(body)
        return outputs[0]

    def output(self, name: str, kind: int, shape: list[int | str]) -> None:
        self.outputs.append(_declared(name, kind, shape))

    def model(self) -> bytes:
        graph = b"".join(_bytes(1, n) for n in self.nodes) + _bytes(2, self.name) + b"".join(_bytes(5, c) for c in self.constants)
        graph += b"".join(_bytes(11, i) for i in self.inputs) + b"".join(_bytes(12, o) for o in self.outputs)
        return _number(1, IR_VERSION) + _bytes(2, "annolith") + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, OPSET))


def _normalised(g: Graph, x: str, total: float = 1e4) -> str:
    """ln(1 + value * total / row sum); a row sum of 0 counts as 1."""
    s = g.node("ReduceSum", x, g.constant([1], "<i8"), keepdims=1)
    s = g.node("Where", g.node("Equal", s, g.constant(0.0)), g.constant(1.0), s)
    return g.node("Log", g.node("Add", g.node("Div", g.node("Mul", x, g.constant(total)), s), g.constant(1.0)))


def encoder_graph(encoder: LinearEncoder | MlpEncoder) -> bytes:
    """input (batch x genes, raw counts) to output (batch x dimensions)."""
    g = Graph("encoder")
    x = g.input("input", FLOAT, ["batch", encoder.n_genes])
    if isinstance(encoder, LinearEncoder):
        layers = [(encoder.weights, None)]
        y = _normalised(g, x) if encoder.normalise else x
    else:
        layers, y = list(encoder.layers), _normalised(g, x)
    for i, (w, b) in enumerate(layers):
        y = g.node("MatMul", y, g.constant(w))
        if b is not None:
            y = g.node("Add", y, g.constant(b))
        if i < len(layers) - 1:
            y = g.node("Relu", y)
    if encoder.unit:
        y = g.node("Div", y, g.node("Max", g.node("ReduceL2", y, axes=[1], keepdims=1), g.constant(1e-12)))
    g.node("Identity", y, outputs=("output",))
    g.output("output", FLOAT, ["batch", int(np.shape(layers[-1][0])[1])])
    return g.model()


def quantizer_graph(pq: ProductQuantizer) -> bytes:
    """vectors (batch x d) to codes (batch x m, integers)."""
    g = Graph("quantizer")
    x = g.input("vectors", FLOAT, ["batch", pq.d])
    parts = g.node("Reshape", x, g.constant([-1, pq.m, 1, pq.d_sub], "<i8"))
    words = g.constant(np.where(np.isfinite(pq.codebook), pq.codebook, 1e18)[None])  # words that a subspace lacks are never chosen
    gap = g.node("Sub", parts, words)
    dist = g.node("ReduceSum", g.node("Mul", gap, gap), g.constant([3], "<i8"), keepdims=0)
    g.node("ArgMin", dist, outputs=("codes",), axis=2, keepdims=0)
    g.output("codes", INT64, ["batch", pq.m])
    return g.model()


def probe_graph(d: int) -> bytes:
    """query_vector (d), partition_centroids (any number x d), k to top_k_indices and top_k_distances, nearest first."""
    g = Graph("coarse_probe")
    q, c, k = g.input("query_vector", FLOAT, [d]), g.input("partition_centroids", FLOAT, ["num_centroids", d]), g.input("k", INT32, [])
    gap = g.node("Sub", c, q)
    dist = g.node("Sqrt", g.node("ReduceSum", g.node("Mul", gap, gap), g.constant([1], "<i8"), keepdims=0))
    many = g.node("Reshape", g.node("Cast", k, to=INT64), g.constant([1], "<i8"))
    g.node("TopK", dist, many, outputs=("top_k_distances", "places"), axis=0, largest=0, sorted=1)
    g.node("Cast", "places", outputs=("top_k_indices",), to=INT32)
    g.output("top_k_indices", INT32, ["k"])
    g.output("top_k_distances", FLOAT, ["k"])
    return g.model()


def distance_graph(pq: ProductQuantizer) -> bytes:
    """query_vector (d), reference_codes (any number x m, bytes), codebooks (m x words x d / m) to indices and distances of all codes, nearest first."""
    g = Graph("distances")
    q, codes = g.input("query_vector", FLOAT, [pq.d]), g.input("reference_codes", UINT8, ["n_references", pq.m])
    words = g.input("codebooks", FLOAT, [pq.m, pq.k, pq.d_sub])
    gap = g.node("Sub", words, g.node("Reshape", q, g.constant([pq.m, 1, pq.d_sub], "<i8")))
    table = g.node("ReduceSum", g.node("Mul", gap, gap), g.constant([2], "<i8"), keepdims=0)
    each = g.node("GatherElements", table, g.node("Transpose", g.node("Cast", codes, to=INT64), perm=[1, 0]), axis=1)
    dist = g.node("Sqrt", g.node("ReduceSum", each, g.constant([0], "<i8"), keepdims=0))
    g.node("TopK", dist, g.node("Shape", dist), outputs=("distances", "indices"), axis=0, largest=0, sorted=1)
    g.output("indices", INT64, ["k_out"])
    g.output("distances", FLOAT, ["k_out"])
    return g.model()


def write_graphs(spark, folder: str, index: IvfPqIndex, encoder: LinearEncoder | MlpEncoder | None = None) -> None:
    """pq_encode.onnx, pq_distance.onnx and ivf_coarse.onnx of an index, and model.onnx of an encoder."""
    from .writers import _put

    _put(spark, f"{folder}/pq_encode.onnx", quantizer_graph(index.pq))
    _put(spark, f"{folder}/pq_distance.onnx", distance_graph(index.pq))
    _put(spark, f"{folder}/ivf_coarse.onnx", probe_graph(index.dimensions))
    if encoder is not None:
        _put(spark, f"{folder}/model.onnx", encoder_graph(encoder))
