"""Steps of the character model as a graph for onnxruntime, where that is installed.

Without AVX-512 numpy takes the tangents of a step in several times the time of
everything else; the runtime takes them in a tenth of it. The graph is a few steps
of one direction, one after the other; it is written here in ONNX's encoding
(protocol buffers), so that no further package is needed.
"""

from __future__ import annotations

from functools import cache
from types import ModuleType

import numpy as np

#: Steps of a graph (more don't stay in the cache), and what padding adds to gates that are to be shut.
STEPS, SHUT = 8, -60.0
#: Numbers of ONNX: types of elements and of attributes, versions.
FLOAT, INT64, INT_ATTRIBUTE, IR_VERSION, OPSET = 1, 7, 2, 8, 18


@cache
def runtime() -> ModuleType | None:
    try:
        import onnxruntime
    except ImportError:
        return None
    return onnxruntime


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def _field(key: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _number(key << 3) + _number(value)
    raw = value.encode() if isinstance(value, str) else value
    return _number(key << 3 | 2) + _number(len(raw)) + raw


def _node(kind: str, inputs: list[str], outputs: list[str], **integers: int) -> bytes:
    attributes = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, INT_ATTRIBUTE)) for k, v in integers.items())
    return _field(1, b"".join(_field(1, x) for x in inputs) + b"".join(_field(2, x) for x in outputs) + _field(4, kind) + attributes)


def _constant(name: str, values: np.ndarray) -> bytes:
    kind = INT64 if values.dtype == np.int64 else FLOAT
    return _field(5, b"".join(_field(1, n) for n in values.shape) + _field(2, kind) + _field(8, name) + _field(9, values.tobytes()))


def _matrix(name: str, rows: int) -> bytes:
    """An input or output of so many rows and any number of columns."""
    shape = _field(1, _field(1, rows)) + _field(1, _field(2, "columns"))
    return _field(1, name) + _field(2, _field(1, _field(1, FLOAT) + _field(2, shape)))


def graph(gates: np.ndarray, told: np.ndarray, backward: bool) -> bytes:
    """STEPS steps over columns of windows, from the last place to the first if ``backward``.

    ``gates`` (4H, H + inputs) has the rows let, keep, show and new; ``told`` (tags, H).
    From ``x`` (STEPS * inputs rows, in order of place), ``h0`` and ``c0`` it makes
    ``y`` (STEPS * tags rows, in that order too) and the state and cell after the last step.
    """
    hidden = told.shape[1]
    inputs = gates.shape[1] - hidden
    places = range(STEPS - 1, -1, -1) if backward else range(STEPS)
    out = _node("Split", ["x"], [f"x{p}" for p in range(STEPS)], axis=0, num_outputs=STEPS)
    for t, place in enumerate(places):
        out += _node("Concat", [f"h{t}", f"x{place}"], [f"joint{t}"], axis=0) + _node("MatMul", ["gates", f"joint{t}"], [f"made{t}"])
        out += _node("Split", [f"made{t}"], [f"{gate}{t}" for gate in ("let", "keep", "show", "new")], axis=0, num_outputs=4)
        for gate, kind in (("let", "Sigmoid"), ("keep", "Sigmoid"), ("show", "Sigmoid"), ("new", "Tanh")):
            out += _node(kind, [f"{gate}{t}"], [f"{gate}_{t}"])
        out += _node("Mul", [f"keep_{t}", f"c{t}"], [f"kept{t}"]) + _node("Mul", [f"let_{t}", f"new_{t}"], [f"added{t}"]) + _node("Add", [f"kept{t}", f"added{t}"], [f"c{t + 1}"])
        out += _node("Tanh", [f"c{t + 1}"], [f"bent{t}"]) + _node("Mul", [f"bent{t}", f"show_{t}"], [f"h{t + 1}"]) + _node("MatMul", ["told", f"h{t + 1}"], [f"y{place}"])
    out += _node("Concat", [f"y{p}" for p in range(STEPS)], ["y"], axis=0) + _field(2, "steps")
    out += _constant("gates", np.ascontiguousarray(gates, np.float32)) + _constant("told", np.ascontiguousarray(told, np.float32))
    out += b"".join(_field(11, _matrix(name, rows)) for name, rows in (("x", STEPS * inputs), ("h0", hidden), ("c0", hidden)))
    out += b"".join(_field(12, _matrix(name, rows)) for name, rows in (("y", STEPS * len(told)), (f"h{STEPS}", hidden), (f"c{STEPS}", hidden)))
    return _field(1, IR_VERSION) + _field(7, out) + _field(8, _field(2, OPSET))


class Stepper:
    """The graphs of both directions; ``table`` (inputs, symbols) has what goes in for each symbol.

    Its rows are the embedding, one that tells padding and a constant. Padding shuts the
    gates of the backward direction, so its state stays zero until a window begins.
    """

    def __init__(self, embed: np.ndarray, project: np.ndarray, shift: np.ndarray, recurrent: np.ndarray, told: np.ndarray, pad: int) -> None:
        self.hidden = recurrent.shape[1]
        padding = (np.arange(len(embed)) == pad).astype(np.float32)
        self.table = np.ascontiguousarray(np.concatenate([embed.T, padding[None], np.ones((1, len(embed)))]), np.float32)
        options = runtime().SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        self.sessions = []
        for backward in (False, True):
            shut = np.zeros((4 * self.hidden, 1))
            shut[: 3 * self.hidden] = SHUT if backward else 0.0
            gates = np.concatenate([recurrent[backward * 1].T, project[backward * 1].T, shut, shift[backward * 1][:, None]], axis=1)
            self.sessions.append(runtime().InferenceSession(graph(gates, told[backward * 1], backward), options, providers=["CPUExecutionProvider"]))

    def run(self, backward: bool, looked: np.ndarray, state: np.ndarray, cell: np.ndarray) -> list[np.ndarray]:
        """What STEPS places (STEPS, inputs, columns) tell (STEPS, tags, columns), the state and the cell after them."""
        told, state, cell = self.sessions[backward].run(None, {"x": looked.reshape(-1, looked.shape[2]), "h0": state, "c0": cell})
        return [told.reshape(STEPS, -1, told.shape[1]), state, cell]
