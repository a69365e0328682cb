"""The recurrent part of the tagger as a graph for ONNX Runtime.

The graph holds `STEPS` steps of one direction, written out, from the state before them to the
emissions and the state after them.  The package that usually writes such graphs is not installed
here, so `_field` puts the few messages together that are needed (onnx.proto, wire format).
"""

from __future__ import annotations

import functools

import numpy as np

#: Steps of one call.
STEPS = 16
_TYPES = {"float32": 1, "int32": 6, "int64": 7}


def _number(x: int) -> bytes:
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def _field(no: int, x: int | str | bytes) -> bytes:
    if isinstance(x, int):
        return _number(no << 3) + _number(x)
    x = x.encode() if isinstance(x, str) else x
    return _number(no << 3 | 2) + _number(len(x)) + x


def _tensor(name: str, x: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in x.shape) + _field(2, _TYPES[x.dtype.name]) + _field(8, name) + _field(9, x.tobytes())


def _node(op: str, inputs: list[str], outputs: list[str], **options: int) -> bytes:
    out = b"".join(_field(1, x) for x in inputs) + b"".join(_field(2, x) for x in outputs) + _field(4, op)
    return out + b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in options.items())


def _port(name: str, kind: str, *dims: int | str) -> bytes:
    shape = b"".join(_field(1, _field(1 if isinstance(x, int) else 2, x)) for x in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, _TYPES[kind]) + _field(2, shape)))


def graph(table: np.ndarray, w: np.ndarray, wo: np.ndarray) -> bytes:
    """Inputs: ids [STEPS, B], h and c [B, hidden]; outputs: emissions [labels, STEPS * B], h, c."""
    n, k = wo.shape
    parts = (("s", slice(0, 3 * n)), ("g", slice(3 * n, 4 * n)))  # sigmoid of three gates, tanh of the fourth
    consts = [_tensor(name + gate, np.ascontiguousarray(x[:, cut])) for name, x in (("in_", table), ("w_", w)) for gate, cut in parts]
    consts += [_tensor("wo", np.ascontiguousarray(wo)), *(_tensor(f"at{t}", np.array(t, np.int64)) for t in range(STEPS))]
    nodes, h, c = [], "h", "c"
    for t in range(STEPS):
        x = lambda *names, t=t: [f"{name}{t}" for name in names]
        nodes += [
            _node("Gather", ["ids", f"at{t}"], x("id"), axis=0),
            *(
                node
                for gate, op in (("s", "Sigmoid"), ("g", "Tanh"))
                for node in (
                    _node("Gather", [f"in_{gate}", *x("id")], x("in" + gate), axis=0),
                    _node("Gemm", [h, f"w_{gate}", *x("in" + gate)], x("z" + gate)),
                    _node(op, x("z" + gate), x(gate)),
                )
            ),
            _node("Split", x("s"), x("i", "f", "o"), axis=1),
            _node("Mul", [*x("f"), c], x("kept")),
            _node("Mul", x("i", "g"), x("new")),
            _node("Add", x("kept", "new"), x("c")),
            _node("Tanh", x("c"), x("tc")),
            _node("Mul", x("o", "tc"), x("h")),
        ]
        (h,), (c,) = x("h"), x("c")
    nodes += [_node("Concat", [f"h{t}" for t in range(STEPS)], ["hidden"], axis=0), _node("Gemm", ["wo", "hidden"], ["e"], transA=1, transB=1)]
    state = lambda a, b: [_port(a, "float32", "B", n), _port(b, "float32", "B", n)]
    body = b"".join(_field(1, x) for x in nodes) + _field(2, "steps") + b"".join(_field(5, x) for x in consts)
    body += b"".join(_field(11, x) for x in [_port("ids", "int32", STEPS, "B"), *state("h", "c")])
    body += b"".join(_field(12, x) for x in [_port("e", "float32", k, "STEPS_B"), *state(h, c)])
    return _field(1, 8) + _field(7, body) + _field(8, _field(1, "") + _field(2, 13))


@functools.cache
def runtime():
    """The package, or None where it is not installed."""
    try:
        import onnxruntime
    except ImportError:
        return None
    return onnxruntime


class Emissions:
    """Emissions of `BiLstmCrf` as [labels, T, B] and without its tape; equal to about 1e-5."""

    def __init__(self, p: dict[str, np.ndarray]):
        ort = runtime()
        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        options.add_session_config_entry("session.set_denormal_as_zero", "1")
        self.n, self.bo, self.pad = p["wf"].shape[0], p["bo"], len(p["pf"])
        # one symbol more closes all gates, which keeps the state at 0: it stands where a window has ended
        shut = np.r_[np.full(3 * self.n, -1e4), np.zeros(self.n)].astype(np.float32)
        self.ways = [
            ort.InferenceSession(graph(np.vstack([p[table], shut]), p[w], wo), options, providers=["CPUExecutionProvider"])
            for table, w, wo in (("pf", "wf", p["wo"][: self.n]), ("pb", "wb", p["wo"][self.n :]))
        ]

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """A call takes the windows that reach into its steps, which are the first ones where the longest come first."""
        t_n, b = ids.shape
        blocks = -(-t_n // STEPS)
        own = np.full((blocks * STEPS, b), self.pad, np.int32)
        np.copyto(own[:t_n], ids, where=mask)
        width = [b - int(mask[x * STEPS : (x + 1) * STEPS, ::-1].any(0).argmax()) for x in range(blocks)]
        out = np.empty((len(self.bo), blocks * STEPS, b), np.float32)
        out[:] = self.bo[:, None, None]
        for back, way in enumerate(self.ways):
            h = c = np.zeros((0, self.n), np.float32)
            for x in range(blocks - 1, -1, -1) if back else range(blocks):
                m, at = width[x], slice(x * STEPS, (x + 1) * STEPS)
                h, c = ((np.concatenate([v, np.zeros((m - len(v), self.n), np.float32)]) if m > len(v) else v[:m]) for v in (h, c))
                e, h, c = way.run(None, {"ids": np.ascontiguousarray(own[at, :m][:: -1 if back else 1]), "h": h, "c": c})
                out[:, at, :m] += e.reshape(-1, STEPS, m)[:, :: -1 if back else 1]
        return out[:, :t_n]
