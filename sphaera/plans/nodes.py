"""Node graphs: named steps with typed inputs, composed into one lazy DataFrame plan."""

from __future__ import annotations

from collections.abc import Mapping

from ..operators.fields import Field, mask, math

#: type -> inputs and the function of (params, inputs).
NODES = {
    "math": (("a", "b"), lambda p, i: math(p.get("op", "add"), i["a"], i["b"], p.get("ka", 1.0), p.get("kb", 1.0))),
    "mask": (("a",), lambda p, i: mask(i["a"], p["threshold"], p.get("smooth", 0.0), p.get("invert", False))),
}


def order(graph: Mapping[str, Mapping]) -> list[str]:
    """Nodes after their inputs; an error for unknown types, references, missing inputs and cycles."""
    for name, node in graph.items():
        if node["type"] != "source" and node["type"] not in NODES:
            raise ValueError(f"{name}: unknown type {node['type']!r}")
        if node["type"] != "source" and (missing := set(NODES[node["type"]][0]) - set(node.get("inputs", {}))):
            raise ValueError(f"{name}: no input for {', '.join(sorted(missing))}")
        for ref in node.get("inputs", {}).values():
            if ref not in graph:
                raise ValueError(f"{name}: unknown input {ref!r}")
    done: list[str] = []
    while len(done) < len(graph):
        ready = [n for n in graph if n not in done and all(r in done for r in graph[n].get("inputs", {}).values())]
        if not ready:
            raise ValueError("cycle: " + ", ".join(n for n in graph if n not in done))
        done += ready
    return done


def run_graph(graph: Mapping[str, Mapping], sources: Mapping[str, Field]) -> dict[str, Field]:
    """The fields of all nodes; nothing runs until one of them is asked for, and Catalyst sees the whole of it."""
    out: dict[str, Field] = {}
    for name in order(graph):
        node = graph[name]
        if node["type"] == "source":
            out[name] = sources[node["source"]]
        else:
            out[name] = NODES[node["type"]][1](node.get("params", {}), {k: out[r] for k, r in node["inputs"].items()})
    return out
