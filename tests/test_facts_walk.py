"""The walk of a module passes by nodes that hold nothing."""

import ast

from siltstone.operators import code


def test_nodes_that_hold_nothing_are_not_walked(monkeypatch):
    seen, visit = [], ast.NodeVisitor.visit
    monkeypatch.setattr(ast.NodeVisitor, "visit", lambda self, node: (seen.append(type(node)), visit(self, node))[1])
    facts = code.Facts()
    facts.visit(ast.parse("def f(a):\n    b = a + 1\n    return not b\n    c = 2\n"))
    assert ast.Name in seen and not any(issubclass(t, code.BARE) for t in seen)
    assert {r[0] for r in facts.rows} >= {"def", "unreachable"} and {r[1] for r in facts.rows if r[0] == "use"} == {"a", "b", "c"}
