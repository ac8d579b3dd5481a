"""Syntax trees as rows: a generic tree model, Python sources to node rows, and fingerprints of subtrees."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Generic kinds by Python node; other nodes are Unknown(name).
KINDS = {
    "Module": "Module",
    "FunctionDef": "Function",
    "AsyncFunctionDef": "Function",
    "ClassDef": "Class",
    "If": "If",
    "For": "For",
    "AsyncFor": "For",
    "While": "While",
    "Try": "Try",
    "With": "With",
    "AsyncWith": "With",
    "Return": "Return",
    "Assign": "Assignment",
    "AnnAssign": "Assignment",
    "AugAssign": "Assignment",
    "Call": "Call",
    "BinOp": "BinaryOp",
    "UnaryOp": "UnaryOp",
    "Name": "Identifier",
    "Constant": "Literal",
    "Import": "Import",
    "ImportFrom": "Import",
}


class ParseError(ValueError):
    """A source is no valid program."""


@dataclass(frozen=True)
class Span:
    start: int = 0
    end: int = 0
    line_start: int = 0
    line_end: int = 0
    column_start: int = 0
    column_end: int = 0

    def __len__(self) -> int:
        return self.end - self.start

    def is_empty(self) -> bool:
        return self.start == self.end


@dataclass(frozen=True)
class Node:
    id: int
    kind: str
    span: Span = Span()
    children: tuple[int, ...] = ()
    text: str | None = None

    def with_text(self, text: str) -> Node:
        return replace(self, text=text)

    def with_children(self, *children: int) -> Node:
        return replace(self, children=tuple(children))


@dataclass
class Tree:
    """Nodes by position: a node's id is its place."""

    source: str = ""
    root: int = 0
    nodes: list[Node] = field(default_factory=list)

    def add(self, node: Node) -> int:
        self.nodes.append(replace(node, id=len(self.nodes)))
        return len(self.nodes) - 1

    def get(self, at: int) -> Node | None:
        return self.nodes[at] if 0 <= at < len(self.nodes) else None

    def put(self, at: int, node: Node) -> None:
        self.nodes[at] = replace(node, id=at)


def parse(source: str, name: str = "") -> Tree:
    """The tree of a Python module; offsets count characters of a line-start table."""
    try:
        top = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        raise ParseError(str(e)) from e
    lines = source.split("\n")
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    raw = [line.encode() for line in lines]
    tree = Tree(name)

    def visit(node: ast.AST) -> int:
        kind = KINDS.get(type(node).__name__, f"Unknown({type(node).__name__})")
        span = Span(0, len(source), 1, len(lines), 0, len(lines[-1]))
        if hasattr(node, "lineno"):
            a, b = (len(raw[r - 1][:c].decode()) for r, c in ((node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset)))
            span = Span(begins[node.lineno - 1] + a, begins[node.end_lineno - 1] + b, node.lineno, node.end_lineno, a, b)
        text = getattr(node, "id", None) or getattr(node, "name", None) or (repr(node.value) if isinstance(node, ast.Constant) else None)
        at = tree.add(Node(0, kind, span, (), text if isinstance(text, str) else None))
        below = [visit(c) for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop))]
        tree.put(at, tree.nodes[at].with_children(*below))
        return at

    visit(top)
    return tree


NODES = "file_id long, node_id int, parent_id int, kind string, start long, end long, line_start int, line_end int, column_start int, column_end int, children array<int>, text string, subtree string, size int"


def python_nodes(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """A row for each node, with a fingerprint of its subtree (kinds only, so renamed copies are equal) and its size."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in NODES.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for key, content in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                try:
                    tree = parse(content or "")
                except ParseError:
                    if on_error == "fail":
                        raise
                    continue
                up = {c: n.id for n in tree.nodes for c in n.children}
                print_, size = {}, {}
                for n in reversed(tree.nodes):  # children come after their parent
                    size[n.id] = 1 + sum(size[c] for c in n.children)
                    print_[n.id] = hashlib.md5((n.kind + "(" + ",".join(print_[c] for c in n.children) + ")").encode()).hexdigest()
                rows = [(key, n.id, up.get(n.id), n.kind, n.span.start, n.span.end, n.span.line_start, n.span.line_end, n.span.column_start, n.span.column_end, list(n.children), n.text, print_[n.id], size[n.id]) for n in tree.nodes]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file_id", "content").mapInArrow(run, NODES)


def subtree_groups(nodes: DataFrame, min_size: int = 10) -> DataFrame:
    """(subtree, n, size) of subtrees of min_size nodes or more that occur more than once."""
    return nodes.where(F.col("size") >= min_size).groupBy("subtree").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n > 1")
