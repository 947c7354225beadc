"""Facts of Python sources: entities, imports, bases, calls, parameter types and global names, one row each.

Each file is parsed once by the standard library's parser inside mapInArrow; files are independent, so this scales with
their number.  What types can be known inside one file (assignments, annotations, attributes) is settled here, and so is
what its own entities answer: s_* is the entity that a fact's scope names, t_* the one that its chain (or global name)
names, the first of the file in each case.  Other names are resolved against the whole repository afterwards, by joins.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FACTS = (
    "fact string, file_path string, seq long, kind string, name string, parent_name string, parent_type string, "
    "scope string, chain string, via string, module string, description string, content string, complexity int, "
    "is_exported boolean, flag boolean, line int, col int, list array<string>, "
    "s_kind string, s_name string, s_parent string, t_seq long, t_kind string, t_name string, t_parent string"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in FACTS.split(", "))])
BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.IfExp)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.ClassDef)


def masked(text: str) -> str:
    """Names from outside ASCII in plain letters: x for letters, 0 for digits, _ for the rest, white space as it is."""
    if text.isascii():
        return text
    swap = lambda c: c if c.isascii() or c.isspace() else "x" if c.isalpha() else "0" if c.isdigit() else "_"
    return "".join(map(swap, text))


def complexity(node: ast.AST) -> int:
    """1 and one for each branch, loop, conditional expression and further operand of and/or; elif counts with its if."""
    total = 1
    for x in ast.walk(node):
        if isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        elif isinstance(x, BRANCHES):
            total += 1
            if isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and x.orelse[0].col_offset == x.col_offset:
                total -= 1
    return total


def header(text: str) -> str:
    """The comment lines that open a file."""
    out = []
    for line in text.split("\n"):
        if line.startswith("#"):
            out.append(line.lstrip("#").strip())
        elif line.strip():
            break
    return "\n".join(out)


def dotted(node: ast.AST) -> list[str] | None:
    """Parts of a.b.c, or None for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [*parts, node.id][::-1] if isinstance(node, ast.Name) else None


def bare(chain: str) -> str:
    """A chain without the rest of its line from a bracket on; lines end where Java's patterns end them."""
    return re.sub("\\[[^\n\r\x85\u2028\u2029]*", "", chain) if "[" in chain else chain


def constructed(value: ast.AST | None) -> str | None:
    """Name of the class or function whose call gives a value, also inside brackets, operators and comprehensions."""
    if isinstance(value, ast.Call):
        parts = dotted(value.func)
        return ".".join(parts) if parts else None
    if isinstance(value, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
        return constructed(value.elt)
    if isinstance(value, ast.BinOp):
        return constructed(value.left) or constructed(value.right)
    if isinstance(value, ast.IfExp):
        return constructed(value.body) or constructed(value.orelse)
    if isinstance(value, ast.Await):
        return constructed(value.value)
    return None


class FileFacts(ast.NodeVisitor):
    """Collects the facts of one file; scopes are the enclosing classes and functions."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.rows, self.scopes = path, text, [], []
        self.imports: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.attributes: dict[tuple[str, str], str] = {}
        self.parameters: dict[tuple[str, str], str] = {}
        self.returns: dict[str, str] = {}
        self.methods: dict[str, str] = {}
        self.bases: dict[str, list[str]] = {}
        self.globals: set[str] = set()

    def add(self, fact: str, node: ast.AST | None = None, **values) -> None:
        line = getattr(node, "lineno", 0)
        col = getattr(node, "col_offset", -1)
        if line and col > 0:
            col = len(self.lines[line - 1].encode()[:col].decode(errors="ignore"))
        self.rows.append({"fact": fact, "file_path": self.path, "seq": len(self.rows), "line": line, "col": col + 1, **values})

    def source(self, node: ast.AST) -> str:
        """ast.get_source_segment() over lines that are cut once a file."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.segments[first][node.col_offset : node.end_col_offset].decode()
        lines = self.segments[first : last + 1]
        return b"".join([lines[0][node.col_offset :], *lines[1:-1], lines[-1][: node.end_col_offset]]).decode()

    @property
    def scope(self) -> str:
        return ".".join(n for n, _ in self.scopes)

    @property
    def owner(self) -> str:
        return next((n for n, t in reversed(self.scopes) if t == "Class"), "")

    def run(self) -> list[dict]:
        try:
            tree = ast.parse(masked(self.text))
        except (SyntaxError, ValueError) as e:
            self.add("error", description=str(e))
            self.add("file", kind="File", description=header(self.text), content=self.text)
            return self.rows
        self.text = masked(self.text)
        self.lines = self.text.split("\n")
        self.segments = [x.encode() for x in re.findall("[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$", self.text)]
        self.add("file", kind="File", description=header(self.text), content=self.text)
        self.declare(tree)
        self.visit(tree)
        self.settle()
        return self.rows

    def settle(self) -> None:
        """Scopes, chains and global names that entities of this file answer."""
        entities: dict[str, dict] = {}
        variables: dict[str, dict] = {}
        for r in self.rows:
            if r["fact"] == "entity":
                parent = r["parent_name"].replace("/", ".")
                entities.setdefault(f"{parent}.{r['name']}" if parent else r["name"], r)
                if r["kind"] == "Variable":
                    variables.setdefault(r["name"], r)
        for r in self.rows:
            fact = r["fact"]
            if fact in ("file", "entity", "error"):
                continue
            if source := entities.get(r.get("scope")):
                r.update(s_kind=source["kind"], s_name=source["name"], s_parent=source["parent_name"])
            if fact == "global":
                target = variables.get(r["name"])
            else:
                target = entities.get(r["name"] if fact == "import" else bare(r["chain"]))
            if target:
                r.update(t_seq=target["seq"], t_kind=target["kind"], t_name=target["name"], t_parent=target["parent_name"])

    def declare(self, tree: ast.AST) -> None:
        """First pass: names, types and bases of the whole file; later assignments win."""
        scopes: list[tuple[str, str]] = []

        def walk(node: ast.AST) -> None:
            if isinstance(node, SCOPES):
                kind = "Class" if isinstance(node, ast.ClassDef) else "Method"
                owner = next((n for n, t in reversed(scopes) if t == "Class"), "")
                full = ".".join([*(n for n, _ in scopes), node.name])
                if kind == "Class":
                    self.bases[node.name] = [self.source(b) for b in node.bases]
                else:
                    for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                        if a.annotation is not None:
                            self.parameters[full, a.arg] = self.source(a.annotation)
                        elif a.arg == "cls" and owner:
                            self.parameters[full, a.arg] = owner
                    if node.returns is not None:
                        self.returns[full] = self.source(node.returns)
                scopes.append((node.name, kind))
                for x in ast.iter_child_nodes(node):
                    walk(x)
                scopes.pop()
                return
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                self.imported(node)
            pairs = []
            if isinstance(node, ast.Assign):
                for t in node.targets:
                    many = isinstance(t, ast.Tuple) and isinstance(node.value, ast.Tuple) and len(t.elts) == len(node.value.elts)
                    pairs += list(zip(t.elts, node.value.elts)) if many else [(t, node.value)]
            elif isinstance(node, (ast.AnnAssign, ast.NamedExpr)):
                pairs.append((node.target, node.value))
            owner = next((n for n, t in reversed(scopes) if t == "Class"), "")
            for target, value in pairs:
                made = constructed(value)
                if isinstance(target, ast.Name):
                    if made:
                        self.types[target.id] = made
                    elif value is not None and isinstance(value, ast.Attribute) and (parts := dotted(value)):
                        self.methods[target.id] = ".".join(parts)
                    if not scopes and not isinstance(node, ast.NamedExpr):
                        self.globals.add(target.id)
                elif made and isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                    self.attributes[owner, target.attr] = made
            for x in ast.iter_child_nodes(node):
                walk(x)

        walk(tree)

    def imported(self, node: ast.Import | ast.ImportFrom) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.imports[a.asname or a.name.split(".")[0]] = a.name.replace(".", "/")
            return
        base = (node.module or "").replace(".", "/")
        if node.level:
            folder = self.path.split("/")[: -node.level]
            base = "/".join([*folder, *([base] if base else [])])
        for a in node.names:
            if a.name != "*":
                self.imports[a.asname or a.name] = f"{base}/{a.name}" if base else a.name

    def visit_Import(self, node: ast.Import | ast.ImportFrom) -> None:
        for a in node.names:
            local = a.asname or (a.name if isinstance(node, ast.ImportFrom) else a.name.split(".")[0])
            if a.name != "*":
                self.add("import", a, name=local, module=self.imports.get(local))

    visit_ImportFrom = visit_Import

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.entity(node, "Class")

    def visit_FunctionDef(self, node) -> None:
        self.entity(node, "Method")

    visit_AsyncFunctionDef = visit_FunctionDef

    def entity(self, node, kind: str) -> None:
        parent = "/".join(n for n, _ in self.scopes)
        self.add(
            "entity", node, kind=kind, name=node.name, parent_name=parent, parent_type=self.scopes[-1][1] if self.scopes else "",
            description=(ast.get_docstring(node) or "").strip(), complexity=complexity(node), is_exported=not node.name.startswith("_"),
            content=self.source(node), list=[self.source(d) for d in node.decorator_list],
        )
        if kind == "Class":
            for b in node.bases:
                self.add("base", b, scope=".".join([*(n for n, _ in self.scopes), node.name]), **self.reference(self.source(b)))
        self.scopes.append((node.name, kind))
        if kind == "Method":
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                if a.annotation is not None:
                    self.add("param", a.annotation, scope=self.scope, **self.reference(self.source(a.annotation).strip("\"'")))
        self.generic_visit(node)
        self.scopes.pop()

    def visit_Assign(self, node) -> None:
        if not self.scopes:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                if isinstance(t, ast.Name):
                    value = self.source(node.value) if node.value is not None else ""
                    self.add("entity", node, kind="Variable", name=t.id, parent_name="", parent_type="", complexity=1,
                             description=f"Type: Unknown\nValue: {value}", is_exported=not t.id.startswith("_"),
                             content=self.source(node), list=["constant"] if t.id.isupper() else [])
        self.generic_visit(node)

    visit_AnnAssign = visit_Assign

    def visit_Name(self, node: ast.Name) -> None:
        if self.scopes and node.id in self.globals:
            stored = isinstance(node.ctx, ast.Store) and not getattr(node, "augmented", False)
            self.add("global", node, scope=self.scope, name=node.id, flag=stored)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        node.target.augmented = True  # a use, not a change
        self.generic_visit(node)

    def reference(self, name: str) -> dict:
        """chain, and what its first part was imported as."""
        head = name.split(".")[0].split("[")[0]
        return {"chain": name, "via": head if head in self.imports else None, "module": self.imports.get(head)}

    def typed(self, parts: list[str]) -> list[str]:
        """The chain with its base replaced by the type that this file gives it."""
        head = parts[0]
        if head in ("self", "cls") and self.owner:
            if len(parts) > 2 and (made := self.attributes.get((self.owner, parts[1]))):
                return [made, *parts[2:]]
            return [self.owner, *parts[1:]]
        for n in range(len(self.scopes), 0, -1):
            if found := self.parameters.get((".".join(x for x, _ in self.scopes[:n]), head)):
                return [found.strip("\"'"), *parts[1:]] if len(parts) > 1 else parts
        if head in self.types and len(parts) > 1:
            made = self.types[head]
            return [self.returns.get(made, made).strip("\"'"), *parts[1:]]
        if len(parts) == 1 and head in self.methods:
            return self.typed(self.methods[head].split("."))
        return parts

    def visit_Call(self, node: ast.Call) -> None:
        if self.scopes:
            self.call(node)
        self.generic_visit(node)

    def call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
            base = (self.bases.get(self.owner) or [None])[0]
            if base:
                self.add("call", node, scope=self.scope, flag=True, name=base, list=[f"attribute.attr:{f.attr}", "super"], **self.reference(f"{base}.{f.attr}"))
            return
        parts = dotted(f)
        if parts is None and isinstance(f, ast.Attribute) and (made := constructed(f.value)):
            parts = [self.returns.get(made, made).strip("\"'"), f.attr]
            if parts[0] == "self" and self.owner:
                parts[0] = self.owner
        if not parts or parts == ["super"]:
            return
        path = [x for p in parts[:0:-1] for x in (f"attribute.attr:{p}", "attribute.object")] + [f"identifier:{parts[0]}"]
        chain = self.typed(parts)
        self.add("call", node, scope=self.scope, flag=False, list=path, **self.reference(".".join(chain)))
        if len(parts) == 1:
            self.add("make", node, scope=self.scope, **self.reference(parts[0]))


def facts(files: DataFrame) -> DataFrame:
    """files: file_path, content."""

    def run(batches):
        for batch in batches:
            files = zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist())
            rows = [r for path, text in files for r in FileFacts(path, text or "").run()]
            yield from pa.Table.from_pylist(rows, ARROW).to_batches()

    text = F.regexp_replace("content", "\r\n?", "\n")
    text = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    return files.select("file_path", text.alias("content")).mapInArrow(run, FACTS)


def comments(text: str) -> list[str]:
    """All comments of a source text, without their marks."""
    try:
        return [t.string.lstrip("#").strip() for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return []


def syntax_tree(text: str, depth: int = 5, skip: tuple[str, ...] = ("Load", "Store")) -> dict:
    """A parsed text as nested dictionaries, to a depth, without some kinds of nodes."""

    def show(node: ast.AST, left: int) -> dict:
        out = {"type": type(node).__name__, "line": getattr(node, "lineno", None)}
        if left:
            out["children"] = [show(x, left - 1) for x in ast.iter_child_nodes(node) if type(x).__name__ not in skip]
        return out

    return show(ast.parse(text), depth)
