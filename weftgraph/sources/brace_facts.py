"""Declarations of Java, JavaScript, TypeScript and Go sources, by a scanner of tokens and brackets.

No parser for these languages ships with Spark or Python, so this reads declarations, not full grammars: comments and
strings are blanked in place, brackets are matched, and declarations are found by their heads outside blanked text.
Files are independent rows of mapInArrow.  Known limits: regular-expression literals that hold quotes or brackets, and
Java or TypeScript generics that span braces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ENTITIES = (
    "file_path string, language string, seq long, kind string, name string, parent_name string, parent_type string, description string, "
    "complexity int, content string, is_exported boolean, modifiers array<string>, line int, line_end int"
)
FACTS = "fact string, file_path string, package_name string, owner string, name string, type string, detail string, line int, line_end int"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_schema = lambda ddl: pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])
LANGUAGES = {"java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go"}
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Scan:
    """A text with comments and strings blanked, its bracket pairs, and its comments by end."""

    text: str
    bare: str = ""
    pairs: dict[int, int] = field(default_factory=dict)
    comments: dict[int, str] = field(default_factory=dict)

    _TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S)

    def __post_init__(self) -> None:
        def blank(m: re.Match) -> str:
            if m[0].startswith("/"):
                self.comments[m.end()] = m[0]
                return re.sub(r"[^\n]", " ", m[0])
            return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:])

        self.bare = self._TOKEN.sub(blank, self.text)
        stack = []
        for m in re.finditer(r"[()\[\]{}]", self.bare):
            if m[0] in OPEN:
                stack.append((m[0], m.start()))
            elif stack and OPEN.index(stack[-1][0]) == CLOSE.index(m[0]):
                self.pairs[stack.pop()[1]] = m.start()

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def doc(self, at: int) -> str:
        """The comment right before a place."""
        for end, comment in self.comments.items():
            if end <= at and not self.bare[end:at].strip():
                lines = re.sub(r"^/\*+|\*/$", "", comment).split("\n")
                return "\n".join(x for x in (re.sub(r"^\s*(?:\*|//)?\s?", "", y).rstrip() for y in lines) if x).strip()
        return ""

    def block(self, at: int) -> tuple[int, int] | None:
        """The next braces from a place, unless a statement ends before them."""
        while m := re.compile(r"[;{(\[]").search(self.bare, at):
            if m[0] == ";":
                return None
            if m[0] == "{":
                return m.start(), self.pairs.get(m.start(), len(self.bare))
            at = self.pairs.get(m.start(), len(self.bare)) + 1
        return None


_JAVA = re.compile(r"((?:(?:public|protected|private|static|final|abstract|default|synchronized|native|strictfp|sealed|non-sealed)\s+|@(?!interface)\w+(?:\([^()]*\))?\s*)*)(?:(class|interface|enum|record|@interface)\s+(\w+)|(?:<[^<>]*>\s*)?([A-Za-z_][\w.<>\[\],? ]*?)\s+(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?(?=[{;]))")
_JAVA_KIND = {"class": "Class", "record": "Class", "interface": "Interface", "@interface": "Interface", "enum": "Enum"}
_NOT_TYPES = {"return", "new", "else", "throw", "case", "assert", "package", "import", "instanceof"}
_CALL_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "super", "constructor", "await", "typeof"}
_JS = re.compile(r"(export\s+(?:default\s+)?)?(?:(abstract\s+)?class\s+(\w+)|(interface|enum)\s+(\w+)|type\s+(\w+)[^=\n]*=|(async\s+)?function\s*\*?\s*(\w+)\s*\(|(?:const|let|var)\s+(\w+|\{[^{}]*\}|\[[^\[\]]*\])[^=\n;]*=(?!=)\s*((?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^={]+)?=>|function\b)?)")
_JS_METHOD = re.compile(r"(?m)^\s*((?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*)([#\w$]+)\s*(?:<[^<>]*>)?\(")
_GO_TYPE = re.compile(r"(?m)^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{|^type\s+(\w+)\s+(?!struct|interface|\()([^\n{]+)")
_GO_FUNC = re.compile(r"(?m)^func\s*(?:\(\s*\w*\s*(\*?[\w.]+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(")


def _complexity(bare: str, language: str) -> int:
    word = lambda w: len(re.findall(rf"\b(?:{w})\b", bare))
    n = 1 + word("if|while|for|catch")
    if language == "java":
        return n + word("switch") + len(re.findall(r"&&|\|\||[=!<>]=|(?<![-<>])[<>](?![<>\w])|[+*%/](?![+=*/])", bare)) + bare.count("?")
    half = word("keyof|infer") + len(re.findall(r"<[A-Z]\w*(?:\s[^<>]*)?/?>", bare))
    return int(n + word("case") + len(re.findall(r"&&|\|\||\?\.", bare)) + len(re.findall(r"\?(?![.:?])", bare)) + half * 0.5)


def entities_of(path: str, text: str) -> list[dict]:
    """Entities of one Java, JavaScript or TypeScript file, in order of their place."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    scan, found = Scan(text), []

    def add(at: int, kind: str, name: str, span, modifiers=(), exported=False, extra="") -> None:
        end = span[1] + 1 if span else scan.bare.find("\n", at) % (len(text) + 1)
        found.append({"at": at, "end": end, "kind": kind, "name": name, "modifiers": [m for m in modifiers if m], "is_exported": exported,
                      "description": "\n".join(x for x in (scan.doc(at), extra) if x), "complexity": _complexity(scan.bare[at:end], language) if span else 1,
                      "content": text[at:end], "line": scan.line(at), "line_end": scan.line(end)})

    if language == "java":
        for m in _JAVA.finditer(scan.bare):
            modifiers = re.findall(r"@\w+(?:\([^()]*\))?|[\w-]+", m[1])
            at, span = m.start() + len(m[0]) - len(m[0].lstrip()), scan.block(m.end(3) if m[3] else m.end() if scan.bare[m.end() : m.end() + 1] == "{" else m.end())
            if m[3]:
                head = scan.bare[m.end(3) : span[0]] if span else ""
                up, many = re.search(r"\bextends\s+([\w.<>]+)", head), re.search(r"\bimplements\s+([\w.<>, ]+)", head)
                extra = "\n".join(([f"Superclass: {up[1]}"] if up else []) + ([f"Implements: {', '.join(x.strip() for x in many[1].split(','))}"] if many else []))
                add(at, _JAVA_KIND[m[2]], m[3], span, modifiers, "public" in modifiers, extra)
            elif m[4].split()[-1] not in _NOT_TYPES and m[4].split()[0] not in _NOT_TYPES and m[5] not in _CALL_WORDS:
                parameters = ", ".join(" ".join(p.split()) for p in m[6].split(",") if p.strip())
                extra = f"Return Type: {m[4].strip()}" + (f"\nParameters: {parameters}" if parameters else "")
                add(at, "Method", m[5], span, modifiers, "public" in modifiers, extra)
    else:
        for m in _JS.finditer(scan.bare):
            exported = bool(m[1]) or bool(re.search(rf"export\s*\{{[^}}]*\b{re.escape(m[3] or m[5] or m[8] or m[9] or '-')}\b", scan.bare))
            if m[3]:
                add(m.start(), "Class", m[3], scan.block(m.end()), [m[2] and "abstract"], exported)
            elif m[5]:
                add(m.start(), m[4].capitalize(), m[5], scan.block(m.end()), (), exported)
            elif m[6]:
                add(m.start(), "Variable", m[6], None, (), exported)
            elif m[8]:
                add(m.start(), "Method", m[8], scan.block(m.end() - 1), [m[7] and "async"], exported)
            elif m[10]:
                add(m.start(), "Method", m[9], scan.block(m.start(10)), ["async"] if m[10].startswith("async") else [], exported)
            elif m[9][0] in "{[":
                add(m.start(), "Variable", ", ".join(x.split(":")[0].strip() for x in m[9][1:-1].split(",") if x.strip()), None, (), exported, "Destructured Variable")
            else:
                add(m.start(), "Variable", m[9], None, (), exported)
        for c in [x for x in found if x["kind"] == "Class"]:
            for m in _JS_METHOD.finditer(scan.bare, scan.bare.find("{", c["at"]) + 1, c["end"] - 1):
                close, span = scan.pairs.get(m.end() - 1), None
                if close and (m[2] not in _CALL_WORDS or m[2] == "constructor") and re.match(r"\s*(?::[^{;=]+)?\{", scan.bare[close + 1 :]):
                    span = scan.block(close + 1)
                inside = sum(1 for o, e in scan.pairs.items() if c["at"] < o < m.start() < e and scan.bare[o] == "{")
                if span and inside == 1:
                    add(m.start(2), "Method", m[2], span, m[1].split(), False)
    found.sort(key=lambda x: (x["at"], -x["end"]))
    out, seen = [], set()
    for x in found:
        parents = [y for y in found if y is not x and y["kind"] in ("Class", "Method", "Interface", "Enum") and y["at"] < x["at"] and x["end"] <= y["end"]]
        if parents and x["kind"] in ("Variable",) or x["kind"] in ("Interface", "Enum") and parents:
            continue
        key = (x["kind"], x["name"], "/".join(p["name"] for p in parents), x["content"])
        if key in seen:
            continue
        seen.add(key)
        out.append({"file_path": path, "language": language, "seq": len(out), "parent_name": key[2], "parent_type": parents[-1]["kind"] if parents else "",
                    **{k: v for k, v in x.items() if k not in ("at", "end")}})
    return out


def brace_entities(files: DataFrame) -> DataFrame:
    """files: file_path, content.  Entities of Java, JavaScript and TypeScript; other files give none."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist())
            rows = [r for p, t in pairs for r in entities_of(p, t or "")]
            yield from pa.Table.from_pylist(rows, _schema(ENTITIES)).to_batches()

    own = F.regexp_like(F.lower("file_path"), F.lit(r"\.(java|jsx?|tsx?)$"))
    return files.where(own).select("file_path", "content").mapInArrow(run, ENTITIES)


def go_facts_of(path: str, text: str) -> list[dict]:
    """package, import, struct, interface, type, field, embed, method spec, function, variable, enum, call and literal
    facts of one Go file."""
    scan, out = Scan(text), []
    package = (re.search(r"(?m)^package\s+(\w+)", scan.bare) or ["", ""])[1]

    def add(fact, at, end, name, owner="", kind="", detail="") -> None:
        out.append({"fact": fact, "file_path": path, "package_name": package, "owner": owner, "name": name, "type": kind.strip(), "detail": detail, "line": scan.line(at), "line_end": scan.line(max(at, end))})

    def fields(owner: str, a: int, b: int) -> None:
        at = a + 1
        while at < b:
            stop = re.compile(r"[\n;]").search(scan.bare, at, b)
            brace = scan.bare.find("{", at, b)
            end = stop.start() if stop else b
            if 0 <= brace < end:
                end = scan.pairs.get(brace, b) + 1
            piece = scan.bare[at:end].strip()
            if m := re.match(r"([\w, ]+?)\s+((?:\[\w*\]|map\[[\w.*]+\]|\*)*)struct\s*\{", piece):
                for name in (x.strip() for x in m[1].split(",")):
                    add("field", at, end, name, owner, m[2] + "struct")
                    add("struct", at, end, f"{owner}.{name}")
                    fields(f"{owner}.{name}", brace, scan.pairs.get(brace, b))
            elif m := re.match(r"\*?([\w.]+)$", piece):
                add("embed", at, end, m[1], owner)
            elif m := re.match(r"([\w, ]+?)\s+(\S.*)", piece):
                for name in (x.strip() for x in m[1].split(",")):
                    add("field", at, end, name, owner, re.sub(r"\s*`.*", "", m[2]))
            at = end + 1

    for m in re.finditer(r'(?m)^import\s*(?:\(([^)]*)\)|(\w+\s+)?("[^"\n]*"))', text):
        for line in (m[1] or f"{m[2] or ''}{m[3]}").split("\n"):
            if n := re.search(r'(?:([\w.]+)\s+)?"([^"]+)"', line):
                add("import", m.start(), m.end(), n[2], "", "", n[1] or "")
    for m in _GO_TYPE.finditer(scan.bare):
        if m[3]:
            add("type", m.start(), m.end(), m[3], "", m[4])
            continue
        brace = m.end() - 1
        end = scan.pairs.get(brace, len(text))
        add(m[2], m.start(), end, m[1])
        if m[2] == "struct":
            fields(m[1], brace, end)
        else:
            for line in scan.bare[brace + 1 : end].split("\n"):
                if n := re.match(r"\s*(\w+)\s*(\(.*)", line):
                    add("method_spec", brace, brace, n[1], m[1], "", " ".join(f"{n[1]}{n[2]}".split()))
                elif n := re.match(r"\s*([\w.]+)\s*$", line):
                    add("embed", brace, brace, n[1], m[1])
    for m in _GO_FUNC.finditer(scan.bare):
        close = scan.pairs.get(m.end() - 1, m.end())
        span = scan.block(close + 1)
        end = span[1] if span else close
        owner = (m[1] or "").lstrip("*")
        add("function", m.start(), end, m[2], owner, scan.bare[close + 1 : span[0]] if span else "", " ".join(text[m.end() : close].split()))
        name = f"{owner}.{m[2]}" if owner else m[2]
        if span:
            for c in re.finditer(r"(go\s+)?\b((?:\w+\.)*\w+)\s*\(", scan.bare[span[0] : end]):
                if c[2] not in ("if", "for", "switch", "func", "return", "make", "len", "append", "cap", "panic", "new", "delete", "copy"):
                    add("call", span[0] + c.start(), span[0] + c.start(), c[2], name, "", "go" if c[1] else "")
            for c in re.finditer(r"(?<![\w.])&?((?:\w+\.)?[A-Z]\w*)\s*\{", scan.bare[span[0] : end]):
                add("literal", span[0] + c.start(), span[0] + c.start(), c[1], name)
    for m in re.finditer(r"(?m)^(var|const)\s*(?:\(([^)]*)\)|([^\n]+))", scan.bare):
        kind, typed = "enum" if m[1] == "const" and m[2] and "iota" in m[2] else "variable", ""
        for line in (m[2] or m[3]).split("\n"):
            if n := re.match(r"\s*(\w+)(?:\s+([\w.*\[\]]+))?\s*(?:=.*)?$", line):
                typed = n[2] or typed
                add(kind, m.start(), m.end(), n[1], "", typed if kind == "enum" else n[2] or "")
    return out


def go_facts(files: DataFrame) -> DataFrame:
    """files: file_path, content.  Facts of all .go files."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist())
            rows = [r for p, t in pairs for r in go_facts_of(p, t or "")]
            yield from pa.Table.from_pylist(rows, _schema(FACTS)).to_batches()

    return files.where(F.col("file_path").endswith(".go")).select("file_path", "content").mapInArrow(run, FACTS)
