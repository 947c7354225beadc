"""Identifiers of graph rows as Column expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRAPH_VERSION = "2.0"
# The hash that names this envelope's fields and version, and the label of a file's own node.
SCHEMA_HASH = "a4bc762e8e4e2d91c3c52f3dda836ef818c438c78c184a0d948249328a6a47a9"
FILE_NAME = "<file>"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(value: Column | str) -> Column:
    """Outer white space off, one forward slash between parts, and `_` for what ids do not allow."""
    bare = F.regexp_replace(col(value), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\\/]+", "/"), "[^a-zA-Z0-9_./:-]", "_")


def symbol_path(file_path: Column | str, parent: Column | str, name: Column | str) -> Column:
    owner = F.coalesce(col(parent), F.lit(""))
    own = F.when(owner == "", F.lit("")).otherwise(F.concat(sanitize(F.replace(owner, F.lit("/"), F.lit("."))), F.lit(".")))
    return F.concat(sanitize(file_path), F.lit("::"), own, sanitize(name))


def node_id(tenant, repo, commit, kind, path) -> Column:
    return F.concat_ws("|", *(sanitize(x) for x in (tenant, repo, commit, kind, path)))


def edge_id(source, relation, target, rule) -> Column:
    """`edge|` and 24 hex digits; bars inside the ends' ids count as `_`."""
    basis = F.concat_ws("|", *(sanitize(x) for x in (source, relation, target, rule)))
    return F.concat(F.lit("edge|"), F.substring(F.sha2(basis, 256), 1, 24))


def clean_edge_id(source, relation, target, rule) -> Column:
    """edge_id() of ids whose parts are sanitized already: only their bars change."""
    plain = lambda x: F.replace(col(x), F.lit("|"), F.lit("_"))
    return F.concat(F.lit("edge|"), F.substring(F.sha2(F.concat_ws("|", plain(source), col(relation), plain(target), col(rule)), 256), 1, 24))


def document_key(node: Column | str) -> Column:
    """Short key of a stored row."""
    return F.substring(F.sha2(col(node), 256), 1, 48)


def path_key(path: Column | str) -> Column:
    """A readable key: long paths keep their start, and eight digits of the md5 of the original path."""
    path = col(path)
    plain = F.regexp_replace(path, "[^a-zA-Z0-9_-]", "_")
    short = F.concat(F.substring(plain, 1, 225), F.lit("_"), F.substring(F.md5(path), 1, 8), F.lit("_trunc"))
    return F.when(F.length(plain) > 240, short).otherwise(plain)


def content_hash(content: Column | str) -> Column:
    return F.md5(col(content))


def entity_key(kind, file_path, parent, name) -> Column:
    """kind/file/parent/name, without an empty parent."""
    return F.concat_ws("/", col(kind), col(file_path), F.nullif(col(parent), F.lit("")), col(name))


def file_key(file_path) -> Column:
    return F.concat(F.lit("File/"), col(file_path), F.lit("/" + FILE_NAME))


def typed_id(kind, name, path) -> Column:
    """kind:name[:path]; packages use their parent folder, imports no path."""
    kind, name, path = col(kind), col(name), col(path)
    where = F.when(kind == "package", F.regexp_replace(path, "/[^/]*$", "")).when(kind == "import", F.lit(None)).otherwise(path)
    return F.concat_ws(":", kind, name, where)
