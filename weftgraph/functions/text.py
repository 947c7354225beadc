"""Scalar functions on paths, types, dates and replies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import col

# File extensions, languages, built-in type names, alias kinds and model limits.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".ts": "typescript", ".tsx": "tsx",
    ".go": "go", ".rb": "ruby", ".cpp": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c",
}
SUPPORTED = ("py", "js", "jsx", "ts", "tsx", "java")
BUILTIN_TYPES = (
    "string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32",
    "float64", "bool", "byte", "rune", "time.Time", "interface", "error",
)
KIND_ALIASES = {"type_spec": "struct"}
FLUENT_PREFIXES = ("set_", "add_", "remove_", "clear_", "update_", "with_", "build")
FLUENT_NAMES = ("chain", "configure", "setup", "initialize")
TOKEN_LIMITS = {
    "gpt-4": 8192, "gpt-4-32k": 32768, "gpt-3.5-turbo": 4096, "gpt-3.5-turbo-16k": 16384, "gpt-4.1-mini": 16384,
}
DEFAULT_TOKEN_LIMIT, PROMPT_OVERHEAD = 4096, 150


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def module_type(path: Column | str) -> Column:
    low = F.lower(col(path))
    return (
        F.when(F.contains(low, F.lit("test")), "test").when(F.contains(low, F.lit("doc")), "documentation")
        .when(F.contains(low, F.lit("config")), "config").otherwise("source")
    )


def extension(path: Column | str) -> Column:
    """The last dot and what follows, in lower case; empty without a dot in the last part."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def language(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(LANGUAGES), extension(path)), F.lit("unknown"))


def is_supported(path: Column | str) -> Column:
    return F.substring(extension(path), 2, 99).isin(*SUPPORTED)


def utc_datetime(value: Column | str) -> Column:
    """Epoch seconds, ISO 8601, common and RFC 2822 forms to ISO 8601 in UTC; without a zone it is UTC; else null.

    Needs spark.sql.session.timeZone=UTC.
    """
    text = F.trim(col(value).cast("string"))
    epoch = F.when(F.regexp_like(text, F.lit(r"^\d+$")), F.timestamp_seconds(F.expr(f"try_cast({_sql(value)} as bigint)")))
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy HH:mm:ss", "M/d/yyyy HH:mm:ss", "M/d/yyyy")
    parsed = F.coalesce(
        epoch, F.try_to_timestamp(F.when(~F.regexp_like(text, F.lit(r"^\d+$")), text)), *(F.try_to_timestamp(rfc, F.lit(f)) for f in forms)
    )
    part = F.when(F.date_format(parsed, "SSSSSS") == "000000", F.lit("")).otherwise(F.concat(F.lit("."), F.date_format(parsed, "SSSSSS")))
    return F.concat(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def _sql(value: Column | str) -> str:
    return f"trim(cast({value if isinstance(value, str) else value._jc.toString()} as string))"


def line_count(content: Column | str) -> Column:
    return F.size(F.split(col(content), "\n", -1))


def line_span(start: Column | str, end: Column | str) -> Column:
    return col(end) - col(start) + 1


def normalized_source(content: Column | str) -> Column:
    """LF line ends and one at the end of the text."""
    text = F.regexp_replace(col(content), "\r\n?", "\n")
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def import_target(name: Column | str, current_file: Column | str) -> Column:
    """Path of an imported module: leading dots climb folders from the current file, other dots are slashes."""
    name, current = col(name), col(current_file)
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.split(current, "/")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    relative = F.concat_ws("/", F.nullif(F.array_join(kept, "/"), F.lit("")), F.nullif(rest, F.lit("")))
    return F.when(dots > 0, relative).otherwise(rest)


def returns_self(class_name: Column | str, method: Column | str, return_type: Column | str | None = None) -> Column:
    """Whether a method reads as fluent: by its prefix or name, its return type, or a builder's name."""
    owner, method = col(class_name), col(method)
    named = F.lit(False)
    for p in FLUENT_PREFIXES:
        named = named | method.startswith(p)
    typed = F.lit(False)
    if return_type is not None:
        kind = col(return_type)
        typed = F.coalesce((kind == owner) | (kind == "self") | (kind == F.concat(F.lit("'"), owner, F.lit("'"))), F.lit(False))
    return named | method.isin(*FLUENT_NAMES) | typed | F.contains(F.lower(method), F.lit("builder")) | F.lower(owner).endswith("builder")


def element_type(annotation: Column | str) -> Column:
    """T of List[T], Iterable[T] and the like; null otherwise."""
    return F.nullif(F.regexp_extract(col(annotation), r"^(?:typing\.)?(?:[Ll]ist|[Ss]et|[Tt]uple|Iterable|Iterator|Sequence|Collection|Generator)\[\s*([^\],]+?)\s*[\],]", 1), F.lit(""))


def kind_alias(kind: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(KIND_ALIASES), col(kind)), col(kind))


def is_builtin_type(name: Column | str) -> Column:
    return col(name).isin(*BUILTIN_TYPES)


def has_generic_type(name: Column | str) -> Column:
    return F.regexp_like(col(name), F.lit(r"\[.*?\]"))


def generic_base(name: Column | str) -> Column:
    """Struct[T] and *Struct[T] to Struct."""
    return F.regexp_extract(col(name), r"^\*?([^\[\s]+)", 1)


def referenced_types(type_text: Column | str) -> Column:
    """Names that a type expression refers to: pointers and slices are looked through, a map gives key and value; the
    basic types drop out.  A type such as map[string][]*pkg.T is cut at its brackets in one pass."""
    text = F.regexp_replace(col(type_text), r"\s+", "")
    marked = F.regexp_replace(F.regexp_replace(text, r"map\[([^\]]*)\]", "$1\u0001"), r"\[\]|\*", "")
    return F.filter(F.split(marked, "\u0001"), lambda x: (x != "") & ~x.isin(*BUILTIN_TYPES))


def type_of_value(value: Column | str) -> Column:
    """Type of `make(T, ...)` or of a composite literal T{...}; null otherwise."""
    value = F.trim(col(value))
    made = F.regexp_extract(value, r"^make\(\s*([^,)]+)", 1)
    literal = F.regexp_extract(value, r"^&?([\w.\[\]*]+)\s*\{", 1)
    return F.coalesce(F.nullif(made, F.lit("")), F.nullif(literal, F.lit("")))


def path_distance(a: Column | str, b: Column | str) -> Column:
    """Differing parts at equal places, over the shorter path's length."""
    x, y = F.split(col(a), "/"), F.split(col(b), "/")
    n = F.least(F.size(x), F.size(y))
    differ = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: (p != q).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda s, v: s + v)


def reply_json(text: Column | str) -> Column:
    """The JSON part of a reply: a fenced json block, any fenced block, the outermost braces, or all of it."""
    text = col(text)
    block = lambda mark: F.split_part(F.split_part(text, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1))
    fenced = lambda mark: F.regexp_replace(block(mark), r"^\s+|\s+$", "")
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return (
        F.when(F.contains(text, F.lit("```json")), fenced("```json")).when(F.contains(text, F.lit("```")), fenced("```"))
        .otherwise(F.coalesce(F.nullif(braces, F.lit("")), text))
    )


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.char_length(col(text)) / 4).cast("int")


def fits_model(text: Column | str, model: Column | str) -> Column:
    limit = F.coalesce(F.try_element_at(_map(TOKEN_LIMITS), col(model)), F.lit(DEFAULT_TOKEN_LIMIT))
    return token_estimate(text) + PROMPT_OVERHEAD <= limit


def is_subpackage(parent_path, path, parent) -> Column:
    """A package whose folder lies in the parent's, or whose path holds the parent's name as a folder."""
    return col(path).startswith(F.concat(col(parent_path), F.lit("/"))) | F.contains(col(path), F.concat(F.lit("/"), col(parent), F.lit("/")))


def dot_id(value: Column | str) -> Column:
    plain = F.replace(F.replace(F.replace(col(value), F.lit("*"), F.lit("ptr_")), F.lit("["), F.lit("arr_")), F.lit("]"), F.lit(""))
    return F.regexp_replace(plain, r"[. \-/:]", "_")


def dot_params(params: Column | str) -> Column:
    return F.regexp_replace(F.replace(col(params), F.lit("struct{}"), F.lit("struct")), r"(?s)struct \{.*$", "struct")


def path_label(path: Column | str) -> Column:
    """Second fields of a path's ids, joined by dashes."""
    return F.array_join(F.transform(col(path), lambda p: F.split_part(p, F.lit(":"), F.lit(2))), "-")
