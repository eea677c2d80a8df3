"""Strings and comments blanked out, file paths, predicted outputs, and which names are worth checking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_matches, literal
from . import patterns as P

#: What is no code, by family of languages: comments and literals, with escapes; the first alternative that fits wins.
#: Possessive, so that long ones neither recurse nor are tried again.
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"?', r"'(?:[^'\\\n]++|\\[\s\S])*+'?"
_BLOCK, _TRIPLE = r"/\*[\s\S]*?(?:\*/|\z)", r'"""[\s\S]*?(?:"""|\z)'
LITERALS = {
    "c": rf"//[^\n]*|{_BLOCK}|{_DOUBLE}|{_SINGLE}",
    "go": rf"//[^\n]*|{_BLOCK}|`[^`]*`?|{_DOUBLE}|{_SINGLE}",
    "typescript": rf"//[^\n]*|{_BLOCK}|`(?:[^`\\]++|\\[\s\S])*+`?|{_DOUBLE}|{_SINGLE}",
    "python": rf"{_TRIPLE}|#[^\n]*|{_DOUBLE}|{_SINGLE}",
    "gdscript": rf"{_TRIPLE}|#[^\n]*|{_DOUBLE}|{_SINGLE}",
    "ruby": rf"#[^\n]*|{_DOUBLE}|{_SINGLE}",
    "lua": rf"--\[\[[\s\S]*?(?:\]\]|\z)|--[^\n]*|{_DOUBLE}|{_SINGLE}",
}
LITERALS |= {k: LITERALS["c"] for k in ("cpp", "java", "csharp", "rust", "gdshader")}


def blanked(text: str, language: str) -> Column:
    """The column ``text`` with a space for each character of comments and literals; line breaks stay."""
    rx = LITERALS[language]
    spaces = F.transform(all_matches(text, rx), lambda m: F.regexp_replace(m, r"[^\n]", " "))
    gaps = F.expr(f"split({text}, {literal(rx)}, -1)")
    return F.array_join(F.zip_with(gaps, F.concat(spaces, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")


#: Where requests name files: JSON fields, XML parameters, calls, working directories.
PATHS = (
    r'"(?:filePath|file_path|path|filename|file)"\s*:\s*"([^"]+)"',
    r'<parameter name="(?:filePath|file_path|path|filename|file)">([^<]+)<',
    r'\b(?:read|write|edit|open)\(\s*"([^"]+)"',
    r"(?m)^[ \t]*(?:Working directory|cwd|Project root)[ \t]*:[ \t]*(\S+)",
)
ABSOLUTE = r"^(?:/[^/]|[A-Za-z]:[\\/])"


def file_paths(text: str) -> Column:
    """Absolute paths that a text names, each once in the order found; backslashes as slashes."""
    found = F.concat(*[all_matches(text, rx, 1) for rx in PATHS])
    return F.array_distinct(F.transform(F.filter(found, lambda p: p.rlike(ABSOLUTE)), lambda p: F.regexp_replace(p, r"\\+", "/")))


def common_parent(paths: Column) -> Column:
    """The deepest folder that holds all paths; empty without any."""
    folders = F.transform(paths, lambda p: F.split(F.regexp_replace(p, "/[^/]*$", ""), "/"))

    def shared(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        stop = F.array_position(same, False)
        return F.when(stop == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0))))

    return F.when(F.size(paths) == 0, "").otherwise(F.array_join(F.aggregate(F.slice(folders, F.lit(2), F.size(folders)), F.get(folders, F.lit(0)), shared), "/"))


#: Fixed pattern: what a sentence says a program prints.
PREDICTED = r"""(?i)\b(?:prints?|logs?|outputs?)\s+(\[[^\]]*\]|"[^"]*"|-?\d+(?:\.\d+)?|true|false|null|none)"""


def predicted_output(claim: Column) -> Column:
    return F.nullif(F.regexp_extract(claim, PREDICTED, 1), F.lit(""))


#: Marks of tool calls; of a pair both must occur.
TOOL_MARKS = (('"function"',), ('"tool_calls"',), ('"arguments"',), ('"type":"tool_use"',), ('"tool_use"',), ("[TOOL_USE:",), ('"newString"', '"oldString"'), ('"new_string"', '"old_string"'))
#: Fields of tool calls that hold code.
CODE_FIELDS = ("content", "newString", "new_string", "new_str", "file_text", "code", "command", "patch", "text", "new_source")


def has_tool_call(content: Column) -> Column:
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [content.contains(m) for m in marks]) for marks in TOOL_MARKS])


def tool_call_code(text: str) -> Column:
    """Code in the string fields of tool calls, whole or cut off, unescaped and joined by line breaks; empty without a mark."""
    fields = "|".join(CODE_FIELDS)
    values = all_matches(text, rf'"(?:{fields})"\s*:\s*"((?:[^"\\]++|\\.)*+)', 1)
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r"\\t", "\t"), r'\\"', '"'), r"\\\\", r"\\")
    return F.when(has_tool_call(F.col(text)), F.array_join(F.transform(values, plain), "\n")).otherwise("")


#: Words of languages that are no variables, and primitive types that are not tracked.
NO_VARIABLES = tuple(
    sorted(
        set(
            "if for while function return switch case break continue new this self use import from export default fn def class struct enum interface impl trait type const let var static public private protected internal package extends implements "
            "throws throw try catch finally async await yield in of as where when is not and or true false null nil None True False void int long float double char bool boolean byte short string".split()
        )
    )
)
NO_TYPES = tuple(sorted(set("Void Int Long Float Double Char Bool Byte Short String Object Any Unknown Never None Self Unit Boolean Number Integer Array List Map Dict Set Tuple Vec Option Result Box Rc Arc Ref Mutex RwLock".split())))


def plausible(scope: DataFrame) -> DataFrame:
    """Rows (var, type) whose variable and type are of two letters at least and no words of a language."""
    fit = lambda c, words: (F.octet_length(c) >= 2) & ~F.col(c).isin(*words)
    return scope.where(fit("var", NO_VARIABLES) & fit("type", NO_TYPES))


def plausible_crate(name: Column) -> Column:
    return name.rlike("^[a-z0-9_-]{2,64}$")


#: Names that need no lookup: methods every type may have, and a language's own classes.
UNIVERSAL = ("to_string", "clone", "len", "iter", "into_iter", "unwrap", "expect", "fmt", "eq", "cmp", "hash", "default", "into", "from", "as_ref", "toString", "valueOf", "hashCode", "equals")
OWN_CLASSES = {"typescript": ("Date", "Math", "JSON", "Object", "Array", "Promise", "String", "Number", "Map", "Set", "RegExp", "Error", "Symbol", "Reflect", "Intl"), "python": ("Path", "Counter", "Decimal", "Enum", "Thread", "Lock", "Event", "Queue", "Logger")}


def trusted(owner: Column, method: Column, language: Column) -> Column:
    """Claims that are verified without a lookup: universal methods, a language's own classes (also where it is unknown), and constants in capitals."""
    own = reduce(lambda a, b: a | b, [owner.isin(*names) & language.isin("", "unknown", name) for name, names in OWN_CLASSES.items()])
    return method.isin(*UNIVERSAL) | own | (owner.rlike("^[A-Z_]{2,}$") & (F.length(F.regexp_replace(owner, "_", "")) >= 2))


def truncated(text: str, family: str = "gdscript") -> Column:
    """Whether brackets stay open once strings and comments are blanked out: code that was cut off."""
    bare = blanked(text, family)
    more = lambda a, b: F.size(F.split(bare, rf"\{a}", -1)) > F.size(F.split(bare, rf"\{b}", -1))
    return more("(", ")") | more("{", "}") | more("[", "]")


def java_shaped(content: Column) -> Column:
    """Whether code that is taken for Python has imports as Java writes them."""
    return content.rlike(P.JAVA_SHAPE)


#: Lines that declare or import something, and lines that are code.
STRUCTURE = r"^[ \t]*(?:(?:pub|public|private|protected|internal|static|export|abstract|async|final|sealed|partial)\s+)*(?:use|import|using|package|namespace|mod|fn|func|function|def|class|struct|enum|trait|impl|interface|type|record|const|let|var)\b[^.?!]*(?:[{};:=(]|$)"


def real_code(content: Column, is_code: str) -> Column:
    """Whether a text is code rather than prose: it declares something, and at most three tenths of more than five lines are no code.

    ``is_code`` is the pattern of a line of code.
    """
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    structural = F.size(F.filter(lines, lambda x: x.rlike(STRUCTURE)))
    errors = F.size(F.filter(lines, lambda x: ~x.rlike(is_code)))
    return (structural > 0) & ~((errors > 0) & (structural < 3)) & ~((F.size(lines) > 5) & (errors / F.size(lines) > 0.3))


def project_roots(files: DataFrame, home: str = "") -> DataFrame:
    """(root) of folders that are a project's root: they hold a marker or a source file (path), tests and declarations aside."""
    rows = files.select(F.regexp_replace(F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1), r"\\", "/").alias("root"), F.lower(F.regexp_extract("path", r"([^/\\]*)$", 1)).alias("name"))
    source = F.col("name").rlike(r"\.(?:" + "|".join(P.ROOT_SUFFIXES) + ")$") & ~F.col("name").rlike(r"\.test\.|\.spec\.|\.d\.ts$")
    none = F.lower("root").rlike("(?:^|/)(?:" + "|".join(P.NO_ROOTS) + ")$") | (F.col("root") == home)
    return rows.where((F.col("name").isin(*P.ROOT_MARKERS) | source) & ~none).select("root").distinct()
