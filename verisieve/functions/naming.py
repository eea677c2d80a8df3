"""Names, addresses and short forms of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Packages whose name differs from the module that is imported.
PYPI_NAMES = {
    "sklearn": "scikit-learn", "PIL": "Pillow", "cv2": "opencv-python", "yaml": "PyYAML", "dateutil": "python-dateutil", "bs4": "beautifulsoup4", "dotenv": "python-dotenv", "jose": "python-jose", "jwt": "PyJWT", "rest_framework": "djangorestframework",
}


def tokens_text(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def latency_text(ms: Column) -> Column:
    """Milliseconds, or seconds to two places; halves go up, as decimal numbers do."""
    return F.when(ms >= 1000, F.format_string("%.2fs", ms / 1e3)).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def tenths(score: Column) -> Column:
    """A score from 0 to 1 in tenths, as n/10."""
    return F.concat(F.greatest(F.least(F.round(score * 10), F.lit(10)), F.lit(0)).cast("int").cast("string"), F.lit("/10"))


def percent(n: Column, of: Column) -> Column:
    return F.when(of == 0, 0).otherwise(F.round(n * 100.0 / F.nullif(of, F.lit(0)))).cast("long")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_slug(c: Column) -> Column:
    return slug(F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "[?#].*$", ""))


def registry_url(language: Column, name: Column) -> Column:
    """Where a package's registry answers for it; null for languages without one."""
    top = F.substring_index(name, ".", 1)
    package = reduce(lambda rest, kv: F.when(top == kv[0], kv[1]).otherwise(rest), PYPI_NAMES.items(), top)
    parts = F.split(name, ":", 2)
    maven = F.when(name.contains(":"), F.concat(F.lit("g:"), parts[0], F.lit("%20AND%20a:"), F.get(parts, F.lit(1)))).otherwise(F.concat(F.lit("g:"), name))
    return (
        F.when(language == "python", F.concat(F.lit("https://pypi.org/pypi/"), package, F.lit("/json")))
        .when(language.isin("typescript", "javascript"), F.concat(F.lit("https://registry.npmjs.org/"), F.replace(name, F.lit("/"), F.lit("%2F"))))
        .when(language == "rust", F.concat(F.lit("https://crates.io/api/v1/crates/"), F.substring_index(name, "::", 1)))
        .when(language == "java", F.concat(F.lit("https://search.maven.org/solrsearch/select?q="), maven, F.lit("&rows=1&wt=json")))
        .when(language == "csharp", F.concat(F.lit("https://api.nuget.org/v3/registration5-semver1/"), F.lower(name), F.lit("/index.json")))
        .when(language == "go", F.concat(F.lit("https://proxy.golang.org/"), F.lower(name), F.lit("/@latest")))
    )


def signature(kind: Column, name: Column, params: Column, returns: Column) -> Column:
    """A readable signature of a symbol without one; params are (name, type_name, default_value)."""
    shown = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit(": "), p["type_name"], F.coalesce(F.concat(F.lit(" = "), p["default_value"]), F.lit("")))), ", ")
    ret = F.coalesce(returns, F.lit("void"))
    simple = {"signal": "signal ", "constant": "const ", "enum": "enum ", "annotation": "@", "class": "class ", "interface": "interface ", "type_alias": "type ", "module": "module "}
    out = F.when(kind == "property", F.concat(name, F.lit(": "), ret)).when(kind == "enum_member", F.concat(name, F.lit(" = ?")))
    for k, head in simple.items():
        out = out.when(kind == k, F.concat(F.lit(head), name))
    return out.otherwise(F.concat(name, F.lit("("), shown, F.lit(") -> "), ret))


def argument_count(arguments: Column) -> Column:
    """Arguments at the top level of a call's list; brackets and quoted strings with escapes do not part them."""
    bare = F.regexp_replace(F.trim(arguments), r"""(?s)"(?:\\.|[^"\\]++)*+"|'(?:\\.|[^'\\]++)*+'|`(?:\\.|[^`\\]++)*+`""", "s")
    marks = F.split(F.regexp_replace(bare, r"[^(\[{<)\]}>,]", ""), "")
    step = lambda a, c: F.struct((a["d"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)).alias("d"), (a["n"] + F.when((c == ",") & (a["d"] == 0), 1).otherwise(0)).alias("n"))
    return F.when(F.trim(arguments) == "", 0).otherwise(F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(1).alias("n")), step, lambda a: a["n"]))


def signature_arity(text: Column) -> Column:
    """Parameters of a signature, between its first and last parenthesis; null without them."""
    inner = F.regexp_extract(text, r"(?s)\((.*)\)", 1)
    return F.when(text.rlike(r"(?s)\(.*\)"), argument_count(inner))


def library_language(library: Column, prefixes: Mapping[str, Sequence[str]], local: Mapping[str, str], names: Mapping[str, str] | None = None) -> Column:
    """The language of a library: ``local.<language>.<name>``, how its name begins, or a name that is known; else unknown."""
    low = F.trim(F.lower(library))
    own = F.create_map(*[F.lit(x) for pair in local.items() for x in pair])
    out = F.when(low.startswith("local."), F.try_element_at(own, F.split_part(low, F.lit("."), F.lit(2))))
    for language, begins in prefixes.items():
        out = F.coalesce(out, F.when(reduce(lambda a, b: a | b, [low.startswith(x) | (low == x.rstrip("./_:")) for x in begins]), language))
    if names:
        out = F.coalesce(out, F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), low))
    return F.coalesce(out, F.lit("unknown"))
