"""Rules that a text alone decides: Rust derives and placeholders, Prisma updates, scenes and shaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_distance
from .extract import all_matches
from .rules import warn

#: What shaders may declare.
SHADER_TYPES = ("spatial", "canvas_item", "particles", "sky", "fog")
UNIFORM_TYPES = ("bool", "int", "uint", "float", "vec2", "vec3", "vec4", "bvec2", "bvec3", "bvec4", "ivec2", "ivec3", "ivec4", "uvec2", "uvec3", "uvec4", "mat2", "mat3", "mat4", "sampler2D", "isampler2D", "usampler2D", "sampler2DArray", "sampler3D", "samplerCube")
RENDER_MODES = ("blend_mix", "blend_add", "blend_sub", "blend_mul", "depth_draw_opaque", "depth_draw_always", "depth_draw_never", "depth_test_disabled", "cull_back", "cull_front", "cull_disabled", "unshaded", "wireframe", "diffuse_lambert", "diffuse_toon", "specular_disabled", "shadows_disabled", "ambient_light_disabled", "world_vertex_coords", "skip_vertex_transform", "light_only")


def explode_matches(code: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    return code.select("response_id", F.explode(all_matches("code", pattern, group)).alias(name))


def sqlite_placeholders(code: DataFrame) -> DataFrame:
    """The first ``$N`` of each query of code that uses SQLite."""
    sqlite = F.col("code").rlike("Sqlite|sqlite:")
    sql = explode_matches(code.where(sqlite), r'\bquery(?:_as|_scalar)?!?\s*(?:::<[^>(]*>)?\(\s*(?:r#*)?"([^"]*)"', 1, "sql")
    mark = F.regexp_extract("sql", r"\$\d+", 0)
    return sql.where(mark != "").select("response_id", F.concat(F.lit("sqlite-placeholder-mismatch: SQL uses `"), mark, F.lit("` (PostgreSQL syntax) with SQLite, use `?` instead")).alias("warning"))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def missing_debug(code: DataFrame) -> DataFrame:
    """Structs without Debug, derived or written, that are printed by ``{:?}``, through an annotated variable or one of the struct's name."""
    found = explode_matches(code, r"(?:[ \t]*#\[[^\n]*\]\n)*[ \t]*(?:pub(?:\(crate\))? )?struct [A-Za-z_]\w*", 0, "head")
    structs = found.select("response_id", F.regexp_extract("head", r"struct (\w+)$", 1).alias("name"), F.lower("head").contains("debug").alias("derived"))
    written = explode_matches(code, r"impl (?:std::fmt::|fmt::)?Debug for (\w+)", 1, "name").distinct()
    bare = structs.where("not derived").join(written, ["response_id", "name"], "left_anti")
    printed = explode_matches(code, r'\b(?:e?print(?:ln)?|format|write(?:ln)?|panic)!\s*\([^;"]*"[^"]*\{:#?\?\}[^"]*"\s*,\s*([A-Za-z_]\w*)', 1, "var").distinct()
    pairs = F.zip_with(all_matches("code", r"\blet\s+(?:mut\s+)?(\w+)\s*:\s*([A-Z]\w*)", 1), all_matches("code", r"\blet\s+(?:mut\s+)?(\w+)\s*:\s*([A-Z]\w*)", 2), lambda v, t: F.struct(v.alias("var"), t.alias("type")))
    typed = code.select("response_id", F.explode(pairs).alias("p")).select("response_id", "p.*").groupBy("response_id", "var").agg(F.max("type").alias("type"))
    named = printed.join(typed, ["response_id", "var"], "left").join(bare.select("response_id", F.col("name"), snake(F.col("name")).alias("snake")), "response_id")
    hit = F.when(F.col("type").isNotNull(), F.col("type") == F.col("name")).otherwise((F.col("var") == F.col("snake")) & (F.col("snake") != F.col("name")))
    return named.where(hit).select("response_id", F.concat(F.lit("missing-debug-derive: `"), "name", F.lit("` used with `{:?}` but lacks `#[derive(Debug)]`")).alias("warning")).distinct()


def id_in_data(code: DataFrame) -> DataFrame:
    """Updates that take one variable for ``where.id`` and pass it whole as ``data``."""
    blocks = code.select("response_id", F.posexplode(all_matches("code", r"\.update\(\s*(\{[\s\S]*?\})\s*\)", 1)).alias("n", "block"))
    ids = F.expr(r"regexp_extract_all(block, r'where:\s*\{\s*id:\s*([A-Za-z_$][\w$]*)\.id\b', 1)")
    whole = F.expr(r"regexp_extract_all(block, r'\bdata:\s*([A-Za-z_$][\w$]*)\s*[,}]', 1)")
    rows = blocks.select("response_id", F.get(F.array_intersect(ids, whole), F.lit(0)).alias("name")).where("name is not null")
    return rows.select("response_id", warn("prisma-id-in-data", F.col("name"), "is used for `where.id` and passed whole as `data`").alias("warning"))


def suggested(missing: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """Adds the nearest known name within some bytes to rows with ``name``; lengths within the cap block the join."""
    asked = missing.select("name").distinct().withColumn("n", F.explode(F.sequence(F.octet_length("name") - cap, F.octet_length("name") + cap)))
    near = asked.join(known.select(F.col("name").alias("other"), F.octet_length("name").alias("n")), "n").withColumn("d", byte_distance(F.col("name"), F.col("other"), cap)).where(F.col("d") <= cap)
    best = near.groupBy("name").agg(F.min(F.struct("d", "other")).alias("m")).select("name", F.col("m.other").alias("suggestion"))
    return missing.join(best, "name", "left")


def _text(kind: str, detail: str) -> Column:
    return F.concat(warn(kind, F.col("name"), detail), F.coalesce(F.concat(F.lit(", did you mean `"), "suggestion", F.lit("`?")), F.lit("")))


def scene(code: DataFrame, nodes: DataFrame, resources: DataFrame) -> DataFrame:
    """Node and resource types that are unknown (evidence tables of names), and references that nothing declares."""
    node_types = explode_matches(code, r'(?m)^\[node [^\]\n]*\btype="([^"]+)"', 1, "name").distinct()
    resource_types = explode_matches(code, r'(?m)^\[(?:ext|sub)_resource [^\]\n]*\btype="([^"]+)"', 1, "name").distinct()
    unknown = lambda found, known, kind: suggested(found.join(known, "name", "left_anti"), known, 4).select("response_id", _text(kind, "is not known").alias("warning"))
    declared = explode_matches(code, r'(?m)^\[(?:ext|sub)_resource [^\]\n]*\bid="?([^"\s\]]+)', 1, "id").distinct()
    used = explode_matches(code, r'\b(?:Ext|Sub)Resource\(\s*"?([^")\s]+)"?\s*\)', 1, "id").distinct()
    dangling = used.join(declared, ["response_id", "id"], "left_anti").select("response_id", warn("hallucinated-reference", F.col("id"), "is not declared").alias("warning"))
    return unknown(node_types, nodes, "hallucinated-node-type").unionByName(unknown(resource_types, resources, "hallucinated-resource-type")).unionByName(dangling)


def shader(code: DataFrame) -> DataFrame:
    """Shader types, render modes and uniform types that do not exist, with the nearest that does."""
    spark = code.sparkSession
    out = None
    for kind, pattern, known, many in (
        ("hallucinated-shader-type", r"\bshader_type\s+([a-z_]\w*)", SHADER_TYPES, False),
        ("hallucinated-render-mode", r"\brender_mode\s+([^;]+)", RENDER_MODES, True),
        ("hallucinated-uniform-type", r"\buniform\s+(?:lowp\s+|mediump\s+|highp\s+)?([A-Za-z_]\w*)", UNIFORM_TYPES, False),
    ):
        found = explode_matches(code, pattern, 1, "value")
        names = found.select("response_id", F.explode(F.split("value", ",") if many else F.array("value")).alias("name")).select("response_id", F.regexp_replace(F.trim("name"), r"\s*=.*$", "").alias("name")).where("name <> ''").distinct()
        wrong = names.where(~F.col("name").isin(*known))
        rows = suggested(wrong, spark.createDataFrame([(k,) for k in known], "name string"), 6).select("response_id", _text(kind, "does not exist").alias("warning"))
        out = rows if out is None else out.unionByName(rows)
    return out
