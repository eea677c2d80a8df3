"""Queries over rules that a text alone decides, on code written from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import textrules
from .registry import query

_W2 = "concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"


@query(
    f"""SELECT p_partkey AS response_id, concat('missing-debug-derive: `', {_W2}, 'Row` used with `{{:?}}` but lacks `#[derive(Debug)]`') AS warning FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, concat('sqlite-placeholder-mismatch: SQL uses `$', p_size, '` (PostgreSQL syntax) with SQLite, use `?` instead') FROM part WHERE p_partkey % 2 = 0"""
)
def rust_rules(v):
    name = F.expr(f"concat({_W2}, 'Row')")
    derive = F.when(F.col("p_partkey") % 3 == 0, "#[derive(Clone)]\n").when(F.col("p_partkey") % 3 == 1, "#[derive(Debug, Clone)]\n").otherwise("")
    written = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("impl Debug for "), name, F.lit(" {}\n"))).otherwise("")
    printed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("let x: "), name, F.lit(' = y;\nprintln!("v {:?}", x);\n'))).otherwise(F.concat(F.lit('println!("v {:?}", '), F.lower(F.expr("split_part(p_name, ' ', 2)")), F.lit("_row);\n")))
    pool = F.when(F.col("p_partkey") % 2 == 0, "use SqlitePool;\n").otherwise("use PgPool;\n")
    code = v.part.select(F.col("p_partkey").alias("response_id"), F.concat(pool, derive, F.lit("pub struct "), name, F.lit(" { a: i32 }\n"), written, printed, F.lit('sqlx::query!("select $'), "p_size", F.lit('", a);')).alias("code"))
    return textrules.missing_debug(code).unionByName(textrules.sqlite_placeholders(code))


@query("SELECT p_partkey AS response_id, concat('prisma-id-in-data: `', split_part(p_name, ' ', 2), '` is used for `where.id` and passed whole as `data`') AS warning FROM part WHERE p_partkey % 3 = 0")
def update_rules(v):
    name = F.expr("split_part(p_name, ' ', 2)")
    data = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, "rest").otherwise("{ a }")
    code = v.part.select(F.col("p_partkey").alias("response_id"), F.concat(F.lit("await db.user.update({ where: { id: "), name, F.lit(".id }, data: "), data, F.lit(" })")).alias("code"))
    return textrules.id_in_data(code)


@query(
    """SELECT p_partkey AS response_id, 'hallucinated-node-type: `Sprte2D` is not known, did you mean `Sprite2D`?' AS warning FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, concat('hallucinated-reference: `', p_size + 1, '` is not declared') FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 'hallucinated-render-mode: `unshadd` does not exist, did you mean `unshaded`?' FROM part WHERE p_partkey % 5 = 0"""
)
def scene_rules(v):
    node = F.when(F.col("p_partkey") % 2 == 1, "Sprte2D").otherwise("Sprite2D")
    ref = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    mode = F.when(F.col("p_partkey") % 5 == 0, "unshadd").otherwise("cull_back")
    text = F.concat(F.lit('[ext_resource type="Texture2D" path="x" id="'), "p_size", F.lit('"]\n[node name="a" type="'), node, F.lit('"]\ntexture = ExtResource("'), ref, F.lit('")\n'))
    rows = v.part.select(F.col("p_partkey").alias("response_id"), text.alias("code"))
    known = lambda *n: v.spark.createDataFrame([(x,) for x in n], "name string")
    shaders = v.part.select(F.col("p_partkey").alias("response_id"), F.concat(F.lit("shader_type spatial;\nrender_mode blend_add, "), mode, F.lit(";\nuniform vec3 c;")).alias("code"))
    return textrules.scene(rows, known("Sprite2D", "Node"), known("Texture2D")).unionByName(textrules.shader(shaders))
