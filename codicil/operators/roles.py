"""Which section plays which role, by length first and type code second.

The body is the longest section (of equals the last). Key, key blob and algorithm
id are told by their lengths, which are disjoint, among the others; of several the
first with the expected type code, else the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sections as S

# Fixed values of the container format: lengths that tell a role, and the type code expected.
LENGTHS = {"body_key": ((16,), S.BODY_KEY), "key_blob": ((24, 64), S.KEY_BLOB), "algorithm": ((4,), S.ALGORITHM)}
NAMES = {"body_key": "body key", "key_blob": "key blob", "algorithm": "algorithm id"}


def resolve(parsed: DataFrame) -> DataFrame:
    """Adds body, body_key, key_blob, algorithm (section structs), role_notes, guessed; sets error where body or body key is missing."""
    df = parsed.withColumn(
        "body",
        F.expr("array_max(transform(filter(sections, s -> s.len > 0), s -> named_struct('len', s.len, 'idx', s.idx, 'ty', s.ty, 'offset', s.offset)))"),
    )
    notes = [
        F.expr(
            f"if(body.ty <> {S.PDF_BODY}, concat('body: the longest section (offset ', body.offset, ', ', body.len, ' bytes) has type code ', body.ty, ', not {S.PDF_BODY}'), null)"
        )
    ]
    guesses = []
    for role, (lengths, ty) in LENGTHS.items():
        shapes = ", ".join(map(str, lengths))
        df = df.withColumn(f"_{role}", F.expr(f"filter(sections, s -> s.idx <> coalesce(body.idx, -1) AND s.len IN ({shapes}))"))
        best = f"array_min(transform(_{role}, s -> named_struct('miss', if(s.ty = {ty}, 0, 1), 'idx', s.idx, 'ty', s.ty, 'offset', s.offset, 'len', s.len)))"
        df = df.withColumn(role, F.expr(best))
        name = NAMES[role]
        notes.append(
            F.expr(
                f"if(size(_{role}) > 1, concat(size(_{role}), ' sections have the length of a {name}; ', if({role}.miss = 0, 'taken: the first of type code {ty}', 'none has type code {ty}, taken: the first'), ' (offset ', {role}.offset, ')'), null)"
            )
        )
        notes.append(F.expr(f"if({role}.ty <> {ty}, concat('{name}: the section at offset ', {role}.offset, ' has type code ', {role}.ty, ', not {ty}; told by its ', {role}.len, ' bytes'), null)"))
        guesses.append(F.size(f"_{role}") > 1)
    df = df.withColumn("role_notes", F.when(F.col("error").isNull(), F.array_compact(F.array(*notes))).otherwise(F.expr("cast(array() AS array<string>)")))
    df = df.withColumn("guessed", F.coalesce(guesses[0] | guesses[1] | guesses[2], F.lit(False)))
    missing = F.when(F.col("body").isNull(), "body").when(F.col("body_key").isNull(), "body key")
    text = F.concat(F.lit("no section can be the "), missing, F.lit("; a file that a licence server opens has none and is out of scope"))
    lost = F.struct(F.lit("MISSING_SECTION").alias("code"), text.alias("message"))
    df = df.withColumn("error", F.when(F.col("error").isNull() & missing.isNotNull(), lost).otherwise(F.col("error")))
    return df.drop("_body_key", "_key_blob", "_algorithm")


def roles_by_rank(rows: DataFrame, key: str) -> DataFrame:
    """The same choice over exploded section rows: key, role, idx; for tables that hold sections as rows."""
    from pyspark.sql import Window

    longest = Window.partitionBy(key).orderBy(F.desc("len"), F.desc("idx"))
    ranked = rows.withColumn("_body", (F.col("len") > 0) & (F.row_number().over(longest) == 1))
    role, expected = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (lengths, ty) in LENGTHS.items():
        fits = F.col("len").isin(*lengths)
        role, expected = F.when(fits, name).otherwise(role), F.when(fits, ty).otherwise(expected)
    ranked = ranked.withColumn("role", F.when(F.col("_body"), "body").otherwise(role)).withColumn("_miss", F.when(F.col("_body") | (F.col("ty") == expected), 0).otherwise(1)).where("role IS NOT NULL")
    pick = Window.partitionBy(key, "role").orderBy("_miss", "idx")
    return ranked.withColumn("_n", F.row_number().over(pick)).where("_n = 1").select(key, "role", "idx")
