"""Recipe JSON to display fields, as column expressions on variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LIST = "array<variant>"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, start: str) -> Column:
    return F.coalesce(_kind(v).startswith(start), F.lit(False))


def _trimmed(s: Column) -> Column:
    return F.nullif(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit(""))


def as_string(v: Column) -> Column:
    """A string trimmed (null if blank), a number as text without a zero fraction, else null."""
    number = F.try_variant_get(v, "$", "double")
    text = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    numeric = _kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    return F.when(_is(v, "STRING"), _trimmed(F.try_variant_get(v, "$", "string"))).when(numeric, text)


def _field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _items(v: Column) -> Column:
    """The elements of a list, or the value as the only one; none for null."""
    absent = v.isNull() | _is(v, "VOID")
    return F.when(absent, F.array().cast(_LIST)).when(_is(v, "ARRAY"), F.try_variant_get(v, "$", _LIST)).otherwise(F.array(v))


def _named(v: Column, key: str) -> Column:
    """A string, or an object's ``key`` as string."""
    return F.when(_is(v, "STRING"), as_string(v)).when(_is(v, "OBJECT"), as_string(_field(v, key)))


def normalize_author(v: Column) -> Column:
    names = F.filter(F.transform(_items(v), lambda x: _named(x, "name")), lambda s: s.isNotNull())
    return F.nullif(F.array_join(names, " & "), F.lit(""))


def normalize_images(v: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_items(v), lambda x: _named(x, "url")), lambda s: s.isNotNull()))


def format_duration(text: Column) -> Column:
    """PT#H#M as '1 h 30 min', '2 h' or '15 min'; null for zero and for other texts."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?$"
    h, m = (F.coalesce(F.regexp_extract(text, pattern, k).try_cast("long"), F.lit(0)) for k in (1, 2))
    hours, minutes = F.concat(h.cast("string"), F.lit(" h")), F.concat(m.cast("string"), F.lit(" min"))
    said = F.when((h > 0) & (m > 0), F.concat_ws(" ", hours, minutes)).when(h > 0, hours).when(m > 0, minutes)
    return F.when(text.rlike(pattern), said)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda s: s.isNotNull())


def normalize_ingredients(recipe: Column) -> Column:
    """recipeIngredient's strings and numbers; else the lines of a legacy ``ingredients`` string; else none."""
    primary, legacy = _field(recipe, "recipeIngredient"), _field(recipe, "ingredients")
    listed = F.filter(F.transform(F.try_variant_get(primary, "$", _LIST), as_string), lambda s: s.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(_is(primary, "ARRAY"), listed).when(_is(legacy, "STRING"), _lines(F.try_variant_get(legacy, "$", "string"))).otherwise(none)


def _step(text: Column) -> Column:
    return F.struct(F.lit("step").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("array<string>").alias("steps"))


def normalize_instructions(v: Column) -> Column:
    """array<struct<kind, text, heading, steps>>: steps, and sections that have steps; a section's heading is '' by default."""

    def entry(x: Column) -> Column:
        section = _is(x, "OBJECT") & F.coalesce(F.try_variant_get(x, "$['@type']", "string") == "HowToSection", F.lit(False))
        inner = _field(x, "itemListElement")
        steps = F.filter(F.transform(F.try_variant_get(inner, "$", _LIST), lambda s: _named(s, "text")), lambda s: s.isNotNull())
        steps = F.when(_is(inner, "ARRAY"), steps).otherwise(F.array().cast("array<string>"))
        made = F.struct(
            F.lit("section").alias("kind"), F.lit(None).cast("string").alias("text"),
            F.coalesce(as_string(_field(x, "name")), F.lit("")).alias("heading"), steps.alias("steps"),
        )
        text = _named(x, "text")
        return F.when(section & (F.size(steps) > 0), made).when(~section & text.isNotNull(), _step(text))

    listed = F.filter(F.transform(F.try_variant_get(v, "$", _LIST), entry), lambda s: s.isNotNull())
    told = F.transform(_lines(F.try_variant_get(v, "$", "string")), _step)
    none = F.array().cast("array<struct<kind:string,text:string,heading:string,steps:array<string>>>")
    return F.when(_is(v, "STRING"), told).when(_is(v, "ARRAY"), listed).otherwise(none)


def normalize_recipe(recipe: Column) -> Column:
    """All display fields of a recipe variant as one struct."""
    text = lambda key: F.when(_is(_field(recipe, key), "STRING"), F.try_variant_get(_field(recipe, key), "$", "string"))
    return F.struct(
        F.coalesce(as_string(_field(recipe, "name")), F.lit("Untitled")).alias("name"),
        normalize_author(_field(recipe, "author")).alias("author"),
        normalize_images(_field(recipe, "image")).alias("images"),
        as_string(_field(recipe, "description")).alias("description"),
        as_string(_field(recipe, "recipeYield")).alias("yield"),
        format_duration(text("prepTime")).alias("prep_time"),
        format_duration(text("cookTime")).alias("cook_time"),
        format_duration(text("totalTime")).alias("total_time"),
        normalize_ingredients(recipe).alias("ingredients"),
        normalize_instructions(_field(recipe, "recipeInstructions")).alias("instructions"),
        as_string(_field(recipe, "url")).alias("source_url"),
    )


def normalize_recipes(recipes: DataFrame, jsonld: str = "jsonld") -> DataFrame:
    """recipes with a struct ``normalized``; text that is no JSON has none."""
    parsed = recipes.withColumn("_v", F.try_parse_json(F.col(jsonld)))
    return parsed.withColumn("normalized", F.when(F.col("_v").isNotNull(), normalize_recipe(F.col("_v")))).drop("_v")


def group_steps(instructions: Column) -> Column:
    """Neighbouring steps as one group, each section alone: array<struct<kind, heading, steps>>."""
    group = "struct<kind:string,heading:string,steps:array<string>>"
    start = F.array().cast(f"array<{group}>")
    make = lambda kind, heading, steps: F.struct(kind.alias("kind"), heading.alias("heading"), steps.alias("steps")).cast(group)

    def fold(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        more = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(make(F.lit("steps"), F.lit(None).cast("string"), F.concat(last["steps"], F.array(x["text"])))))
        alone = F.concat(acc, F.array(make(F.lit("steps"), F.lit(None).cast("string"), F.array(x["text"]))))
        section = F.concat(acc, F.array(make(F.lit("section"), x["heading"], x["steps"])))
        return F.when(x["kind"] == "section", section).when((F.size(acc) > 0) & (last["kind"] == "steps"), more).otherwise(alone)

    return F.aggregate(instructions, start, fold)


def source_host(url: Column) -> Column:
    """Host with port of an absolute http URL, or 'source'."""
    found = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#\s]+)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("source"))
