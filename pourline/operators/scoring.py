"""Drink or food: weighted rules over a recipe, as column expressions.

A rule is a condition and a weight.  Every expression works on one recipe struct
(fields of ``page_facts``), so scoring adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORER_VERSION = "v1"
NEAR = 8
DRINK_AT, FOOD_AT = 2, -2

#: The vocabularies of the rules.
GLASSWARE = "collins coupe coupette flute highball julep nick rocks snifter tumbler".split()
CONTAINERS = "cup glass glasses mug stein".split()
FAMILY = (
    "bellini cobbler cocktail collins daiquiri fizz flip highball julep margarita martini mimosa mule negroni paloma punch rickey "
    "sangria smash sour spritz swizzle toddy"
).split()
COOKED = (
    "biscuit biscuits bread breads brownie brownies burger burgers cake cakes casserole casseroles chili cookie cookies curries curry "
    "fettuccine frittata lasagna linguine loaf loaves muffin muffins noodle noodles omelet omelette pasta pie pies pizza quiche ravioli "
    "risotto roast salad salads sandwich sandwiches sauce sauces souffle soup soups spaghetti stew stews taco tacos tart tarts"
).split()
METADATA = (
    "aperitif aperitivo bellini beverage beverages cocktail cocktails daiquiri digestif drink drinks highball julep lowball margarita "
    "martini mimosa mojito mule negroni nightcap paloma spritz"
).split()
BARTENDER = "absinthe amari amaro aperol benedictine bitters campari chartreuse curacao falernum fernet maraschino orgeat vermouth".split()
LIQUID = "barspoon barspoons centiliter centiliters cl dash dashes drop drops milliliter milliliters ml ounce ounces oz splash splashes".split()
DRY = "cup cups kg kilogram kilograms lb lbs pound pounds tablespoon tablespoons tbsp tbsps teaspoon teaspoons tsp tsps".split()
YIELD_WORDS = "cocktail cocktails drink drinks".split()
OVEN = r"\bpreheat\b[^.]*\boven\b|\bbake\b[^.]*\bat\b\s*\d|\broast\b[^.]*\bat\b\s*\d|\bbake\s+at\s+\d|\broast\s+at\s+\d|\boven\s+to\s+\d"


def _set(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column) -> Column:
    """All runs of a-z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


def word_near(words: Column, target: str, others: list[str], window: int = NEAR) -> Column:
    """Whether target stands within ``window`` tokens of any of ``others``: a look at each target's neighbourhood."""
    near = lambda i: F.slice(words, F.greatest(i - window + 1, F.lit(1)), F.least(i + 1, F.lit(window + 1)) + window)
    places = F.transform(words, lambda w, i: F.when((w == target) & F.arrays_overlap(near(i), _set(others)), True).otherwise(False))
    return F.array_contains(words, target) & F.array_contains(places, True)


def unit_class(line: Column) -> Column:
    """liquid or dry by the line's first unit word, else null."""
    first = F.get(F.filter(tokens(line), lambda t: t.isin(*LIQUID, *DRY)), F.lit(0))
    return F.when(first.isin(*LIQUID), "liquid").when(first.isin(*DRY), "dry")


def iso_minutes(raw: Column) -> Column:
    """Minutes of PT#H#M#S; seconds count in whole minutes; null for other texts."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda k: F.coalesce(F.regexp_extract(text, pattern, k).try_cast("long"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 60 + part(2) + F.floor(part(3) / 60))


def yield_drink_like(numbers: Column, texts: Column) -> Column:
    few = F.exists(numbers, lambda x: (x > 0) & (x <= 2))
    said = F.exists(
        texts,
        lambda t: F.arrays_overlap(tokens(t), _set(YIELD_WORDS))
        | (t.rlike(r"^\s*\d+\s*$") & (F.coalesce(F.regexp_extract(t, r"(\d+)", 1).try_cast("long"), F.lit(99)) <= 2)),
    )
    return F.coalesce(few, F.lit(False)) | F.coalesce(said, F.lit(False))


def _hit(values: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.arrays_overlap(tokens(v), _set(METADATA))), F.lit(False))


def breadcrumb_names(json: Column) -> Column:
    """Names along a recipe's breadcrumb: each entry's item, or the item's name; null where an entry has no text, or all is missing."""
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    at = lambda entry, path: said(F.try_variant_get(entry, path, "variant"))
    entries = F.try_variant_get(F.try_parse_json(json), "$.mainEntityOfPage.breadcrumb.itemListElement", "array<variant>")
    return F.transform(entries, lambda e: F.coalesce(at(e, "$.item"), at(e, "$.item.name")))


def bartender_hits(ingredients: Column) -> Column:
    """Distinct bartender words in the order they first appear."""
    return F.array_distinct(F.filter(F.flatten(F.transform(ingredients, tokens)), lambda t: t.isin(*BARTENDER)))


def rules_of(recipe: Column, with_tokens: Column | None = None) -> Column:
    """array<struct<rule, weight>> of the rules that fire, in order; ``with_tokens`` are the instructions' tokens."""
    name, words = tokens(recipe["name"]), tokens(recipe["instructions"]) if with_tokens is None else with_tokens
    low = F.lower(recipe["instructions"])
    cooked = F.arrays_overlap(name, _set(COOKED))
    classes = F.transform(recipe["ingredients"], unit_class)
    count = lambda kind: F.size(F.filter(classes, lambda c: F.coalesce(c == kind, F.lit(False))))
    liquid, dry = count("liquid"), count("dry")
    table = [
        ("name_cooked_noun", -4, cooked),
        ("name_cocktail_family", 3, ~cooked & F.arrays_overlap(name, _set(FAMILY))),
        ("instructions_shake_ice", 3, word_near(words, "shake", ["ice"])),
        ("instructions_strain_glassware", 4, word_near(words, "strain", GLASSWARE + CONTAINERS)),
        ("instructions_oven_verb", -3, low.rlike(OVEN)),
        ("instructions_muddle", 2, F.array_contains(words, "muddle")),
        ("instructions_rim_glass", 2, low.contains("rim the glass") | low.contains("rimmed with")),
        ("yield_drink_like", 2, yield_drink_like(recipe["yield_numbers"], recipe["yield_texts"])),
        ("ingredients_liquid_units", 2, 2 * liquid > liquid + dry),
        ("ingredients_dry_units", -2, 2 * dry > liquid + dry),
    ]
    after = [
        ("metadata_category_drink", 3, _hit(recipe["category"])),
        ("metadata_keywords_drink", 3, _hit(recipe["keywords"])),
        ("metadata_breadcrumb_drink", 3, _hit(breadcrumb_names(recipe["json"]))),
        ("cook_time_long", -1, F.coalesce(iso_minutes(recipe["cook_time"]) > 10, F.lit(False))),
    ]
    fired = lambda rows: [F.when(F.coalesce(held, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(w).alias("weight"))) for n, w, held in rows]
    bartender = F.transform(bartender_hits(recipe["ingredients"]), lambda t: F.struct(F.concat(F.lit("ingredient_bartender:"), t).alias("rule"), F.lit(1).alias("weight")))
    return F.filter(F.concat(F.array(*fired(table)), bartender, F.array(*fired(after))), lambda x: x.isNotNull())


def total(rules: Column) -> Column:
    return F.aggregate(rules, F.lit(0), lambda a, x: a + x["weight"])


def label_of(score: Column) -> Column:
    return F.when(score >= DRINK_AT, "confirmed_drink").when(score <= FOOD_AT, "confirmed_food")


def score_recipes(recipes: Column) -> Column:
    """array<struct<score, rules>> of an array of recipes."""
    scored = F.transform(recipes, lambda r: F.struct(rules_of(r).alias("rules")))
    return F.transform(scored, lambda s: F.struct(total(s["rules"]).alias("score"), s["rules"].alias("rules")))


def classify_pages(pages: DataFrame) -> DataFrame:
    """pages(…, facts) -> with score, rules and label of the page's best recipe, the first of equals; no recipe: 0, none, null."""
    scored = pages.withColumn("_scored", score_recipes(F.col("facts.recipes")))
    # One fold over the page's recipes: a later one counts only with more points.
    first = F.get("_scored", F.lit(0))
    best = F.aggregate("_scored", first, lambda top, s: F.when(s["score"] > top["score"], s).otherwise(top))
    out = scored.withColumn("_best", best)
    score = F.coalesce(F.col("_best.score"), F.lit(0))
    found = F.col("_best").isNotNull()
    return out.withColumns({
        "score": score,
        "rules": F.coalesce(F.col("_best.rules"), F.array().cast("array<struct<rule:string,weight:int>>")),
        "label": F.when(found, label_of(score)),
    }).drop("_scored", "_best")


def review_scores(expected: DataFrame, scored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(total, correct) and the failures with score and rules; a page without label counts as abstain."""
    both = expected.select(key, "expected").join(scored.select(key, "score", "rules", F.coalesce("label", F.lit("abstain")).alias("predicted")), key)
    right = F.col("expected") == F.col("predicted")
    return both.agg(F.count("*").alias("total"), F.coalesce(F.sum(right.cast("long")), F.lit(0)).alias("correct")), both.where(~right)
