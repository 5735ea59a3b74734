"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders and the rest its lower-case words, so a benchmark item and
a copy of it with other numbers or names have the same template. Windows of WINDOW template tokens are joined by hash.
Matches with the same distance between the places in document and item belong to one passage; a passage counts if enough
windows of the item follow one another in it and its slots are consistent: whatever stands in the item's slot, one value
of the item always became the same value of the document. Where every window of an item matches, this is asked of names
only: a number that an item has in two roles may come back as two numbers. Items of one template whose slots are alike and differ alike
are one class, and only the class is matched, so a benchmark of many questions of one form makes no product of questions
and documents. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlar.llm.shared import cut, free_name, narrow

WINDOW = 8
#: Windows that must match on one passage, or all of the item's if it has fewer: 10 tokens in a row.
LEAST = 3
#: Tokens of a window that must be words and not placeholders, and distinct.
WORDS = 4
#: Share of an item's distinct slot values that must each map to a single value; of names only, where all windows match.
CONSISTENT = 0.9
# Units of measure.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre "
    "litres gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur dollar dollars euro euros cent cents percent mph kmh degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules"
)

# Patterns repeat groups possessively: Java's matcher then loops, where it would recurse over a long text.

# Numerals.
NUMERALS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
)

_NUMERAL = rf"(?<![\p{{L}}\p{{M}}#@%])(?:{NUMERALS.replace(' ', '|')})(?![\p{{L}}\p{{M}}])"
#: Digits or a numeral; further numerals belong to the same number.
_NUMBER = rf"(\p{{Nd}}++(?:[.,:/]\p{{Nd}}++)*+|{_NUMERAL})(?:[ -]{_NUMERAL})*+"
#: A capitalised word after a letter, digit or comma and a blank: not at a sentence's start. A run counts as its first.
_NAME = r"(\p{Lu}(?<=[\p{L}\p{Nd},;] .)\p{Ll}++)(?: \p{Lu}\p{Ll}++)*+"


#: What stands between tokens; full stops, commas, colons and strokes before a digit don't.
_GAP = r"(?:[^\p{L}\p{M}\p{Nd}#@%.,:/]|[.,:/](?!\p{Nd}))++"
_SLOT = r"([#@%])(?:(?<=#)[\p{Nd}.,:/]+|\p{L}+)"


def template(text: Column, values: bool = False) -> Column:
    """Tokens of the text: a word in lower case, or a type (#, @, % for number, name and unit), with a slot's value after
    it if ``values``."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[#@%]", " ")
    text = F.regexp_replace(text, _NAME, "@$1")
    text = F.regexp_replace(F.lower(text), _NUMBER, " #$1 ")
    text = F.regexp_replace(text, rf"(#[^ ]+ ) ?({UNITS.replace(' ', '|')})(?![\p{{L}}\p{{M}}])", "$1%$2")
    if not values:
        text = F.regexp_replace(text, _SLOT, "$1")
    return F.array_remove(F.split(text, _GAP), "")


def _windows(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep, size, place, window): hashes of all runs of ``size`` tokens of column shapes."""
    last = f"greatest(size(shapes) - {size - 1}, 0)"
    side = F.arrays_zip(*[F.expr(f"slice(shapes, {k + 1}, {last})").alias(f"t{k}") for k in range(size)])
    placed = df.select(*keep, F.posexplode(side).alias("place", "run"))
    return placed.select(*keep, F.lit(size).alias("size"), "place", F.xxhash64(*[f"run.t{k}" for k in range(size)]).alias("window"))


def template_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_item, shapes, pattern): the class of each item, named by its least item. Items of a class have equal
    templates, and equal values at the same places: ``pattern`` has, for each slot, the first place of its value."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", template(F.col("text"), values=True).alias("tokens"), template(F.col("text")).alias("shapes"))
    pattern = F.transform("tokens", lambda t: F.when(t.rlike("^[#@%]"), F.array_position("tokens", t).cast("int")).otherwise(0))
    items = items.select("item_id", "shapes", pattern.alias("pattern"))
    of = items.groupBy(F.xxhash64("shapes", "pattern").alias("form")).agg(F.min("item_id").alias("class_item"))
    return items.withColumn("form", F.xxhash64("shapes", "pattern")).join(of, "form").drop("form")


def _item_windows(classes: DataFrame) -> DataFrame:
    """(item_id, size, at, window, values, slots, windows) of each window of each class that has words enough, the first of
    equal ones of a class; a shorter item than a window is one window. ``values`` are parts of the pattern."""
    items = classes.groupBy(F.col("class_item").alias("item_id")).agg(F.first("shapes").alias("shapes"), F.first("pattern").alias("pattern"))
    items = items.withColumn("size", F.least(F.lit(WINDOW), F.size("shapes"))).where(f"size >= {WORDS}")
    places = items.withColumn("at", F.explode(F.expr("sequence(0, size(shapes) - size)")))
    part = places.withColumn("words", F.expr("slice(shapes, at + 1, size)")).withColumn("values", F.expr("slice(pattern, at + 1, size)"))
    kept = part.where(F.size(F.array_distinct(F.filter("words", lambda x: ~x.isin("#", "@", "%")))) >= WORDS)
    kept = kept.withColumn("window", F.xxhash64("words")).withColumn("slots", F.exists("values", lambda x: x > 0))
    first = kept.groupBy("item_id", "size", "window").agg(F.min(F.struct("at", "values", "slots")).alias("f"))
    counted = first.groupBy("item_id").agg(F.count("*").alias("windows"))
    return first.join(counted, "item_id").select("item_id", "size", "window", F.col("f.at").alias("at"), F.col("f.values").alias("values"), F.col("f.slots").alias("slots"), "windows")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_hash, item_id, windows, item_windows, slots, consistent) of each text that holds a passage of a class of items;
    item_id is the class's least, ``template_classes`` says which others it stands for.

    ``docs`` needs text, ``benchmark`` item_id and text. Equal texts are looked at once. Null and empty texts and items
    hold nothing; items with under WORDS distinct words besides placeholders in every window can't be told from chance
    and match nothing. Empty tables give an empty result. ``consistent`` is of all slots, and can be below CONSISTENT where
    every window of the item matched.
    """
    items = cut(_item_windows(template_classes(benchmark)))
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most WINDOW of them
    wanted = items.select("window").distinct()
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_hash"), template(F.col("text")).alias("shapes"))
    found = None
    for size in sizes or [WINDOW]:
        placed = _windows(texts, size, "text_hash")
        found = placed if found is None else found.union(placed)
    found = cut(found.join(narrow(wanted), "window").distinct())

    pairs = found.join(narrow(items.select("item_id", "size", "window", "at", "windows")), ["size", "window"])
    passages = pairs.groupBy("text_hash", "item_id", "size", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("n"), F.first("windows").alias("windows"))
    passages = cut(passages.where(F.col("n") >= F.least(F.lit(LEAST), F.col("windows"))))

    # slots only of what is a passage so far
    slotted = found.join(narrow(items.where("slots").select("size", "window", "item_id", "at", "values")), ["size", "window"])
    slotted = slotted.withColumn("shift", F.col("place") - F.col("at")).join(passages.select("text_hash", "item_id", "size", "shift"), ["text_hash", "item_id", "size", "shift"], "left_semi")
    needed = cut(slotted.select("text_hash").distinct())
    source = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_hash"), "text").join(narrow(needed), "text_hash")
    tokens = source.groupBy("text_hash").agg(F.first("text").alias("text")).select("text_hash", template(F.col("text"), values=True).alias("tokens"))
    compared = slotted.join(tokens, "text_hash").withColumn("own", F.expr("slice(tokens, place + 1, size)"))
    compared = compared.select("text_hash", "item_id", "size", "shift", F.explode(F.arrays_zip(F.col("values").alias("a"), F.col("own").alias("b"))).alias("s"))
    compared = compared.where("s.a > 0").groupBy("text_hash", "item_id", "size", "shift", "s.a").agg((F.min("s.b") == F.max("s.b")).cast("double").alias("one"), F.min("s.b").startswith("@").alias("named"))
    names = F.avg(F.when(F.col("named"), F.col("one"))).alias("names")
    slots = compared.groupBy("text_hash", "item_id", "size", "shift").agg(F.count("*").alias("slots"), F.avg("one").alias("consistent"), names)

    judged = passages.join(slots, ["text_hash", "item_id", "size", "shift"], "left")
    whole = (F.col("n") >= F.col("windows")) & (F.col("n") >= LEAST) & (F.coalesce("names", F.lit(1.0)) >= CONSISTENT)
    judged = judged.where((F.coalesce("consistent", F.lit(1.0)) >= CONSISTENT) | whole)
    return judged.groupBy("text_hash", "item_id").agg(
        F.max("n").alias("windows"), F.max("windows").alias("item_windows"), F.max(F.coalesce("slots", F.lit(0))).alias("slots"), F.max(F.coalesce("consistent", F.lit(1.0))).alias("consistent")
    )


def decontamination_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same with doc_id in place of text_hash, and items, how many the class has: a row for each contaminated document
    and class of items."""
    sizes = template_classes(benchmark).groupBy(F.col("class_item").alias("item_id")).agg(F.count("*").alias("items"))
    found = contaminated(docs, benchmark).join(sizes, "item_id")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(found, "text_hash").select("doc_id", *[c for c in found.columns if c != "text_hash"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of the benchmark; null texts stay."""
    name = free_name(docs, "__text_hash")
    hashes = cut(contaminated(docs, benchmark).select(F.col("text_hash").alias(name)).distinct())
    return docs.join(narrow(hashes), F.xxhash64("text") == F.col(name), "left_anti")
