"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"(?U)^\s+|\s+$"
MAX_BLURB_WORDS = 30
# fixed values: markers of a rendered semantic id
SID_START, SID_END = "<|sid_start|>", "<|sid_end|>"
# letters whose names begin with a vowel sound
VOWEL_NAMED = "FHILMNORSX"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, EDGES, "")


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def comma_spaced(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(", "))


def csv_set(c: Column) -> Column:
    """Stripped distinct entries; empty entries stay; none for null or empty texts."""
    return F.when(present(c), F.array_distinct(F.transform(F.split(c, ","), strip))).otherwise(F.array().cast("array<string>"))


def csv_raw_set(c: Column) -> Column:
    """Distinct entries as they stand."""
    return F.array_distinct(F.split(c, ","))


def csv_bag(c: Column) -> Column:
    """Stripped entries with repeats, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def blurb(c: Column, most: int = MAX_BLURB_WORDS) -> Column:
    """The first sentence; of one longer than ``most`` words the first ones, single-spaced, and dots."""
    first = F.split(strip(c), r"(?<=[.!?])(?U)\s", 2)[0]
    words = F.split(strip(first), r"(?U)\s+")
    cut = F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("..."))
    return F.when(~present(F.coalesce(strip(c), F.lit(""))), F.lit("")).when(F.size(words) <= most, first).otherwise(cut)


def item_description(name: Column, genres: Column, about: Column | None = None) -> Column:
    """Name, dash and genres; then the blurb, if about is given and has one."""
    short = F.when(present(genres), F.concat(name, F.lit(" — "), comma_spaced(genres))).otherwise(name)
    if about is None:
        return short
    text = blurb(about)
    return F.when(text != "", F.concat(short, F.lit(". "), text)).otherwise(short)


def natural_genre(c: Column) -> Column:
    """Words in lower case, all-capital ones as they stand."""
    upper = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    return F.array_join(F.transform(F.split(strip(c), r"(?U)\s+"), lambda w: F.when(upper(w), w).otherwise(F.lower(w))), " ")


def article(c: Column) -> Column:
    """a or an: acronyms go by their first letter's name."""
    acronym = (F.length(F.split(c, " ")[0]) > 1) & (F.upper(F.split(c, " ")[0]) == F.split(c, " ")[0]) & (F.lower(F.split(c, " ")[0]) != F.split(c, " ")[0])
    first = F.substring(c, 1, 1)
    an = F.when(acronym, F.instr(F.lit(VOWEL_NAMED), first) > 0).otherwise(F.instr(F.lit("aeiou"), F.lower(first)) > 0)
    return F.when(an & (F.length(c) > 0), "an").otherwise("a")


def text_field(name: Column, genres: Column, categories: Column, tags: Column, about: Column) -> Column:
    """The fields that aren't null, joined; a blank about is left out."""
    body = F.when(strip(about) != "", strip(about))
    return F.concat_ws(". ", name, comma_spaced(genres), comma_spaced(categories), comma_spaced(tags), body)


def owners_midpoint(c: Column) -> Column:
    """The mean of the ends of a range like '0 - 20000'."""
    ends = F.split(c, " - ")
    return (ends[0].cast("bigint") + ends[1].cast("bigint")) / F.lit(2.0)


def mixed_date(c: Column) -> Column:
    """A date in one of several spellings, or null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in ("MMM d, yyyy", "MMM yyyy", "yyyy-MM-dd"))).cast("date")


def sid_tokens(codes: Column) -> Column:
    """A semantic id as text: start, one token a level, end."""
    level = lambda code, i: F.concat(F.lit("<|L"), i.cast("string"), F.lit("_"), code.cast("string"), F.lit("|>"))
    return F.concat(F.lit(SID_START), F.array_join(F.transform(codes, level), ""), F.lit(SID_END))


def parse_sid(c: Column) -> Column:
    """The four codes of a rendered id by level; null unless levels 0 to 3 come once each and no more."""
    pattern = r"<\|L(\d)_(\d+)\|>"
    levels = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    codes = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), lambda x: x.cast("int"))
    pairs = F.array_sort(F.zip_with(levels, codes, lambda level, code: F.struct(level.alias("level"), code.alias("code"))))
    good = (F.size(levels) == 4) & (F.array_sort(levels) == F.array(*map(F.lit, range(4))))
    return F.when(good, F.transform(pairs, lambda x: x["code"]))


def prefix_match(predicted: Column, expected: Column, n: int) -> Column:
    return F.coalesce(F.slice(predicted, 1, n) == F.slice(expected, 1, n), F.lit(False))


def fill(template: Column, **values: Column) -> Column:
    """template with each {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def instruct(task: str, c: Column) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), c)


def contains_fold(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(part)))


def clean_completion(c: Column, eos: str) -> Column:
    return strip(F.replace(c, F.lit(eos), F.lit("")))


def alpaca_prompt(instruction: Column, given: Column) -> Column:
    return F.concat(F.lit("Below is a task with its input. Write the answer.\n\n### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), given, F.lit("\n\n### Response:\n"))


def chat_prompt(instruction: Column, given: Column, template: str = "<|user|>\n{content}\n<|assistant|>\n") -> Column:
    return F.replace(F.lit(template), F.lit("{content}"), F.concat(instruction, F.lit("\n"), given))
