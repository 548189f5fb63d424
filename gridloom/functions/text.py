"""Column functions on labels, questions, model answers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of class names and the name they stand for.
ALIASES = {"highway": "road", "street": "road", "barren_land": "bare_land", "bareland": "bare_land", "barren": "bare_land", "tree": "vegetation", "forest": "vegetation", "agriculture": "farmland", "cropland": "farmland"}
CLASSES = ("building", "road", "vegetation", "farmland", "bare_land", "water")


def normalize_label(c: Column) -> Column:
    """Lower case, trimmed, dashes and spaces as underscores, aliases resolved; null and blank stay null."""
    plain = F.nullif(F.regexp_replace(F.trim(F.lower(c)), r"[-\s]+", "_"), F.lit(""))
    out = F.when(plain.isNull(), None)
    for name, stands in ALIASES.items():
        out = out.when(plain == name, stands)
    return out.otherwise(plain)


def final_class(*sources: Column) -> Column:
    """The first source that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(s), F.lit("")) for s in sources))


# Task label, how its question begins, and what it holds besides; the first rule that fits decides.
TASK_RULES = (
    ("Description", "provide a comprehensive description", ""), ("Description", "describe this image pair", ""),
    ("CN", "based on the comparison", "detectable land cover transformations involving"), ("CN", "have the regions of", "changed"),
    ("CtW", "what specific land cover class", "transformed into"), ("CtW", "what have the regions of", "changed to"),
    ("CfW", "what was the original land cover classification", "currently identified as"), ("CfW", "what did the", "change from"),
    ("IN", "when comparing the areal extent", "net expansion"), ("IN", "have the regions of", "increased"),
    ("DN", "when comparing the areal extent", "net reduction"), ("DN", "have the regions of", "decreased"),
)
# Style, phrases of which one suffices, each a set that occurs together; "^" marks a beginning, "$" a whole question.
MCQ_STYLES = (
    ("change_type", ("type of urban change",), ("type of change",)),
    ("location_change", ("location-change pair",), ("both location and change",)),
    ("location", ("^where ",)),
    ("change", ("^which change",), ("^what change",), ("change happened",), ("land cover change",)),
)
QA_STYLES = (
    ("cn", ("$did any visible change occur?",), ("$did any visible change occur",)),
    ("ctw", ("^did any region become ",)),
    ("cfw", ("^did any changed region start as ",)),
    ("urban", ("construction",), ("urban",), ("expansion",), ("demolition",)),
)
CAPTION_STYLES = (
    ("level1_global", ("urban change pattern",), ("overall urban",)),
    ("level2_change_type", ("type of urban change",), ("what does it signify",), ("what type of", "change")),
    ("level3_mask", ("specific change region",), ("change regions and their",), ("characteristics", "region")),
    ("local", ("north",), ("south",), ("east",), ("west",), ("center",), ("central",), ("middle",), ("upper",), ("lower",), ("left",), ("right",)),
    ("overall", ("overall",), ("entire",), ("whole",), ("all change",), ("pattern",), ("summary",), ("comprehensive",)),
)


def task_of_question(q: Column) -> Column:
    """Task label by ordered rules on the question in lower case with single spaces; Unknown where none fits."""
    t = F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))
    out = F.when(t == "", "Unknown")
    for task, begins, holds in TASK_RULES:
        out = out.when(t.startswith(begins) & t.contains(holds), task)
    return out.otherwise("Unknown")


def _style(t: Column, rules: tuple, rest: str | None) -> Column:
    fits = lambda p: t == p[1:] if p[0] == "$" else t.startswith(p[1:]) if p[0] == "^" else t.contains(p)
    out = None
    for style, *ways in rules:
        hit = F.lit(False)
        for way in ways:
            together = F.lit(True)
            for phrase in way:
                together = together & fits(phrase)
            hit = hit | together
        out = F.when(hit, style) if out is None else out.when(hit, style)
    return out.otherwise(rest)


def question_style(kind: Column, q: Column) -> Column:
    """Style class by kind and wording; a qa or mcq question that no rule covers is null (a reject), a caption is local."""
    t = F.lower(F.trim(q))
    return F.when(kind == "qa", _style(t, QA_STYLES, None)).when(kind == "mcq", _style(t, MCQ_STYLES, None)).when(kind == "caption", _style(t, CAPTION_STYLES, "local"))


def json_payload(answer: Column) -> Column:
    """JSON text in a model's answer: the fenced block, else the text; an array cut short is closed after its last object."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    raw = F.trim(F.coalesce(fenced, answer), F.lit(" \n\t\r"))
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    start = F.regexp_extract(raw, r"(?s)[\[{].*", 0)
    repaired = F.concat(F.regexp_extract(start, r"(?s)^.*\}", 0), F.lit("]"))
    return F.coalesce(ok(raw), ok(F.nullif(start, F.lit(""))), ok(F.nullif(repaired, F.lit("]"))))


def short_source(path: Column, folder: str = "knowledge") -> Column:
    """Path from the known folder on, else the base name."""
    inside = F.nullif(F.regexp_extract(path, rf"(?:^|/)({folder}/.*)$", 1), F.lit(""))
    return F.coalesce(inside, F.regexp_extract(path, r"[^/]*$", 0))


def preview(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def option_map(text: Column) -> Column:
    """Options A-D of ``K: v`` lines as a sorted map; an error where one is missing."""
    keys = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-D])\s*[:.]\s*(.*)$"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-D])\s*[:.]\s*(.*)$"), F.lit(2))
    made = F.map_from_entries(F.array_sort(F.arrays_zip(keys.alias("k"), values.alias("v"))))
    return F.when(F.size(F.array_distinct(keys)) == 4, made).otherwise(F.raise_error(F.concat(F.lit("options missing: "), text)))


def patch_state(ndvi: Column, nbr: Column) -> Column:
    return F.when(ndvi.between(0.4, 0.6) & (nbr > 0.27), "baseline").when((ndvi < 0.2) & (nbr < -0.25), "disturbed").when(ndvi.isNotNull() & nbr.isNotNull(), "recovering")


def paired_reading(ndvi: Column, ndwi: Column, nbr: Column) -> Column:
    return F.when((ndvi > 0.4) & (ndwi < 0), "dense plants").when((ndvi < 0.2) & (ndwi > 0.1), "water").when((ndvi < 0.2) & (nbr < -0.1), "burnt or bare").when(ndvi.isNotNull(), "mixed")
