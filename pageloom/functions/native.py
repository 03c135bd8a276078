"""Column functions: all of them stay in generated code or built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges by script, digits and the letters that they are misread from.
SCRIPTS = {
    "cjk": "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{2E80}-\\x{2EFF}\\x{3000}-\\x{303F}\\x{FF01}-\\x{FF60}\\x{2F00}-\\x{2FDF}\\x{31C0}-\\x{31EF}\\x{3200}-\\x{32FF}\\x{3300}-\\x{33FF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{2FF0}-\\x{2FFF}",
    "arabic": "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{0870}-\\x{089F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}",
    "devanagari": "\\x{0900}-\\x{097F}\\x{A8E0}-\\x{A8FF}\\x{1CD0}-\\x{1CFF}",
    "thai": "\\x{0E00}-\\x{0E7F}",
    "hebrew": "\\x{0590}-\\x{05FF}\\x{FB1D}-\\x{FB4F}",
    "cyrillic": "\\x{0400}-\\x{04FF}\\x{0500}-\\x{052F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}",
    "greek": "\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}",
    "japanese": "\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}\\x{1B000}-\\x{1B0FF}\\x{1B100}-\\x{1B12F}",
    "korean": "\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{A960}-\\x{A97F}\\x{D7B0}-\\x{D7FF}",
}
MISREAD = ("0123456789", "oizeasgtbg")

#: What Python's str.split() takes for blanks.
BLANK = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def words(text: Column) -> Column:
    """Words of a text, split at any Unicode blank, without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def safe_div(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def precision(tp: Column, fp: Column) -> Column:
    return safe_div(tp, tp + fp)


def f1(p: Column, r: Column) -> Column:
    return safe_div(2 * p * r, p + r)


def cer_levenshtein(ref: Column, hyp: Column) -> Column:
    """Least edits over the reference's length; 0 for two empty texts, 1 if only the reference is empty."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (both > 0), w * h / both).otherwise(0.0)


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two ranges over their union; 0 if they don't meet."""
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def _script_patterns() -> dict[str, str]:
    """A character class for each script. A character that two tables name belongs to the first."""
    seen, out = "", {}
    for name, ranges in SCRIPTS.items():
        out[name] = f"[{ranges}&&[^{seen}]]" if seen else f"[{ranges}]"
        seen += ranges
    return out


def script_counts(text: Column) -> Column:
    """Characters of each script as a map."""
    return F.create_map(*(x for name, p in _script_patterns().items() for x in (F.lit(name), F.regexp_count(text, F.lit(p)))))


def script_of(text: Column, denominator: str = "non_latin", least: float = 0.2) -> Column:
    """The dominant script, if its share is at least `least`: of the characters that belong to some script (`non_latin`), or of
    all visible characters (`non_whitespace`). Ties go to the script seen first.

    A text without any such character, the usual case, costs one search."""
    text = F.coalesce(text, F.lit(""))
    ranked = F.array(*(F.struct(F.regexp_count(text, F.lit(p)).alias("n"), (-F.regexp_instr(text, F.lit(p))).alias("at"), F.lit(name).alias("name")) for name, p in _script_patterns().items()))

    def choose(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"]) if denominator == "non_latin" else F.length(F.regexp_replace(text, BLANK, ""))
        best = F.array_max(found)
        return F.when(best["n"] >= least * total, best["name"]).otherwise(F.lit("latin"))

    # The array is made once, as the only item of another.
    chosen = F.transform(F.array(ranked), choose)[0]
    return F.when(text.rlike(f"[{''.join(SCRIPTS.values())}]"), chosen).otherwise(F.lit("latin"))


def unread(text: Column) -> Column:
    """Digits as the letters that they are misread from."""
    return F.translate(F.lower(text), *MISREAD)


def grams(text: Column, n: int = 3) -> Column:
    """All runs of n characters, with repeats; the whole text if it is shorter; none of an empty one."""
    k = F.length(text)
    return F.when(k == 0, F.array().cast("array<string>")).when(k < n, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(k - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def cosine_of_counts(a: Column, b: Column) -> Column:
    """Cosine of two bags given as arrays, by their distinct items."""

    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x)).cast("double")

    def norm(bag: Column) -> Column:
        return F.sqrt(F.aggregate(F.array_distinct(bag), F.lit(0.0), lambda s, x: s + count(bag, x) * count(bag, x)))

    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, x: s + count(a, x) * count(b, x))
    return safe_div(dot, norm(a) * norm(b))


def band(x: Column, limits: Sequence[float], names: Sequence[str], above: bool = False) -> Column:
    """The first name whose limit holds: x < limit, or x >= limit where above; else the last name."""
    out = None
    for limit, name in zip(limits, names, strict=False):
        test = x >= limit if above else x < limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(names[len(limits)])


def run_hash(sha256: Column, slug: Column, version: Column, config: Column, day: Column) -> Column:
    """Identity of a run: the document, the engine, its version, its settings with sorted keys, and the day."""
    entries = F.array_sort(F.map_entries(config))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    return F.sha2(F.concat_ws("|", sha256, slug, version, text, F.date_format(day, "yyyy-MM-dd")), 256)


def storage_path(base: str, prefix: str, digest: Column, extension: str) -> Column:
    return F.concat_ws("/", F.lit(base), F.lit(prefix), F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, F.lit("." + extension)))
