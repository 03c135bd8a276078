"""Personal data: exact base patterns, and boosted trees over candidates of wider patterns. DataFrame functions only."""

from __future__ import annotations

import functools
import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import text_of

KINDS = ("email", "ip", "card", "phone", "id")
BASE = KINDS[:4]

# The base patterns, so written that a failing start costs little on any text. \G lets a match begin where the last
# one ended; apart from that, one that begins inside a run of its first class would have begun earlier.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A run of fewer than 16 digits fails whatever its start, so only longer ones are taken.
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"

# Wider patterns; every repetition is bounded.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]|\{at\}|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,4}| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,24}){1,4})",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\.) ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4}){2}[ ._/-]{1,3}[0-9]{3,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[1-9][0-9]{0,2}[ ./-])?\(?0?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}[ ./-][0-9]{2,5}(?:[ ./-][0-9]{2,4})?(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What must be in a text for a pattern to have a chance: plain substring tests come first.
HINT = {"email": r"@|[\[({]at[\])}]| at [A-Za-z0-9-]+ dot ", "ip": r"[0-9] ?(?:\.|[\[(])", "card": r"[0-9]{4}[ ._/-]", "phone": r"[0-9]\)?[ ./-]{1,2}[0-9]", "id": r"[0-9]-[0-9]{2}-[0-9]"}
NEAR = {
    "email": r"(?i)mail|contact|write|reach|correo|schreib|courriel",
    "ip": r"(?i)\bip\b|host|server|address|login|ping",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|fax|mobile|anruf|appel|llam",
    "id": r"(?i)ssn|social|security|passport|tax|\bid\b",
}
OTHER = r"(?i)order|invoice|version|isbn|issn|page|serial|part|ref|date|build|total|\$|€|#"
CONTEXT = 24


#: Items of a block of an array: running() works on blocks, so its work grows with n * BLOCK, not with the square of n.
BLOCK = 256
#: A match of a wide pattern has this many characters at least, so CONTEXT // LEAST matches and the gaps between them hold a context.
LEAST = 6


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value evaluated once however often make uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each item, what the items before it combine to (zero for the first); combine is associative.

    Arrays grow item by item in no fold here: that copies the array for each item.
    """
    total = lambda items, start: F.aggregate(items, start, combine)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))

    def of(blocks: Column, totals: Column) -> Column:
        with_start = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), total(F.slice(totals, 1, i), zero).alias("start")))
        return F.flatten(F.transform(with_start, lambda x: F.transform(x["b"], lambda _, j: total(F.slice(x["b"], 1, j), x["start"]))))

    made = bind(blocks, lambda bs: bind(F.transform(bs, lambda b: total(b, zero)), lambda ts: of(bs, ts)))
    return F.when(F.size(values) > 0, made).otherwise(F.slice(values, 1, 0))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (g: length of the gap before it, t: the gap's end, m: match), and at last the
    rest of the text with a null match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.right(g, F.lit(CONTEXT)).alias("t"), m.alias("m")))
    return F.filter(pairs, lambda p: p["m"].isNotNull())


def spans_of(text: Column, pattern: str, kind: int, context: bool = False) -> Column:
    """Leftmost non-overlapping matches as (k, s, e, m): code points, end exclusive; with context also b, what stands
    before the match. Lengths of what lies between matches, and of the matches, add up to positions."""

    def place(found: Column, starts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            s = F.element_at(starts, i + 1) + p["g"]
            fields = [F.lit(kind).alias("k"), s.alias("s"), (s + F.length(p["m"])).alias("e"), p["m"].alias("m")]
            if context:
                past = F.slice(found, F.greatest(i - CONTEXT // LEAST, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT // LEAST)))
                before = F.array_join(F.transform(past, lambda q: F.concat(q["t"], q["m"])), "")
                fields.append(F.right(F.concat(before, p["t"]), F.lit(CONTEXT)).alias("b"))
            return F.struct(*fields)

        return F.transform(found, one)

    lengths = lambda found: F.transform(found, lambda p: p["g"] + F.length(p["m"]))
    return bind(matches(text, pattern), lambda found: bind(running(lengths(found), F.lit(0), lambda a, x: a + x), lambda starts: place(found, starts)))


def luhn(digits: Column) -> Column:
    """Whether the digits, doubled every second one from the right, add up to a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind and start."""
    none = F.array().cast("array<struct<k:int,s:int,e:int,m:string>>")

    def of(kind: int, pattern: str, hint: Column, valid) -> Column:
        return F.when(hint, F.filter(spans_of(text, pattern, kind), valid)).otherwise(none)

    return F.concat(
        of(0, EMAIL, F.contains(text, F.lit("@")), lambda x: F.lit(True)),
        of(1, IP, text.rlike(IP), lambda x: x["m"].rlike(VALID_IP)),
        of(2, CARD, text.rlike(CARD), lambda x: (F.length(digits(x["m"])) <= 19) & luhn(digits(x["m"]))),
        of(3, PHONE, F.contains(text, F.lit("+")), lambda x: F.length(digits(x["m"])).between(8, 15)),
    )


def features(kind: int, m: Column, before: Column) -> list[Column]:
    """Facts about a candidate's format, then about what stands before it."""
    d = digits(m)
    as_int = lambda c: c.cast("int")
    return [
        F.length(d),
        F.length(m),
        F.length(F.regexp_replace(m, "[^ ]", "")),
        F.length(F.regexp_replace(m, "[^.]", "")),
        F.length(F.regexp_replace(m, "[^-/_]", "")),
        as_int(m.rlike(r"[\[({]|@")),
        as_int(m.rlike(r"\bdot\b")),
        as_int(m.rlike(r"^(?:00|\(|0)")),
        as_int(luhn(d) if kind == 2 else F.lit(False)),
        as_int(m.rlike(r"(?:com|org|net|edu|info|io|de|fr|es|uk)$")),
        as_int(F.length(F.regexp_extract(m, "[0-9]{4}$", 0)) > 0),
        as_int(F.regexp_replace(F.regexp_replace(m, r"[^0-9.]", "."), r"\.+", ".").rlike(VALID_IP)),
        as_int(before.rlike(NEAR[KINDS[kind]])),
        as_int(before.rlike(OTHER)),
        as_int(before.rlike(r"[0-9][ .,/-]{0,2}$")),
    ]


def _examples(rows: int, seed: int) -> list[tuple[int, str, str, int]]:
    """(kind, match, before, label): formats and contexts in which personal data, and what looks like it, occur."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))
    at, dot = ["(at)", "[at]", " (at) ", " [at] ", " at "], [".", "[dot]", " (dot) ", " dot "]
    cue = {0: ["mail me: ", "contact ", "write to "], 1: ["server ip ", "host ", "login from "], 2: ["card: ", "visa ", "payment by "], 3: ["call ", "tel. ", "phone: ", "fax "], 4: ["ssn ", "social security ", "tax id "]}
    off = ["order no. ", "invoice ", "version ", "isbn ", "page ", "part ", "date ", "total $"]

    def card() -> str:
        d = [int(x) for x in n(15)]
        s = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d))
        return "".join(map(str, [*d, -s % 10]))

    out = []
    for i in range(rows):
        k, real = i % 5, r.random() < 0.5
        if k == 0:
            a = r.choice(at)
            m = w() + a + w() + (" dot " if a == " at " else r.choice(dot)) + r.choice(["com", "org", "net", "de"]) if real else w() + r.choice([" @ ", "@ ", " @"]) + w() + ". " + w()
        elif k == 1:
            sep = r.choice(["[.]", "(.)", " . ", "[dot]"])
            m = (sep if real else r.choice([". ", " .", "."])).join(str(r.randint(0, 255 if real else 999)) for _ in range(4))
        elif k == 2:
            c = card() if real else n(16)
            m = r.choice([".", "_", "/", "  ", " - "]).join(c[j : j + 4] for j in range(0, 16, 4))
        elif k == 3:
            m = r.choice([f"({n(3)}) {n(3)}-{n(4)}", f"0{n(2)}/{n(3)} {n(4)}", f"0{n(3)} {n(3)} {n(3)}", f"{n(3)}-{n(3)}-{n(4)}"]) if real else r.choice([f"{n(2)}.{n(2)}.{n(4)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(3)} {n(3)} {n(3)}", f"{n(2)} {n(2)} {n(2)}"])
        else:
            m = f"{n(3)}-{n(2)}-{n(4)}"
        cued = r.random() < (0.7 if k != 4 else 1.0)
        before = w() + " " + (r.choice(cue[k]) if real and cued else r.choice(off) if not real and cued else w() + " ")
        if not real and k in (1, 3) and r.random() < 0.2:
            before += n(1) + "."
        out.append((k, m, before, int(real)))
    return out


@functools.cache
def _models(seed: int, precision: float) -> list[tuple[list, float]]:
    spark = SparkSession.getActiveSession()
    rows = [{"k": k, "m": m, "b": b, "y": y} for k, m, b, y in _examples(2000, seed)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,m:string,b:string,y:int>>")))
    out = []
    per_kind = F.array()
    for k in range(len(KINDS)):
        per_kind = F.when(F.col("k") == k, F.array(*(f.cast("double") for f in features(k, F.col("m"), F.col("b"))))).otherwise(per_kind) if k else F.array(*(f.cast("double") for f in features(0, F.col("m"), F.col("b"))))
    got = table.select("k", "y", per_kind.alias("f")).collect()
    for k in range(len(KINDS)):
        own = [r for r in got if r["k"] == k]
        x, y = np.array([r["f"] for r in own]), np.array([float(r["y"]) for r in own])
        test = np.arange(len(y)) % 4 == 0
        trees = boosting.fit(x[~test], y[~test])
        z = boosting.margin(trees, x[test])
        # The least threshold that is this precise on what wasn't learned from.
        least = 20.0
        for t in sorted(set(z.tolist()), reverse=True):
            if y[test][z >= t].mean() >= precision:
                least = t
        out.append((trees, max(least, 0.0)))
    return out


def meets(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of the spans, which don't overlap one another and are sorted: the last that begins before
    x ends is found by halving."""
    bits = F.sequence(F.length(F.bin(F.size(spans))) - 1, F.lit(0), F.lit(-1))

    def step(n: Column, bit: Column) -> Column:
        more = n + F.pow(F.lit(2), bit).cast("int")
        return F.when(more > F.size(spans), n).when(F.element_at(spans, more)["s"] < x["e"], more).otherwise(n)

    last = F.aggregate(bits, F.lit(0), step)
    return F.when(F.size(spans) == 0, False).otherwise(bind(last, lambda n: F.when(n > 0, F.element_at(spans, n)["e"] > x["s"]).otherwise(False)))


def _accepted(by_kind: Column, kind: int, trees: list, least: float, x: Column) -> Column:
    f = features(kind, x["m"], x["b"])
    return F.when(F.exists(by_kind, lambda spans: meets(spans, x)), False).otherwise(boosting.expression(trees, lambda i: f[i]) >= least)


def _filtered(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda x: test(x))


def learned_spans(text: Column, base: Column, models: list[tuple[list, float]]) -> Column:
    """Candidates of the wider patterns that overlap no base span and that the trees accept."""
    none = F.array().cast("array<struct<k:int,s:int,e:int,m:string>>")
    bare = lambda spans: F.transform(spans, lambda x: F.struct(*(x[c].alias(c) for c in "ksem")))

    def of(by_kind: Column) -> Column:
        parts = []
        for k, kind in enumerate(KINDS):
            test = functools.partial(_accepted, by_kind, k, *models[k])
            found = bare(_filtered(spans_of(text, WIDE[kind], k, True), test))
            parts.append(F.when(text.rlike(HINT[kind]) & text.rlike(WIDE[kind]), found).otherwise(none))
        return F.concat(*parts)

    return bind(F.transform(F.array(*map(F.lit, range(len(BASE)))), lambda k: F.filter(base, lambda x: x["k"] == k)), of)


def with_spans(df: DataFrame, text: Column, seed: int = 11, precision: float = 0.98) -> DataFrame:
    """df with `_base` and `_added`: arrays of (k, s, e, m)."""
    models = _models(seed, precision)
    out = df.withColumn("_base", base_spans(text))
    return out.withColumn("_added", learned_spans(text, F.col("_base"), models))


def listed(spans: Column) -> Column:
    """kind:start:end, by kind and start, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def find(df: DataFrame, seed: int = 11, precision: float = 0.98) -> DataFrame:
    """Personal data of every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans; `spans` lists these and what the trees add. Null and empty texts have
    none. Rows come out one for one, repeated ones and null ids too; other columns are ignored. An empty table
    gives an empty one. Nothing is shuffled. Base patterns find matches of any length; the repetitions of the wide
    ones are bounded, as in an email name of 64 characters. Work on a text grows about in proportion to its matches.
    """
    out = with_spans(text_of(df), F.col("text"), seed, precision)
    n = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *(n(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("_base", "_added")).alias("spans"))


def redact(df: DataFrame, seed: int = 11, precision: float = 0.98) -> DataFrame:
    """df's rows and columns with every found span of `text` replaced by its kind in brackets, such as [EMAIL].

    Overlapping spans become one, named by the first. Null texts stay null. An `n_chars` column follows the text.
    """
    names = df.columns
    out = with_spans(df.select(*(F.col(f"`{c}`") for c in names if c not in ("_base", "_added", "_text"))), F.coalesce(F.col("text"), F.lit("")), seed, precision)
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(F.concat("_base", "_added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    # Four bytes a character, so that a part is cut out without reading the text before it.
    wide = F.encode(F.col("text"), "UTF-32")
    mark = F.unhex(F.lit("0000FEFF"))  # decoding takes a byte order mark away, so each part gets one
    part = lambda w, s, e: F.decode(F.concat(mark, F.substring(w, s * 4 + 1, (e - s) * 4)), "UTF-32")

    def put(w: Column, spans: Column, past: Column) -> Column:
        """past: by span, how far those before it reach."""
        one = lambda x, i: F.when(x["s"] >= F.element_at(past, i + 1), F.concat(part(w, F.element_at(past, i + 1), x["s"]), F.element_at(tags, x["k"] + 1))).otherwise("")
        end = F.greatest(F.element_at(past, -1), F.element_at(spans, -1)["e"])
        return F.concat(F.array_join(F.transform(spans, one), ""), part(w, end, (F.octet_length(w) / 4).cast("int")))

    reach = lambda spans: running(F.transform(spans, lambda x: x["e"]), F.lit(0), lambda a, e: F.greatest(a, e))
    made = bind(wide, lambda w: bind(ordered, lambda spans: bind(reach(spans), lambda past: put(w, spans, past))))
    out = out.withColumn("_text", F.when((F.size("_base") > 0) | (F.size("_added") > 0), made).otherwise(F.col("text")))
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_text") == F.col("text"), F.col("n_chars")).otherwise(F.length("_text").cast("long")) if "n_chars" in names else None}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names if c not in ("_base", "_added", "_text")))
