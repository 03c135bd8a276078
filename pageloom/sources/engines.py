"""Engines: a registry of providers, and synthetic readings that any SQL engine can repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE

#: slug -> (display name, provider of raw output, normaliser)
_registry: dict[str, tuple[str, Callable | None, Callable[[DataFrame], DataFrame]]] = {}
#: slug -> settings: name -> (type, default)
_settings: dict[str, dict[str, tuple[type, object]]] = {}
#: Installed packages offer engines under this group of entry points: functions that call register().
GROUP = "pageloom.engines"


def register(slug: str, display_name: str, normalize: Callable[[DataFrame], DataFrame], provide: Callable | None = None, settings: dict[str, tuple[type, object]] | None = None) -> None:
    if slug in _registry:
        raise ValueError(f"engine {slug!r} is registered")
    _registry[slug] = (display_name, provide, normalize)
    _settings[slug] = dict(settings or {})


def config_schema(slug: str) -> dict:
    """An engine's settings as a JSON schema."""
    kinds = {str: "string", int: "integer", float: "number", bool: "boolean"}
    return {"type": "object", "properties": {n: {"type": kinds[t], "default": d} for n, (t, d) in _settings[slug].items()}}


def configured(slug: str, user: dict | None = None) -> dict:
    """The defaults with the user's settings over them. ValueError for an unknown setting or one of another type."""
    own = _settings[slug]
    for n, v in (user or {}).items():
        if n not in own:
            raise ValueError(f"engine {slug!r} has no setting {n!r}")
        kind = own[n][0]
        if isinstance(v, bool) != (kind is bool) or not isinstance(v, (int, float) if kind is float else kind):
            raise ValueError(f"setting {n!r} of engine {slug!r} must be of type {kind.__name__}")
    return {n: d for n, (_, d) in own.items()} | (user or {})


def discover() -> list[str]:
    """Lets installed packages register their engines, each once; the slugs that are known then."""
    from importlib.metadata import entry_points

    for e in entry_points(group=GROUP):
        if e.name not in _registry:
            e.load()()
    return sorted(_registry)


def get(slug: str) -> tuple[str, Callable | None, Callable[[DataFrame], DataFrame]]:
    return _registry[slug]


def listed(spark: SparkSession) -> DataFrame:
    rows = [(s, s, name) for s, (name, *_) in sorted(_registry.items())]
    return spark.createDataFrame(rows, "engine_id string, slug string, display_name string")


# Readings of a text that differ from it in known ways.


def misread(text: Column) -> Column:
    return F.translate(text, "ol", "01")


def lowered(text: Column) -> Column:
    return F.lower(text)


def merged(text: Column) -> Column:
    return F.replace(text, F.lit("rn"), F.lit("m"))


def dropped(words: Column, every: int = 7) -> Column:
    return F.filter(words, lambda _, i: (i + 1) % every != 0)


def repeated(words: Column, every: int = 9) -> Column:
    return F.flatten(F.transform(words, lambda w, i: F.when((i + 1) % every == 0, F.array(w, w)).otherwise(F.array(w))))


def _pick(seed: Column, n: int, *what) -> Column:
    """A number below n from the seed and the names of what is drawn."""
    return F.pmod(F.xxhash64(seed, *(x if isinstance(x, Column) else F.lit(x) for x in what)), F.lit(n)).cast("int")


def synthetic_pages(docs: DataFrame, seed: int = 42) -> DataFrame:
    """2 to 3 Letter pages for each doc_id, with 1 to 3 blocks of 1 to 2 lines of 3 to 8 words of 2 to 10 letters, confidences from 0.7
    to 1 (four decimals). The same seed and id give the same pages. Returns doc_id, page_number, data."""
    s = lambda *x: (F.xxhash64(F.lit(seed), F.col("doc_id")), *x)
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), 2 + _pick(*s()[:1], 2, "pages"))).alias("page_number"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("page_number"))
    conf = lambda *x: F.round(0.7 + _pick(key, 3001, "c", *x) / 10000, 4)

    def box(b: Column, l: Column, w: Column | None = None) -> Column:
        top = 72 + b * 200 + l * 24
        left, right = (F.lit(72.0), F.lit(540.0)) if w is None else (72.0 + w * 58, 72.0 + w * 58 + 50)
        return F.array(left.cast("double"), top.cast("double"), right.cast("double"), (top + 14).cast("double"))

    def word(b: Column, l: Column, w: Column) -> Column:
        letters = F.transform(F.sequence(F.lit(0), 1 + _pick(key, 9, "n", b, l, w)), lambda k: F.char(97 + _pick(key, 26, "l", b, l, w, k)))
        text, bb, c = F.array_join(letters, ""), box(b, l, w), conf(b, l, w)
        chars = F.transform(letters, lambda ch, k: F.struct(ch.alias("char"), bb.alias("bbox"), c.alias("confidence"), k.alias("order")))
        return F.struct(text.alias("text"), bb.alias("bbox"), c.alias("confidence"), w.alias("order"), chars.alias("chars"))

    def line(b: Column, l: Column) -> Column:
        ws = F.transform(F.sequence(F.lit(0), 2 + _pick(key, 6, "w", b, l)), lambda w: word(b, l, w))
        return F.struct(F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("text"), box(b, l).alias("bbox"), conf(b, l).alias("confidence"), l.alias("order"), ws.alias("words"))

    blocks = F.transform(F.sequence(F.lit(0), _pick(key, 3, "b")), lambda b: F.struct(F.lit("text").alias("type"), box(b, F.lit(0)).alias("bbox"), conf(b).alias("confidence"), b.alias("order"), F.transform(F.sequence(F.lit(0), _pick(key, 2, "li", b)), lambda l: line(b, l)).alias("lines")))
    data = F.struct(F.col("page_number").cast("int").alias("page_number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), blocks.alias("blocks"), F.array().alias("tables"))
    return pages.select("doc_id", "page_number", data.cast(PAGE).alias("data"))
